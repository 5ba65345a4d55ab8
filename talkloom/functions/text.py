"""Text functions as column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TYPOGRAPHY = [("“", '"'), ("”", '"'), ("„", '"'), ("’", "'"), ("‘", "'"), ("—", "-"), ("–", "-"), ("…", "...")]
ENGLISH_MARKERS = ["the ", " the ", " is ", " are ", " was ", " were ", " have ", " has ", " and ", " or ", " but ", " that ", " this ", " with ", " for ", " you ", " I ", "I'm ", "I've ", " it ", " to ", " of ", " in ", " on "]
FALSE_FRIENDS = [
    ("крайняя иллюзия", "глубочайшее заблуждение"),
    ("крайней иллюзии", "глубочайшего заблуждения"),
    ("крайнюю иллюзию", "глубочайшее заблуждение"),
    ("крайние иллюзии", "глубочайшие заблуждения"),
    ("крайних иллюзий", "глубочайших заблуждений"),
    ("страдает от иллюзии", "страдает от заблуждения"),
    ("его иллюзия:", "его заблуждение:"),
    ("Его иллюзия:", "Его заблуждение:"),
]
LAUGHTER = ["хаха", "ахах", "lol", "haha", "хех"]
WORD_PUNCTUATION = ".,!?;:—–-…\"'«»()"
#: What clean_text() takes out, what a cut-off reply has in place of what is missing, and bare tags in arrays.
OTHER_SYMBOLS = r"""[^0-9A-Za-zА-Яа-яЁё.,!?;:'"()\- ]+"""
DEFAULT_DESCRIPTION = "Смотрите до конца! 🔥"
DEFAULT_TAGS = ["#другое", "#подкаст", "#мудрость"]
BARE_TAG = r'([,\[])\s*(#[A-Za-z0-9_\u0400-\u04FF]+)"?\s*([,\]])'
EPISODE_MARKS = ["ep", "e", "#", "episode"]
GENERIC_TAGS = ["#shorts", "#viral", "#рекомендации", "#интересное", "#факты", "#trending", "#fyp"]

_WHITE = r"[ \t\n\r\f]+"


def words(text: Column) -> Column:
    """Words between ASCII white space, as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _WHITE), lambda w: w != "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _WHITE, " "))


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replaces literal texts, one pair after another."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean_text(text: Column) -> Column:
    """Plain quotes, dashes and dots; other symbols become spaces; single spaces."""
    return squeeze(F.regexp_replace(replace_all(text, TYPOGRAPHY), OTHER_SYMBOLS, " "))


def clean_markup(text: Column) -> Column:
    """Without * _ ` ~; three or more dots become one; white space becomes single spaces (outer ones go first)."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", ""), r"[*_`~]+", ""), r"\.{3,}", "."), _WHITE, " ")


def split_sentences(text: Column, capital_next: bool = False) -> Column:
    """Sentences: cut after .!? and white space; with capital_next only before a capital letter or digit."""
    mark = F.regexp_replace(text, r"([.!?])[ \t\n\r\f]+([A-ZА-ЯЁ0-9])" if capital_next else r"([.!?])[ \t\n\r\f]+", "$1\u0001$2" if capital_next else "$1\u0001")
    return F.filter(F.split(F.trim(mark), "\u0001"), lambda s: s != "")


def replace_phrases(text: Column) -> Column:
    return replace_all(text, FALSE_FRIENDS)


def emotion_tag(text: Column, emotion: Column | None = None) -> Column:
    """A leading tag: the given emotion, else from the text's ending or laughter; texts that begin with a tag, and
    empty ones, stay."""
    t = F.trim(text)
    given = F.coalesce(F.lower(F.trim(emotion)), F.lit("")) if emotion is not None else F.lit("")
    tag = (
        F.when((t == "") | t.rlike(r"^\["), "")
        .when(given != "", F.concat(F.lit("["), given, F.lit("] ")))
        .when(t.endswith("?!") | t.endswith("!?"), "[surprised] ")
        .when(t.endswith("!"), "[enthusiastically] ")
        .when(t.endswith("..."), "[thoughtfully] ")
        .when(t.endswith("?"), "[curiously] ")
        .when(F.lower(t).rlike("|".join(LAUGHTER)), "[laughing] ")
        .otherwise("")
    )
    return F.concat(tag, t)


def norm_word(word: Column) -> Column:
    """Lower case, trimmed, without punctuation."""
    return F.translate(F.trim(F.lower(word)), WORD_PUNCTUATION, "")


def has_cyrillic(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[\u0400-\u04ff]")


def looks_english(text: Column) -> Column:
    """The lower-cased text holds any of the marker strings."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for m in dict.fromkeys(m.lower() for m in ENGLISH_MARKERS):
        found = found | F.contains(low, F.lit(m))
    return found


def strip_tags(text: Column) -> Column:
    """Without `[tag] ` parts."""
    return F.regexp_replace(text, r"\[[A-Za-z0-9_]+\][ \t\n\r\f]*", "")


def is_tag(word: Column) -> Column:
    return word.rlike(r"^\[[A-Za-z0-9_]+\]$")


def extract_json(text: Column) -> Column:
    """The JSON part of a model's reply: from the first { or [ to the last } or ], with bare #tags in arrays
    quoted; null where there is none."""
    part = F.nullif(F.regexp_extract(text, r"(?s)([{\[].*[}\]])", 1), F.lit(""))
    return F.regexp_replace(part, BARE_TAG, '$1"$2"$3')


def parse_numbers(reply: Column, n: Column) -> Column:
    """Sorted distinct whole numbers within 1..n of a reply; none for NONE or an empty one."""
    parts = F.transform(F.split(F.replace(F.trim(reply), F.lit(","), F.lit(" ")), _WHITE), lambda p: p.try_cast("int"))
    ok = F.filter(parts, lambda x: x.isNotNull() & (x >= 1) & (x <= n))
    return F.when(F.coalesce(F.upper(F.trim(reply)), F.lit("")).isin("", "NONE"), F.expr("cast(array() as array<int>)")).otherwise(F.array_sort(F.array_distinct(ok)))


def fmt_ass(ms: Column) -> Column:
    """H:MM:SS.CS, centiseconds cut off."""
    at = lambda unit, base: F.floor(ms / unit) % base
    return F.format_string("%d:%02d:%02d.%02d", F.floor(ms / 3_600_000), at(60_000, 60), at(1000, 60), at(10, 100))


def fmt_ms(ms: Column) -> Column:
    """M:SS."""
    return F.format_string("%d:%02d", F.floor(ms / 60_000), F.floor(ms / 1000) % 60)


def est_duration(text: Column) -> Column:
    """Seconds that speaking takes: words at 140 a minute, at least 0.5."""
    return F.greatest(F.lit(0.5), F.size(words(text)) / (140 / 60))


def two_lines(text: Column) -> Column:
    """Texts of six or more words on two lines, cut at the middle word."""
    w = words(text)
    half = F.floor(F.size(w) / 2).cast("int")
    return F.when(F.size(w) < 6, F.array_join(w, " ")).otherwise(F.concat(F.array_join(F.slice(w, F.lit(1), half), " "), F.lit("\\N"), F.array_join(F.slice(w, half + 1, F.size(w) - half), " ")))


def _after(text: Column, name: str) -> Column:
    """What follows a field's name and colon; empty without the field."""
    return F.coalesce(F.get(F.split(text, rf'"{name}"\s*:\s*', 2), F.lit(1)), F.lit(""))


def _between(rest: Column, opens: str, closes: str) -> tuple[Column, Column]:
    """What lies between two marks at the begin of a text, or from the first one to the end; whether it is closed."""
    inner = F.when(F.startswith(rest, F.lit(opens)), F.substring(rest, F.lit(2), F.length(rest)))
    return F.substring_index(inner, closes, 1), F.contains(inner, F.lit(closes))


def partial_fields(text: Column) -> Column:
    """title, description and hashtags of a reply that was cut off, with defaults; null without a title. A title must
    be closed; a description gets three dots; where tags are quoted, those that are not don't count."""
    title, closed = _between(_after(text, "title"), '"', '"')
    desc, _ = _between(_after(text, "description"), '"', '"')
    inside, ended = _between(_after(text, "hashtags"), "[", "]")
    items = F.transform(F.split(F.when(ended, inside).otherwise(F.lit("")), ","), lambda x: F.trim(x))
    quoted = F.filter(items, lambda x: x.rlike('^"#[^"]+"$'))
    bare = F.filter(items, lambda x: F.startswith(x, F.lit("#")) & (F.length(x) > 1))
    unquoted = lambda xs: F.transform(xs, lambda x: F.replace(x, F.lit('"'), F.lit("")))
    tags = F.when(F.size(quoted) > 0, unquoted(quoted)).when(F.size(bare) > 0, unquoted(bare)).otherwise(F.array(*[F.lit(x) for x in DEFAULT_TAGS]))
    described = F.coalesce(F.concat(F.regexp_replace(desc, r"\s+$", ""), F.lit("...")), F.lit(DEFAULT_DESCRIPTION))
    return F.when(closed & (title != ""), F.struct(title.alias("title"), described.alias("description"), tags.alias("hashtags")))


def _name(w: Column) -> Column:
    """Words that look like a name, joined: two or three, each of letters and . - ' with a capital first; else null."""
    fits = F.size(w).between(2, 3) & F.forall(w, lambda x: x.rlike(r"^\p{Lu}") & x.rlike(r"^[\p{IsLatin}.'-]+$"))
    return F.when(fits, F.array_join(w, " "))


def _name_at_end(w: Column) -> Column:
    """The last two, else three, words where they look like a name."""
    tail = lambda n: F.slice(w, F.greatest(F.size(w) - (n - 1), F.lit(1)), F.lit(n))
    return F.coalesce(_name(tail(2)), _name(tail(3)))


def guest_name(title: Column) -> Column:
    """A guest's name in a recording's title, whose file type and trailing bracket don't count; empty without one.

    In this order: the part before the first underscore; the right-most of the parts (between underscores, bars and
    dashes set in spaces) that gives one, where parts that name an episode give none and parts with numbers or marks
    give their last words; the title's last words."""
    base = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(title), r"\.\w{1,5}$", "")), r"[(\[][^()\[\]]*[)\]]$", ""))
    parts = F.transform(F.reverse(F.split(base, r"[_|]| [-–—] ")), words)

    def of_part(w: Column) -> Column:
        mark = F.regexp_replace(F.lower(F.coalesce(F.get(w, F.lit(0)), F.lit(""))), "[0-9].*", "")
        told = F.exists(w, lambda x: x.rlike("[0-9$!?]"))
        return F.when(told & mark.isin(EPISODE_MARKS), None).when(told, _name_at_end(w)).otherwise(_name(w))

    found = F.get(F.filter(F.transform(parts, of_part), lambda x: x.isNotNull()), F.lit(0))
    first = F.when(F.contains(base, F.lit("_")), _name(words(F.substring_index(base, "_", 1))))
    return F.when(title.isNotNull(), F.coalesce(first, found, _name_at_end(words(base)), F.lit("")))


def pick_hashtags(tags: Column, category: Column, defaults: Column, brand: str = "#") -> Column:
    """Three tags: the brand's one made of the category, and the first two that are not generic, filled up from the
    category's defaults (two tags, as a column of a small joined table)."""
    own = F.concat(F.lit(brand), F.replace(F.lower(F.coalesce(category, F.lit("другое"))), F.lit(" "), F.lit("_")))
    good = F.slice(F.filter(F.coalesce(tags, F.expr("cast(array() as array<string>)")), lambda t: ~F.lower(t).isin(GENERIC_TAGS)), 1, 2)
    return F.slice(F.concat(F.array(own), good, F.coalesce(defaults, F.array(F.lit("#подкаст"), F.lit("#мудрость")))), 1, 3)
