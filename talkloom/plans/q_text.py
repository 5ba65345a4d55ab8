"""Queries of text functions and of filters and projections, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.operators import selection as L
from talkloom.plans.fixtures import oracle, view


def _q(fn):
    return lambda spark, d: fn(lambda name: view(spark, d, name))


def _t(make):
    """A function over every fixture text."""
    return _q(lambda v: v("fx_texts").select("video_id", "seg_no", make(F.col("text")).alias("out")))


def reply():
    """Number lists as a model may give them."""
    n = F.col("seg_no")
    return F.when(n % 4 == 0, "NONE").when(n % 4 == 1, F.concat_ws(", ", n, F.lit("3"), F.lit("x"), F.lit("3"), F.col("video_id"))).otherwise(F.concat(F.lit(" 2 9,"), n, F.lit(" 1.5")))


def raw():
    """JSON as a model may give it: in prose, cut off, or none."""
    n = F.col("cand_no")
    prose = F.concat(F.lit('Sure! ```json\n{"title": "T'), n, F.lit('", "hashtags": ["#a", #b_'), F.col("video_id"), F.lit(', #c"]} bye'))
    return F.when(n % 3 == 0, prose).when(n % 3 == 1, F.concat(F.lit('{"title" : "A '), n, F.lit('", "description": "cut off '))).otherwise("no json")


def title():
    n = F.col("cand_no") % 5
    return F.when(n == 0, "Ann Lee_ how to x.mp4").when(n == 1, "The Big Talk - Bob Ray Cox (4K)").when(n == 2, "Why $10k Matters! Jo Diaz | EP 54").when(n == 3, F.concat(F.lit("Zed Om_"), F.col("text"))).otherwise(F.col("text"))


def _ids(v):
    return v("fx_cands").filter("(video_id + cand_no) % 4 = 0").select("video_id", "cand_no")


def _scored(v):
    c = v("fx_scores")
    return c.withColumn("score", F.round(F.col("c5"), 4)).withColumn("tier", F.when(F.col("c5") >= 0.7, "strict").when(F.col("c5") >= 0.4, "extended").when(F.col("c5") >= 0.2, "fallback"))


def _edited(v):
    return v("fx_cands").select("video_id", "cand_no", (F.col("start_ms") + 2000).alias("start_ms"), (F.col("end_ms") - 3000).alias("end_ms"))


def _attached(v):
    """Results that some segments have, others not or empty ones."""
    keys, n = ["video_id", "seg_no"], F.col("seg_no")
    given = F.when(n % 3 == 0, F.concat(F.lit("r"), n)).when(n % 3 == 1, F.lit(None))
    results = v("fx_cands").select("video_id", F.col("cand_no").alias("seg_no")).withColumn("reply", given)
    return L.attach_results(v("fx_segs").select(*keys, "text"), results, keys, {"text": "reply"})


QUERIES = {
    "u1_clean_text": _t(X.clean_text), "u2_clean_markup": _t(X.clean_markup),
    "u3_split_sentences": _t(lambda t: F.array_join(X.split_sentences(t), "|")), "u3_split_sentences_capital": _t(lambda t: F.array_join(X.split_sentences(t, True), "|")),
    "u4_replace_phrases": _t(X.replace_phrases), "u5_emotion_tag": _t(X.emotion_tag),
    "u5_given_emotion": _q(
        lambda v: v("fx_texts").select(
            "video_id", "seg_no", X.emotion_tag(F.col("text"), F.when(F.col("seg_no") % 2 == 0, " Calm ").when(F.col("seg_no") % 3 == 0, "")).alias("out")
        )
    ),
    "u6_norm_word": _q(lambda v: v("fx_words").select("video_id", "word_no", X.norm_word(F.col("word")).alias("out"))),
    "u7_extract_json": _q(lambda v: v("fx_cands").select("video_id", "cand_no", X.extract_json(raw()).alias("out"))),
    "u8_recover_partial": _q(lambda v: v("fx_cands").select("video_id", "cand_no", X.partial_fields(raw()).alias("p")).select("video_id", "cand_no", "p.title", "p.description", F.array_join("p.hashtags", ",").alias("hashtags"))),
    "u9_pick_hashtags": _q(lambda v: v("fx_cands").select("video_id", "cand_no", F.array_join(X.pick_hashtags(F.when(F.col("cand_no") % 4 > 0, F.slice(F.array(*[F.lit(t) for t in ("#FYP", "#one", "#viral", "#two", "#three")]), F.lit(1), (F.col("cand_no") % 4 * 2 - 1).cast("int"))), F.when(F.col("cand_no") % 3 == 0, "My Life"), F.when(F.col("cand_no") % 2 == 0, F.array(F.lit("#d1"), F.lit("#d2")))), " ").alias("out"))),
    "u10_guest_name": _q(lambda v: v("fx_cands").select("video_id", "cand_no", X.guest_name(title()).alias("out"))),
    "u11_formats": _q(lambda v: v("fx_segs").select("video_id", "seg_no", X.fmt_ass(F.col("start_ms") * 37).alias("ass"), X.fmt_ms(F.col("start_ms")).alias("short"))),
    "u12_est_duration": _t(lambda t: F.round(X.est_duration(t), 6)),
    "u13_two_lines": _t(X.two_lines),
    "u15_parse_numbers": _q(lambda v: v("fx_segs").select("video_id", "seg_no", F.array_join(X.parse_numbers(reply(), F.lit(9)), ",").alias("out"))),
    "p1_select_ids": _q(lambda v: L.select_ids(v("fx_cands"), _ids(v)).select("video_id", "cand_no", "text")),
    "p2_filter_tier": _q(lambda v: L.filter_tier(_scored(v), "extended").select("video_id", "cand_no", "start_ms")),
    "p3_auto_select": _q(lambda v: L.auto_select(_scored(v)).select("video_id", "cand_no", "score")),
    "p6_sentence_view": _q(
        lambda v: L.sentence_view(v("fx_texts").withColumn("text_tr", F.when(F.col("seg_no") % 3 == 0, "translated")), v("fx_diar")).select(
            "video_id", "seg_no", "text", "speaker"
        )
    ),
    "p7_language_routing": _q(
        lambda v: v("fx_texts").select("video_id", "seg_no", X.has_cyrillic(F.col("text")).alias("cyrillic"), X.looks_english(F.col("text")).alias("english"))
    ),
    "p8_translation_source": _q(
        lambda v: v("fx_texts").select(
            "video_id", "seg_no", L.translation_source(F.when(F.col("seg_no") % 2 == 0, F.concat(F.lit("en "), F.col("seg_no"))), F.col("text")).alias("source")
        )
    ),
    "p9_filter_detections": _q(
        lambda v: L.filter_detections(v("fx_boxes")).select(F.col("box_no").alias("event_id"), F.col("w").cast("long").alias("w"), "score")
    ),
    "p10_clip_words": _q(lambda v: L.clip_words(v("fx_words"), _edited(v)).groupBy("video_id", "cand_no").agg(F.count("*").alias("n"))),
    "p11_drop_tags": _q(
        lambda v: v("fx_texts").select(
            "video_id", "seg_no", X.strip_tags(F.col("text")).alias("text"), F.array_join(F.filter(X.words(F.col("text")), lambda w: ~X.is_tag(w)), " ").alias("words")
        )
    ),
    "p12_strong_criteria": _q(lambda v: L.strong_criteria(v("fx_scores"), [f"c{k}" for k in range(7)])),
    "j16_attach_results": _q(_attached),
}

_REPLY = "CASE seg_no % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN seg_no || ', 3, x, 3, ' || video_id ELSE ' 2 9,' || seg_no || ' 1.5' END"
_RAW = """CASE cand_no % 3 WHEN 0 THEN 'Sure! ```json' || chr(10) || '{"title": "T' || cand_no || '", "hashtags": ["#a", #b_' || video_id || ', #c"]} bye' WHEN 1 THEN '{"title" : "A ' || cand_no || '", "description": "cut off ' ELSE 'no json' END"""
_SQ = "trim(regexp_replace({}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_W = "list_filter(string_split_regex(coalesce({}, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"
_SRC = "{fx_texts}"


def _o(expr: str) -> str:
    return f"SELECT video_id, seg_no, {expr} AS out FROM {{fx_texts}}"


def _nest(pairs, inner="text"):
    for a, b in pairs:
        inner = "replace({}, '{}', '{}')".format(inner, a.replace("'", "''"), b.replace("'", "''"))
    return inner


_SCORED = """
sc AS (SELECT *, round(c5, 4) AS score, CASE WHEN c5 >= 0.7 THEN 'strict' WHEN c5 >= 0.4 THEN 'extended' WHEN c5 >= 0.2 THEN 'fallback' END AS tier
  FROM {fx_scores})"""
_OVER = "greatest(0, least(s.end_ms, d.end_ms) - greatest(s.start_ms, d.start_ms))"
_EMOTION = """
CASE WHEN trim(text) = '' OR starts_with(trim(text), '[') THEN trim(text) WHEN suffix(trim(text), '?!') OR suffix(trim(text), '!?') THEN
'[surprised] ' || trim(text) WHEN suffix(trim(text), '!') THEN '[enthusiastically] ' || trim(text) WHEN suffix(trim(text), '...') THEN
'[thoughtfully] ' || trim(text) WHEN suffix(trim(text), '?') THEN '[curiously] ' || trim(text) WHEN regexp_matches(lower(text),
'хаха|ахах|lol|haha|хех') THEN '[laughing] ' || trim(text) ELSE trim(text) END"""


ORACLES = {k: oracle(v) for k, v in {
    "u1_clean_text": _o(_SQ.format("regexp_replace(" + _nest(X.TYPOGRAPHY) + ", '[^0-9A-Za-zА-Яа-яЁё.,!?;:''\"()\\- ]+', ' ', 'g')")),
    "u2_clean_markup": _o("regexp_replace(regexp_replace(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(12) || chr(13)), '[*_`~]+', '', 'g'), '\\.{3,}', '.', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')"),
    "u3_split_sentences": _o("array_to_string(list_filter(string_split(trim(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g')), chr(1)), lambda x: x <> ''), '|')"),
    "u3_split_sentences_capital": _o("array_to_string(list_filter(string_split(trim(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f]+([A-ZА-ЯЁ0-9])', '\\1' || chr(1) || '\\2', 'g')), chr(1)), lambda x: x <> ''), '|')"),
    "u4_replace_phrases": _o(_nest(X.FALSE_FRIENDS)),
    "u5_emotion_tag": _o(_EMOTION),
    "u5_given_emotion": _o("CASE WHEN seg_no % 2 = 0 AND trim(text) <> '' AND NOT starts_with(trim(text), '[') THEN '[calm] ' || trim(text) ELSE " + _EMOTION + " END"),
    "u10_guest_name": """
WITH t AS (
  SELECT video_id, cand_no, CASE cand_no % 5 WHEN 0 THEN 'Ann Lee_ how to x.mp4' WHEN 1 THEN 'The Big Talk - Bob Ray Cox (4K)'
    WHEN 2 THEN 'Why $10k Matters! Jo Diaz | EP 54' WHEN 3 THEN 'Zed Om_' || text ELSE text END AS t
  FROM {fx_cands}),
b AS (SELECT *, trim(regexp_replace(trim(regexp_replace(trim(t), '\\.\\w{1,5}$', '')), '[(\\[][^()\\[\\]]*[)\\]]$', '')) AS b FROM t),
-- Parts from the right (no 1), the whole title (no 999), and what stands before an underscore (no 0).
p AS (
  SELECT video_id, cand_no, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS no FROM (SELECT *, list_reverse(string_split_regex(b, '[_|]| [-–—] ')) AS ps FROM b)
  UNION ALL SELECT video_id, cand_no, b, 999 FROM b
  UNION ALL SELECT video_id, cand_no, split_part(b, '_', 1), 0 FROM b WHERE contains(b, '_')),
w AS (SELECT *, list_filter(string_split_regex(p, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w, regexp_matches(p, '[0-9$!?]') AS told FROM p),
c AS (
  SELECT *, unnest(CASE WHEN no = 0 OR no < 999 AND NOT told THEN [w] WHEN no < 999 AND told AND regexp_replace(lower(coalesce(w[1], '')), '[0-9].*', '') IN ('ep', 'e', '#', 'episode')
    THEN [] ELSE [w[greatest(len(w) - 1, 1):], w[greatest(len(w) - 2, 1):]] END) AS n FROM w),
f AS (
  SELECT video_id, cand_no, arg_min(array_to_string(n, ' '), no * 10 + len(n)) AS name FROM c
  WHERE len(n) BETWEEN 2 AND 3 AND len(list_filter(n, lambda x: NOT regexp_matches(x, '^\\p{{Lu}}') OR NOT regexp_matches(x, '^[\\p{{Latin}}.''-]+$'))) = 0
  GROUP BY ALL)
SELECT t.video_id, t.cand_no, coalesce(name, '') AS out FROM t LEFT JOIN f USING (video_id, cand_no)""",
    "u6_norm_word": "SELECT video_id, word_no, regexp_replace(trim(lower(word)), '[.,!?;:—–\\-…\"''«»()]', '', 'g') AS out FROM {fx_words}",
    "u7_extract_json": f"""
SELECT video_id, cand_no, regexp_replace(nullif(regexp_extract(r, '(?s)([{{\\[].*[}}\\]])', 1), ''),
    '([,\\[])\\s*(#[A-Za-z0-9_Ѐ-ӿ]+)\"?\\s*([,\\]])', '\\1\"\\2\"\\3', 'g') AS out
  FROM (SELECT *, {_RAW} AS r FROM {{fx_cands}}) x""",
    "u8_recover_partial": f"""
SELECT video_id, cand_no, CASE cand_no % 3 WHEN 0 THEN 'T' || cand_no WHEN 1 THEN 'A ' || cand_no END AS title,
    CASE cand_no % 3 WHEN 0 THEN 'Смотрите до конца! 🔥' WHEN 1 THEN 'cut off...' END AS description,
    CASE cand_no % 3 WHEN 0 THEN '#a' WHEN 1 THEN '#другое,#подкаст,#мудрость' END AS hashtags
  FROM {{fx_cands}}""",
    "u9_pick_hashtags": """
SELECT video_id, cand_no, CASE WHEN cand_no % 3 = 0 THEN '#my_life' ELSE '#другое' END || CASE cand_no % 4 WHEN 3 THEN ' #one #two' WHEN 2
    THEN ' #one' || CASE WHEN cand_no % 2 = 0 THEN ' #d1' ELSE ' #подкаст' END ELSE CASE WHEN cand_no % 2 = 0 THEN ' #d1 #d2'
    ELSE ' #подкаст #мудрость' END END AS out
  FROM {fx_cands}""",
    "u11_formats": """
SELECT video_id, seg_no, printf('%d:%02d:%02d.%02d', t // 3600000, t // 60000 % 60, t // 1000 % 60, t // 10 % 100) AS ass, printf('%d:%02d',
    start_ms // 60000, start_ms // 1000 % 60) AS short
  FROM (SELECT *, start_ms * 37 AS t FROM {fx_segs}) x""",
    "u12_est_duration": _o("round(greatest(0.5::DOUBLE, len(" + _W.format("text") + ") / (140::DOUBLE / 60)), 6)"),
    "u13_two_lines": "SELECT video_id, seg_no, CASE WHEN len(w) < 6 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:len(w) // 2], ' ') || '\\N' || array_to_string(w[len(w) // 2 + 1:], ' ') END AS out FROM (SELECT *, " + _W.format("text") + " AS w FROM {fx_texts}) x",
    "u15_parse_numbers": f"""
SELECT video_id, seg_no, CASE WHEN upper(trim(r)) IN ('',
    'NONE') THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(string_split(replace(trim(r), ',', ' '),
    ' '), lambda p: regexp_full_match(p, '[0-9]+')), lambda p: p::INT), lambda x: x BETWEEN 1 AND 9))), ',') END AS out
  FROM (SELECT *, {_REPLY} AS r FROM {{fx_segs}}) x""",
    "p1_select_ids": "SELECT video_id, cand_no, text FROM {fx_cands} WHERE (video_id + cand_no) % 4 = 0",
    "p2_filter_tier": f"WITH {_SCORED} SELECT video_id, cand_no, start_ms FROM sc WHERE coalesce(tier, 'extended') = 'extended'",
    "p3_auto_select": f"WITH {_SCORED} SELECT video_id, cand_no, score FROM sc WHERE score >= 0.5",
    "p6_sentence_view": f"""
WITH p AS (SELECT s.video_id, s.seg_no, d.speaker, row_number() OVER (PARTITION BY s.video_id, s.seg_no ORDER BY {_OVER} DESC, d.iv_no) AS n
  FROM {{fx_texts}} s JOIN {{fx_diar}} d ON s.video_id = d.video_id AND {_OVER} > 0)
  SELECT s.video_id, s.seg_no, trim(CASE WHEN s.seg_no % 3 = 0 THEN 'translated' ELSE nullif(s.text, '') END) AS text, coalesce(p.speaker,
    s.speaker) AS speaker
  FROM {{fx_texts}} s LEFT JOIN p ON p.video_id = s.video_id AND p.seg_no = s.seg_no AND p.n = 1""",
    "p7_language_routing": "SELECT video_id, seg_no, regexp_matches(coalesce(text, ''), '[Ѐ-ӿ]') AS cyrillic, " + " OR ".join("contains(lower(coalesce(text, '')), '{}')".format(m.lower().replace("'", "''")) for m in X.ENGLISH_MARKERS) + " AS english FROM {fx_texts}",
    "p8_translation_source": """
SELECT video_id, seg_no, CASE WHEN seg_no % 2 = 0 THEN 'en ' || seg_no WHEN NOT regexp_matches(text, '[Ѐ-ӿ]') THEN text END AS source
  FROM {fx_texts}""",
    "p9_filter_detections": """
SELECT event_id, 10 + event_id % 90 AS w, (event_id % 100) / 100 AS score FROM events
  WHERE 10 + event_id % 90 >= 16 AND (10 + event_id % 90) * (10 + event_id % 90) * 1.2 >= 0.0005 * 1920 * 1080 AND event_id % 100 >= 50""",
    "p10_clip_words": """
SELECT w.video_id, c.cand_no, count(*) AS n
  FROM {fx_words} w JOIN {fx_cands} c ON w.video_id = c.video_id AND w.end_ms > c.start_ms + 2000 AND w.start_ms < c.end_ms - 3000
  GROUP BY ALL""",
    "j16_attach_results": """
SELECT s.video_id, s.seg_no, CASE WHEN c.cand_no % 3 = 0 THEN 'r' || c.cand_no ELSE s.text END AS text
FROM {fx_segs} s LEFT JOIN {fx_cands} c ON c.video_id = s.video_id AND c.cand_no = s.seg_no""",
    "p11_drop_tags": "SELECT video_id, seg_no, regexp_replace(text, '\\[[A-Za-z0-9_]+\\][ \\t\\n\\r\\f]*', '', 'g') AS text, array_to_string(list_filter(" + _W.format("text") + ", lambda x: NOT regexp_full_match(x, '\\[[A-Za-z0-9_]+\\]')), ' ') AS words FROM {fx_texts}",
    "p12_strong_criteria": " UNION ALL ".join(f"SELECT video_id, cand_no, 'c{k}' AS name, c{k} AS value FROM {{fx_scores}} WHERE c{k} > 0.6" for k in range(7)),
}.items()}
