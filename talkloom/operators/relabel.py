"""Speakers of candidates made anew: from a later diarization, as voices, and after a boundary was edited.

Candidates: video_id, cand_no, start_ms, end_ms. Turns: video_id, cand_no, turn_no, speaker, text, start_ms, end_ms.
Words of turns: video_id, cand_no, turn_no, pos, word, start_ms, end_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.operators.intervals import BUCKET_MS, assign_speaker_max, candidate_pairs
from talkloom.operators.subtitles import match_by_start
from talkloom.operators.turns import islands, joined

CAND = ["video_id", "cand_no"]
#: Voice kinds by place of a speaker, for each preset.
PRESETS = {"male_duo": ("male", "male", "male"), "mixed_duo": ("male", "female", "male"), "female_duo": ("female", "female", "female")}


def _middle() -> Column:
    """The middle of a word; its known edge, or 0, where one is missing."""
    both = (F.col("start_ms") + F.col("end_ms")) / 2
    return F.coalesce(both, F.nullif("start_ms", F.lit(0)), "end_ms", F.lit(0)).cast("double")


def _with_speakers(rows: DataFrame, diar: DataFrame, t: Column, max_gap_ms: int, within: tuple[Column, Column] | None = None) -> DataFrame:
    """Adds `assigned`: the speaker at the point t of each row: of the first interval that holds it, else of the nearest
    one within max_gap_ms; with `within`, only of intervals that overlap that span; null for rows of null t. Each row
    meets one row, the intervals of its time bucket as an array, so nothing has to be brought together again."""
    ivs = diar.select("video_id", "iv_no", F.col("speaker").alias("iv_speaker"), F.col("start_ms").alias("i0"), F.col("end_ms").alias("i1")).filter("i0 is not null and i1 is not null")
    ivs = ivs.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("i0") - max_gap_ms) / BUCKET_MS), F.floor(F.greatest(F.col("i0"), F.col("i1") + max_gap_ms) / BUCKET_MS))))
    ivs = ivs.groupBy("video_id", "bucket").agg(F.collect_list(F.struct("iv_no", "iv_speaker", "i0", "i1")).alias("ivs"))
    met = rows.withColumn("t", t).withColumn("bucket", F.floor(F.col("t") / BUCKET_MS)).join(ivs, ["video_id", "bucket"], "left")

    def fit(i: Column) -> Column:
        at = F.col("t")
        out = ~at.between(i["i0"], i["i1"])
        gap = F.when(out, F.least(F.abs(at - i["i0"]), F.abs(at - i["i1"]))).otherwise(0.0).cast("double")
        near = gap <= max_gap_ms if within is None else (gap <= max_gap_ms) & (i["i0"] < within[1]) & (i["i1"] > within[0])
        return F.when(near, F.struct(out.alias("out"), gap.alias("gap"), i["iv_no"].alias("iv_no"), i["iv_speaker"].alias("iv_speaker")))

    return met.select(*rows.columns, F.array_min(F.transform("ivs", fit))["iv_speaker"].alias("assigned"))


def apply_diarization(cands: DataFrame, turns: DataFrame, words: DataFrame, diar: DataFrame, max_gap_ms: int = 500) -> DataFrame:
    """Turns of candidates relabelled word by word from a new diarization: cand_no, turn_no (from 1, new), speaker, text,
    start_ms, end_ms, n_words.

    Only intervals that overlap a candidate count for it. Each word takes the speaker at its middle, else that of
    its turn; a turn without words takes the one at its own middle, else keeps its own. Neighbours of one speaker
    become one turn, cut and merged across the old ones; where a new turn has words, text and edges come from them.
    Candidates that no interval overlaps stay as they are."""
    ivs = diar.select("video_id", F.col("start_ms").alias("i0"), F.col("end_ms").alias("i1"))
    edges = cands.select(*CAND, F.col("start_ms").alias("c0"), F.col("end_ms").alias("c1"))
    touched = candidate_pairs(edges, ivs, (F.col("c0"), F.col("c1")), (F.col("i0"), F.col("i1"))).filter("i0 < c1 and i1 > c0")
    touched = touched.select(*CAND).distinct().withColumn("touched", F.lit(True))
    own = turns.select(*CAND, "turn_no", F.col("speaker").alias("own"), "text", F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1"))
    own = own.join(touched, CAND, "left").join(edges, CAND)
    rows = own.join(words.select(*CAND, "turn_no", "pos", "word", "start_ms", "end_ms"), [*CAND, "turn_no"], "left")
    # Words of touched candidates need no text of their turn, and that is most of them.
    rows = rows.withColumn("spoken", F.col("pos").isNotNull()).withColumn("pos", F.coalesce("pos", F.lit(0)))
    rows = rows.withColumn("text", F.when(~F.col("spoken") | F.col("touched").isNull(), F.col("text")))
    middle = F.when(F.col("spoken"), _middle()).otherwise((F.col("t0") + F.col("t1")) / 2)
    named = _with_speakers(rows, diar, F.when(F.col("touched"), middle), max_gap_ms, (F.col("c0"), F.col("c1"))).drop("c0", "c1")
    speaker = F.coalesce("assigned", "own", F.when(F.col("spoken"), F.lit("SPEAKER_00")))
    named = named.withColumn("speaker", speaker).withColumn("place", F.struct("turn_no", "pos"))
    order = Window.partitionBy(*CAND).orderBy("turn_no", "pos")
    new = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(order))
    untouched = F.col("touched").isNull() & (F.col("turn_no") != F.lag("turn_no").over(order))
    keep = F.when(F.col("touched").isNull(), F.coalesce(untouched, F.lit(True))).otherwise(new)
    runs = islands(named, CAND, ["turn_no", "pos"], keep, "new_no")
    return _new_turns(runs)


def _new_turns(runs: DataFrame) -> DataFrame:
    """A turn of each island new_no: from its words, or where it has none from its old turns."""
    spoken = lambda c: F.when(F.col("spoken"), c)
    runs = runs.withColumn("said", spoken(F.trim("word"))).withColumn("plain", F.when(~F.col("spoken"), F.col("text")))
    end = F.coalesce("end_ms", "start_ms")
    made = runs.groupBy(*CAND, "new_no").agg(
        F.min_by("speaker", "place").alias("speaker"),
        joined("place", "said").alias("said"),
        joined("place", "plain").alias("plain"),
        F.min_by(F.struct("start_ms"), spoken(F.col("place"))).alias("first"),
        F.max_by(F.struct(end.alias("end")), spoken(F.col("place"))).alias("last"),
        F.min_by("t0", "place").alias("t0"),
        F.max_by("t1", "place").alias("t1"),
        F.count_if("spoken").alias("n_words"),
        F.min_by("text", "place").alias("text"),
        F.bool_or(F.coalesce("touched", F.lit(False))).alias("touched"),
    )
    has = (F.col("n_words") > 0) & F.col("touched")
    text = F.when(~F.col("touched"), F.col("text")).when(has, F.col("said")).otherwise(F.col("plain"))
    start, stop = F.when(has, F.col("first.start_ms")).otherwise(F.col("t0")), F.when(has, F.col("last.end")).otherwise(F.col("t1"))
    return made.select(*CAND, F.col("new_no").cast("long").alias("turn_no"), "speaker", text.alias("text"), start.alias("start_ms"), stop.alias("end_ms"), "n_words")


def candidate_speakers(turns: DataFrame) -> DataFrame:
    """The sorted distinct speakers of each candidate."""
    return turns.groupBy(*CAND).agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))


def speakers_met(cands: DataFrame, turns: DataFrame, default: str = "speaker_0") -> DataFrame:
    """The speakers of each recording in the order they are met: candidate by candidate, first its `speakers` (an
    array), then its turns'; `default` where there is none. rank is from 0."""
    listed = cands.select("video_id", "cand_no", F.lit(0).alias("src"), F.posexplode("speakers").alias("at", "speaker"))
    spoken = turns.select("video_id", "cand_no", F.lit(1).alias("src"), F.col("turn_no").cast("int").alias("at"), "speaker")
    place = F.min(F.struct("cand_no", "src", "at")).alias("met")
    met = listed.unionByName(spoken).filter("speaker is not null and speaker <> ''").groupBy("video_id", "speaker").agg(place)
    none = cands.select("video_id").distinct().join(met.select("video_id"), "video_id", "left_anti")
    rank = (F.row_number().over(Window.partitionBy("video_id").orderBy("met", "speaker")) - 1).alias("rank")
    return met.select("video_id", "speaker", rank).unionByName(none.select("video_id", F.lit(default).alias("speaker"), F.lit(0).alias("rank")))


def voice_plan(speakers: DataFrame, preset: str, pools: dict[str, list[str]], genders: DataFrame | None = None, n_speakers: int = 0) -> DataFrame:
    """A voice for each speaker of speakers_met(), and one for `__default__`, the first speaker's.

    With n_speakers of two or more, SPEAKER_00 and on up to that number follow where they are not met. The preset
    gives each place its kind of voice (the last kind to all places beyond); in the mixed one a detected kind
    (genders: video_id, speaker, gender) goes before. Each kind goes round its own pool in order."""
    kinds = PRESETS.get(preset, PRESETS["male_duo"])
    if n_speakers >= 2:
        names = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f"SPEAKER_{i:02d}").alias("speaker")) for i in range(n_speakers)]))
        more = speakers.select("video_id").distinct().select("video_id", names.alias("x")).select("video_id", "x.speaker", "x.i")
        more = more.join(speakers.select("video_id", "speaker"), ["video_id", "speaker"], "left_anti")
        both = speakers.select("video_id", "speaker", F.lit(0).alias("added"), F.col("rank").alias("at"))
        both = both.unionByName(more.select("video_id", "speaker", F.lit(1).alias("added"), F.col("i").alias("at")))
        speakers = both.select("video_id", "speaker", (F.row_number().over(Window.partitionBy("video_id").orderBy("added", "at")) - 1).alias("rank"))
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), F.least(F.col("rank"), F.lit(len(kinds) - 1)).cast("int"))
    if genders is not None and preset == "mixed_duo":
        speakers = speakers.join(genders.select("video_id", "speaker", "gender"), ["video_id", "speaker"], "left")
        kind = F.when(F.col("gender").isin("male", "female"), F.col("gender")).otherwise(kind)
    rows = speakers.withColumn("kind", kind)
    turn = F.row_number().over(Window.partitionBy("video_id", "kind").orderBy("rank")) - 1
    pool = lambda k: F.get(F.array(*[F.lit(v) for v in pools[k]]), (F.col("turn") % len(pools[k])).cast("int"))
    rows = rows.withColumn("turn", turn).withColumn("voice", F.when(F.col("kind") == "female", pool("female")).otherwise(pool("male")))
    first = rows.filter("rank = 0").select("video_id", F.lit("__default__").alias("speaker"), "kind", "voice")
    return rows.select("video_id", "speaker", "kind", "voice").unionByName(first)


def match_boundaries(cands: DataFrame, sents: DataFrame) -> DataFrame:
    """The first and the last sentence (start_idx, end_idx: sent_no) of each candidate.

    By text: the first sentence that starts less than 10 s away and begins the candidate's text, and the last one
    from there on that starts from 1 s before it to 2 s after its end and ends the text. Where that gives no pair,
    by time: sentences that start from half a second before it to half a second after its end. Where there is none,
    the one of nearest start (the first of equals). White space is squeezed; sentences of one letter don't count."""
    squeezed = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\r\f]+", " "))
    side = cands.select(*CAND, squeezed(F.col("text")).alias("c_text"), F.col("start_ms").alias("c0"), F.col("end_ms").alias("c1"))
    rows = sents.select("video_id", "sent_no", squeezed(F.col("text")).alias("s_text"), F.col("start_ms").alias("s0"))
    pairs = candidate_pairs(side, rows, (F.col("c0") - 10_000, F.greatest("c1", "c0") + 10_000), (F.col("s0"), F.col("s0")))
    real = (F.length("s_text") >= 2) & (F.length("c_text") > 0)
    begins = real & (F.abs(F.col("s0") - F.col("c0")) < 10_000) & F.startswith("c_text", "s_text")
    ends = real & (F.col("s0") >= F.col("c0") - 1000) & (F.col("s0") <= F.col("c1") + 2000) & F.endswith("c_text", "s_text")
    inside = (F.col("s0") >= F.col("c0") - 500) & (F.col("s0") < F.col("c1") + 500)
    first = F.min(F.when(begins, F.col("sent_no"))).over(Window.partitionBy(*CAND))
    pairs = pairs.withColumn("first", first)
    last = F.max(F.when(ends & (F.col("sent_no") >= F.coalesce("first", F.col("sent_no"))), F.col("sent_no")))
    found = pairs.groupBy(*CAND).agg(F.min("first").alias("a"), last.alias("b"), F.min(F.when(inside, F.col("sent_no"))).alias("t_a"), F.max(F.when(inside, F.col("sent_no"))).alias("t_b"))
    by_text = F.col("a").isNotNull() & F.col("b").isNotNull()
    start, end = F.when(by_text, F.col("a")).otherwise(F.col("t_a")), F.when(by_text, F.col("b")).otherwise(F.col("t_b"))
    rest = cands.select(*CAND, "start_ms").join(found, CAND, "left").withColumn("start_idx", start).withColumn("end_idx", end)
    left = rest.filter("start_idx is null").select("video_id", F.col("cand_no").alias("sent_no"), "start_ms")
    near = match_by_start(left, sents.select("video_id", F.col("sent_no").alias("seg_no"), "start_ms"), exact=False)
    near = near.select("video_id", F.col("sent_no").alias("cand_no"), F.col("seg_no").alias("near"))
    out = rest.join(near, CAND, "left").select(*CAND, F.coalesce("start_idx", "near").alias("start_idx"), F.coalesce("end_idx", "near").alias("end_idx"))
    return out.withColumn("end_idx", F.greatest("start_idx", "end_idx"))


def _tokens(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != "")


def rebuild_from_sentences(edits: DataFrame, sentences: DataFrame, segs: DataFrame, words: DataFrame, diar: DataFrame | None = None) -> DataFrame:
    """Turns of edited candidates from the sentences (cand_no, sent_no, text, start_ms, end_ms, speaker) an editor
    sends: cand_no, turn_no, speaker, text (of the original), text_tr (of the sentences), start_ms, end_ms.

    The words within the edit and the sentence tell who speaks: the speaker at the word's middle (with diar), else
    of the word's segment, else of the sentence, else SPEAKER_00. Runs of one speaker share the sentence's text in
    proportion to the time they speak, a word each at the least, the last takes the rest; a run for which none is
    left has all of it. Sentences without words are one turn, with the original of the segment at the same start
    (else of nearest start), else with their own text. Neighbours of one speaker are merged. A word that two
    sentences overlap counts in both. Sentences without text are left out."""
    own = sentences.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    own = own.select(*CAND, "sent_no", F.trim("text").alias("tr"), F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"), F.col("speaker").alias("s_speaker"))
    own = own.join(edits.select(*CAND, F.col("start_ms").alias("c0"), F.col("end_ms").alias("c1")), CAND)
    tagged = words.select("video_id", "word_no", "word", "start_ms", "end_ms", F.col("speaker").alias("w_speaker"))
    tagged = tagged.withColumn("assigned", F.lit(None).cast("string")) if diar is None else _with_speakers(tagged, diar, _middle(), 500)
    pairs = candidate_pairs(tagged, own.drop("tr"), (F.col("start_ms"), F.col("end_ms")), (F.col("s0"), F.col("s1")))
    pairs = pairs.filter("end_ms > s0 and start_ms < s1 and end_ms > c0 and start_ms < c1")
    given = [F.nullif(F.col(c), F.lit("")) for c in ("assigned", "w_speaker", "s_speaker")]
    pairs = pairs.select(*CAND, "sent_no", "word_no", "word", "start_ms", "end_ms", F.coalesce(*given, F.lit("SPEAKER_00")).alias("speaker"))
    sent = [*CAND, "sent_no"]
    order = Window.partitionBy(*sent).orderBy("start_ms", "word_no")
    runs = islands(pairs, sent, ["start_ms", "word_no"], F.col("speaker") != F.lag("speaker").over(order), "run").withColumn("place", F.struct("start_ms", "word_no")).withColumn("said", F.trim("word"))
    groups = runs.groupBy(*sent, "run").agg(
        F.min_by("speaker", "place").alias("speaker"), joined("place", "said").alias("said"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("d"),
        F.min_by("start_ms", "place").alias("start_ms"), F.max_by("end_ms", "place").alias("end_ms"),
    ).join(own.select(*sent, "tr"), sent)
    whole = Window.partitionBy(*sent)
    line = whole.orderBy("run")
    groups = groups.withColumn("tokens", _tokens("tr")).withColumn("n_runs", F.count("*").over(whole)).withColumn("all", F.sum("d").over(whole))
    share = F.when(F.col("all") != 0, F.col("d") / F.col("all")).otherwise(F.lit(0.0))
    groups = groups.withColumn("n", F.greatest(F.lit(1), F.bround(F.size("tokens") * share, 0).cast("int")))
    groups = groups.withColumn("skip", F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    taken = F.when(F.col("run") == F.col("n_runs"), F.size("tokens")).otherwise(F.col("n"))
    part = F.array_join(F.slice("tokens", F.col("skip") + 1, taken), " ")
    text_tr = F.when((F.col("n_runs") == 1) | (part == ""), F.col("tr")).otherwise(part)
    spoken = groups.select(*sent, "run", "speaker", "said", text_tr.alias("text_tr"), "start_ms", "end_ms")
    # Every sentence needs its segment: for runs of silent words and for those without words.
    numbered = own.withColumn("q", F.xxhash64("cand_no", "sent_no"))
    match = match_by_start(numbered.select("video_id", F.col("q").alias("sent_no"), F.col("s0").alias("start_ms")).distinct(), segs.select("video_id", "seg_no", "start_ms"))
    original = match.join(segs.select("video_id", "seg_no", F.col("text").alias("original")), ["video_id", "seg_no"], "left").select("video_id", F.col("sent_no").alias("q"), "original")
    original = numbered.join(original, ["video_id", "q"], "left").select(*sent, "tr", "s_speaker", "s0", "s1", F.coalesce(F.nullif("original", F.lit("")), "tr").alias("original"))
    joined_ = original.join(spoken, sent, "left")
    speaker = F.coalesce("speaker", F.nullif("s_speaker", F.lit("")), F.lit("SPEAKER_00"))
    rows = joined_.select(
        *CAND, "sent_no", F.coalesce("run", F.lit(0)).alias("run"), speaker.alias("speaker"), F.coalesce(F.nullif("said", F.lit("")), "original").alias("text"),
        F.coalesce("text_tr", "tr").alias("text_tr"), F.coalesce("start_ms", "s0").alias("start_ms"), F.coalesce("end_ms", "s1").alias("end_ms"),
    )
    return _merged(rows, ["sent_no", "run"])


def rebuild_from_segments(edits: DataFrame, segs: DataFrame, diar: DataFrame | None = None, translated: str = "text_tr") -> DataFrame:
    """Turns of edited candidates without sentences: the segments that overlap the new range, cut to it, with their
    translation if there is one and the speaker of the interval that overlaps the segment the most, if any does."""
    named = assign_speaker_max(segs, diar, ["seg_no"], "") if diar is not None else segs.withColumn("assigned", F.lit(""))
    text = F.trim(F.coalesce(F.nullif(F.col(translated), F.lit("")), "text", F.lit("")))
    speaker = F.coalesce(F.nullif("assigned", F.lit("")), "speaker", F.lit("SPEAKER_00"))
    side = named.select("video_id", "seg_no", text.alias("text"), speaker.alias("speaker"), F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"))
    ranges = edits.select(*CAND, F.col("start_ms").alias("c0"), F.col("end_ms").alias("c1"))
    pairs = candidate_pairs(side, ranges, (F.col("s0"), F.col("s1")), (F.col("c0"), F.col("c1"))).filter("s1 > c0 and s0 < c1")
    rows = pairs.select(*CAND, "seg_no", "speaker", "text", F.col("text").alias("text_tr"), F.greatest("s0", "c0").alias("start_ms"), F.least("s1", "c1").alias("end_ms"))
    return _merged(rows, ["seg_no"])


def _merged(rows: DataFrame, order: list[str]) -> DataFrame:
    """Neighbours of one speaker within a candidate as one turn, numbered from 1."""
    w = Window.partitionBy(*CAND).orderBy(*order)
    runs = islands(rows, CAND, order, F.col("speaker") != F.lag("speaker").over(w), "turn_no").withColumn("place", F.struct(*order))
    return runs.groupBy(*CAND, F.col("turn_no").cast("long").alias("turn_no")).agg(
        F.min_by("speaker", "place").alias("speaker"), joined("place", "text").alias("text"), joined("place", "text_tr").alias("text_tr"),
        F.min_by("start_ms", "place").alias("start_ms"), F.max_by("end_ms", "place").alias("end_ms"),
    )
