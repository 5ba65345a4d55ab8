"""Turns, words and their order: merging, splitting, phrases, gaps, and statistics of speakers.

Orders are total (`turn_no`, `word_no`, `seg_no`), so ties never depend on how rows are dealt. Everything groups by
video_id or finer; a recording is at most two hours long, so a group is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.spans import overlap_ms


def joined(order: str, value: str, sep: str = " ") -> Column:
    """Aggregate: values in order, joined; null and empty ones are skipped."""
    rows = F.array_sort(F.collect_list(F.when(F.coalesce(F.col(value), F.lit("")) != "", F.struct(F.col(order), F.col(value)))))
    return F.array_join(F.transform(rows, lambda r: r[value]), sep)


def islands(df: DataFrame, partition: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: `starts` says that a row begins a new one; the first row always does."""
    w = Window.partitionBy(*partition).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_new", (first | F.coalesce(starts, F.lit(False))).cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _runs_of_speakers(turns: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return islands(turns, keys, order, ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)))


def merge_turns(turns: DataFrame) -> DataFrame:
    """Neighbouring turns of one speaker as one: turn_no of the first, text joined, end of the last. Their words are
    those of merged_words()."""
    runs = _runs_of_speakers(turns, ["video_id"], ["turn_no"])
    return runs.groupBy("video_id", "island").agg(
        F.min("turn_no").alias("turn_no"), F.min_by("speaker", "turn_no").alias("speaker"), joined("turn_no", "text").alias("text"),
        F.min_by("start_ms", "turn_no").alias("start_ms"), F.max_by("end_ms", "turn_no").alias("end_ms"), F.count("*").alias("n_turns"),
    ).drop("island")


def merged_words(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Words (turn_no, pos) under the turns that merge_turns() makes of `turns`: turn_no of the merged turn, pos counted
    on from turn to turn."""
    runs = _runs_of_speakers(turns, ["video_id"], ["turn_no"])
    into = runs.select("video_id", "turn_no", F.min("turn_no").over(Window.partitionBy("video_id", "island")).alias("into"))
    order = Window.partitionBy("video_id", "into").orderBy("turn_no", "pos")
    rows = words.join(into, ["video_id", "turn_no"]).withColumn("new_pos", F.row_number().over(order).cast("long"))
    return rows.withColumn("turn_no", F.col("into")).withColumn("pos", F.col("new_pos")).drop("into", "new_pos")


def join_turns(turns: DataFrame, into: DataFrame, key: str) -> DataFrame:
    """Turns (key, turn_no) of chunks or candidates that were merged (into: key, into): key of the merged one, neighbours of
    one speaker joined as in merge_turns(), numbered from 1."""
    rows = turns.join(into.select("video_id", key, "into"), ["video_id", key])
    runs = _runs_of_speakers(rows, ["video_id", "into"], [key, "turn_no"]).withColumn("place", F.struct(key, "turn_no"))
    return runs.groupBy("video_id", F.col("into").alias(key), F.col("island").cast("long").alias("turn_no")).agg(
        F.min_by("speaker", "place").alias("speaker"), joined("place", "text").alias("text"),
        F.min_by("start_ms", "place").alias("start_ms"), F.max_by("end_ms", "place").alias("end_ms"),
    )


def split_turns_by_word_speaker(words: DataFrame, word_speaker: str) -> DataFrame:
    """Turns cut where the speaker of words changes; a null one is the turn's, else SPEAKER_00."""
    own = words.withColumn("ws", F.coalesce(word_speaker, "speaker", F.lit("SPEAKER_00")))
    w = Window.partitionBy("video_id", "turn_no").orderBy("pos")
    runs = islands(own, ["video_id", "turn_no"], ["pos"], F.col("ws") != F.lag("ws").over(w))
    return runs.groupBy("video_id", "turn_no", "island").agg(F.min_by("ws", "pos").alias("speaker"), joined("pos", "word").alias("text"), F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.count("*").alias("n_words")).withColumnRenamed("island", "part")


def refine_turn_edges(turns: DataFrame, words: DataFrame) -> DataFrame:
    """Turn edges from the earliest and latest word; turns without timed words keep theirs."""
    edges = words.groupBy("video_id", "turn_no").agg(F.min("start_ms").alias("ws"), F.max("end_ms").alias("we"))
    return turns.join(edges, ["video_id", "turn_no"], "left").withColumn("start_ms", F.coalesce("ws", "start_ms")).withColumn("end_ms", F.coalesce("we", "end_ms")).drop("ws", "we")


def phrases(words: DataFrame, pause_ms: int = 400, need_end: bool = True, partition: tuple[str, ...] = ("video_id", "turn_no")) -> DataFrame:
    """Words cut into phrases. With need_end: after a word that ends with one of .!?;: and a pause of at least
    pause_ms; without: after a pause longer than pause_ms. Gives duration (100 ms at least) and the pause after
    (0 for the last phrase)."""
    keys = list(partition)
    w = Window.partitionBy(*keys).orderBy("pos")
    gap = F.col("start_ms") - F.lag("end_ms").over(w)
    cut = (gap >= pause_ms) & F.lag("word").over(w).rlike("[.!?;:]$") if need_end else gap > pause_ms
    runs = islands(words, keys, ["pos"], cut).groupBy(*keys, "island").agg(joined("pos", "word").alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"))
    following = F.lead("start_ms").over(Window.partitionBy(*keys).orderBy("island"))
    return runs.withColumn("duration_ms", F.greatest(F.lit(100), F.col("end_ms") - F.col("start_ms"))).withColumn("pause_after", F.coalesce(F.greatest(F.lit(0), following - F.col("end_ms")), F.lit(0))).withColumnRenamed("island", "phrase_no")


def transcript_gaps(sents: DataFrame, min_ms: int = 2000) -> DataFrame:
    """Silences between sentences longer than min_ms, in seconds of one decimal."""
    w = Window.partitionBy("video_id").orderBy("start_ms", "seg_no")
    gap = F.col("start_ms") - F.col("from_ms")
    return sents.withColumn("from_ms", F.lag("end_ms").over(w)).filter(gap > min_ms).select("video_id", "from_ms", F.col("start_ms").alias("to_ms"), F.bround(gap / 1000.0, 1).alias("gap_s"))


def turn_gaps(turns: DataFrame) -> DataFrame:
    """Adds gap_ms: silence before each turn, 0 for the first and for overlaps."""
    before = F.lag("end_ms").over(Window.partitionBy("video_id").orderBy("turn_no"))
    return turns.withColumn("gap_ms", F.coalesce(F.greatest(F.lit(0), F.col("start_ms") - before), F.lit(0)))


def trim_dead_start(cands: DataFrame, turns: DataFrame, min_lead_ms: int = 1500, keep_ms: int = 300) -> DataFrame:
    """Candidates whose first speech comes min_lead_ms or more after their start begin keep_ms before it."""
    first = turns.filter("start_ms is not null").groupBy("video_id", "cand_no").agg(F.min_by("start_ms", "turn_no").alias("first"))
    late = F.col("first") - F.col("start_ms") >= min_lead_ms
    start = F.when(late, F.greatest(F.col("start_ms"), F.col("first") - keep_ms)).otherwise(F.col("start_ms"))
    return cands.join(first, ["video_id", "cand_no"], "left").withColumn("start_ms", start).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")).drop("first")


def attach_context(cands: DataFrame, durations: DataFrame) -> DataFrame:
    """Texts before (100 words) and after (80 words) each candidate, and whether it opens or closes the recording."""
    w = Window.partitionBy("video_id").orderBy("cand_no")

    def cut(text: Column, n: int) -> Column:
        parts = F.split(F.trim(text), r"[ \t\n\r\f]+")
        return F.when(F.coalesce(text, F.lit("")) == "", "Unknown").when(F.size(parts) > n, F.concat(F.array_join(F.slice(parts, 1, n), " "), F.lit("..."))).otherwise(text)

    first, last = F.lag("cand_no").over(w).isNull(), F.lead("cand_no").over(w).isNull()
    return cands.join(durations, "video_id").select("video_id", "cand_no", cut(F.lag("text").over(w), 100).alias("previous_text"), cut(F.lead("text").over(w), 80).alias("next_text"), (first & (F.col("start_ms") < 5000)).alias("is_start"), (last & (F.col("duration_ms") - F.col("end_ms") < 5000)).alias("is_end"), F.coalesce("speaker", F.lit("Unknown")).alias("primary_speaker"))


def build_chunks(segs: DataFrame, chunk: str, words: DataFrame | None = None) -> DataFrame:
    """One row per chunk: edges, joined text, distinct speakers (an array) in the order they first speak and, with the
    words of segments (seg_no, pos, word, start_ms, end_ms), these in order as an array. Its turns: chunk_turns()."""
    order = F.struct("seg_no", "speaker")
    speakers = F.array_distinct(F.transform(F.array_sort(F.collect_list(order)), lambda r: r["speaker"]))
    made = segs.groupBy("video_id", chunk).agg(
        F.min_by("start_ms", "seg_no").alias("start_ms"), F.max_by("end_ms", "seg_no").alias("end_ms"), joined("seg_no", "text").alias("text"), speakers.alias("speakers")
    )
    if words is None:
        return made
    own = words.join(segs.select("video_id", "seg_no", chunk), ["video_id", "seg_no"])
    listed = F.array_sort(F.collect_list(F.struct("seg_no", "pos", "word", "start_ms", "end_ms")))
    return made.join(own.groupBy("video_id", chunk).agg(listed.alias("words")), ["video_id", chunk], "left")


def chunk_turns(segs: DataFrame, chunk: str, words: DataFrame) -> DataFrame:
    """The dialogue of each chunk: neighbouring segments of one speaker as one turn (turn_no is the first seg_no), with
    the edges of its words, where it has timed ones."""
    runs = _runs_of_speakers(segs, ["video_id", chunk], ["seg_no"])
    runs = runs.withColumn("turn_no", F.min("seg_no").over(Window.partitionBy("video_id", chunk, "island")))
    made = runs.groupBy("video_id", chunk, "turn_no").agg(
        F.min_by("speaker", "seg_no").alias("speaker"), joined("seg_no", "text").alias("text"),
        F.min_by("start_ms", "seg_no").alias("start_ms"), F.max_by("end_ms", "seg_no").alias("end_ms"),
    )
    own = words.join(runs.select("video_id", "seg_no", "turn_no"), ["video_id", "seg_no"])
    return refine_turn_edges(made, own.select("video_id", "turn_no", "start_ms", "end_ms"))


def speaker_stats(segs: DataFrame) -> DataFrame:
    """Per recording and speaker: segments, words, total, shortest, longest and mean duration, share of speech."""
    d = F.col("end_ms") - F.col("start_ms")
    words = F.size(F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != ""))
    own = segs.groupBy("video_id", "speaker").agg(F.count("*").alias("n_segments"), F.sum(words).alias("n_words"), F.sum(d).alias("total_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"), F.round(F.avg(d), 3).alias("avg_ms"))
    return own.withColumn("share_pct", F.round(F.col("total_ms") * 100 / F.sum("total_ms").over(Window.partitionBy("video_id")), 4))


def diar_quality(diar: DataFrame, durations: DataFrame, expected: int = 2) -> DataFrame:
    """Flags per recording: very short intervals, one speaker with over 90 % among several, over five speakers,
    a single one where more are expected, and speech over total time."""
    d = F.col("end_ms") - F.col("start_ms")
    by = diar.groupBy("video_id", "speaker").agg(F.sum(d).alias("t"), F.count(F.when(d < 300, 1)).alias("short"))
    all_ = by.groupBy("video_id").agg(F.sum("short").alias("n_short"), F.count("*").alias("n_speakers"), F.sum("t").alias("speech"), F.max("t").alias("top"))
    return all_.join(durations, "video_id", "left").select("video_id", "n_short", "n_speakers", ((F.col("n_speakers") > 1) & (F.col("top") > 0.9 * F.col("speech"))).alias("dominated"), (F.col("n_speakers") > 5).alias("too_many"), ((F.col("n_speakers") == 1) & F.lit(expected > 1)).alias("single"), F.round(F.col("speech") / F.col("duration_ms"), 6).alias("speech_ratio"))


def talk_share(cands: DataFrame, turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per candidate: the speaker with the most time inside it (of equals the one met first) and that share.
    pairs: video_id, cand_no, range edges r_start, r_end, and turns' turn_no, speaker, start_ms, end_ms."""
    t = overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end"))
    by = pairs.withColumn("t", t).filter("t > 0").groupBy("video_id", "cand_no", "speaker").agg(F.sum("t").alias("t"), F.min("turn_no").alias("met"))
    return by.groupBy("video_id", "cand_no").agg(F.max_by("speaker", F.struct("t", -F.col("met"))).alias("primary_speaker"), F.round(F.max("t") * 100 / F.sum("t"), 4).alias("share_pct"))


def speakers_in_order(turns: DataFrame) -> DataFrame:
    """Distinct speakers of each recording in order of appearance; rank from 0."""
    met = turns.filter("speaker is not null").groupBy("video_id", "speaker").agg(F.min("turn_no").alias("met"))
    return met.select("video_id", "speaker", (F.row_number().over(Window.partitionBy("video_id").orderBy("met", "speaker")) - 1).alias("rank"))


def speech_rate(words: DataFrame) -> DataFrame:
    """Words a second of each turn, within 1 to 5; 140 a minute for under two words or 0.1 s."""
    n, d = F.count("*"), (F.max_by("end_ms", "pos") - F.min_by("start_ms", "pos")) / 1000.0
    own = words.groupBy("video_id", "turn_no").agg(n.alias("n"), d.alias("d"))
    return own.select("video_id", "turn_no", F.round(F.when((F.col("n") < 2) | (F.col("d") <= 0.1), 140 / 60).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.col("n") / F.col("d")))), 6).alias("words_per_s"))


def voice_rate(turns: DataFrame) -> DataFrame:
    """Words a second of each speaker over turns of at least 0.1 s with words, within 1.5 to 4; default 2.5."""
    n = F.size(F.filter(F.split(F.regexp_replace("text", r"\[[A-Za-z0-9_]+\] ?", ""), r"[ \t\n\r\f]+"), lambda w: w != ""))
    d = F.col("end_ms") - F.col("start_ms")
    ok = (d >= 100) & (n > 0)
    own = turns.groupBy("video_id", "speaker").agg(F.sum(F.when(ok, n)).alias("n"), F.sum(F.when(ok, d)).alias("d"))
    return own.select("video_id", "speaker", F.round(F.coalesce(F.greatest(F.lit(1.5), F.least(F.lit(4.0), F.col("n") * 1000 / F.col("d"))), F.lit(2.5)), 6).alias("words_per_s"))


def min_highlights(segs: DataFrame) -> DataFrame:
    """Duration of each recording (end of its last segment) and 3 + one highlight for each 20 minutes."""
    return segs.groupBy("video_id").agg(F.max_by("end_ms", "seg_no").alias("duration_ms")).withColumn("n_min", (3 + F.floor(F.greatest(F.lit(0), F.col("duration_ms")) / 1_200_000)).cast("int"))


def timing_coverage(timing: DataFrame) -> DataFrame:
    """Share of turns with at least 0.1 s of timing, whether it is enough (0.7), and the turns without."""
    ok = F.coalesce(F.col("tts_end") - F.col("tts_start") >= 100, F.lit(False))
    return timing.groupBy("video_id").agg(F.round(F.avg(ok.cast("int")), 6).alias("coverage"), (F.avg(ok.cast("int")) >= 0.7).alias("valid"), F.array_join(F.array_sort(F.collect_list(F.when(~ok, F.col("turn_no")))), ",").alias("missing"))


def timing_quality(words: DataFrame) -> DataFrame:
    """Whether word timings of a recording are acceptable. Of each turn with a span, the words but the last count:
    fast under 150 ms; a bunch begins at a fast word that is followed within 50 ms, unless the gap before it was
    as short. Poor: fast over 0.3 of words, bunches over half the turns, or bad turns over 0.6 of them."""
    w = Window.partitionBy("video_id", "turn_no").orderBy("pos")
    d, gap = F.col("end_ms") - F.col("start_ms"), F.lead("start_ms").over(w) - F.col("end_ms")
    rows = words.withColumn("fast", d < 150).withColumn("gap", gap)
    rows = rows.withColumn("bunch", F.col("fast") & (F.col("gap") < 50) & (F.coalesce(F.lag("gap").over(w), F.lit(50)) >= 50)).filter("gap is not null")
    turn = rows.groupBy("video_id", "turn_no").agg(F.count("*").alias("n"), F.count(F.when(F.col("fast"), 1)).alias("fast"), F.count(F.when(F.col("bunch"), 1)).alias("bunches"))
    spans = words.groupBy("video_id", "turn_no").agg((F.max("end_ms") > F.min("start_ms")).alias("real"))
    own = spans.join(turn, ["video_id", "turn_no"], "left").fillna(0, ["n", "fast", "bunches"])
    live = lambda c: F.sum(F.when(F.col("real"), F.col(c)).otherwise(0))
    bad = F.sum(F.when(F.col("real") & ((F.col("fast") > 0.3 * F.col("n")) | (F.col("bunches") > 0)), 1).otherwise(0))
    all_ = own.groupBy("video_id").agg(live("n").alias("n_words"), live("fast").alias("n_fast"), live("bunches").alias("n_bunches"), bad.alias("n_bad"), F.count("*").alias("n_turns"))
    poor = (F.col("n_fast") > 0.3 * F.col("n_words")) | (F.col("n_bunches") > 0.5 * F.col("n_turns")) | (F.col("n_bad") > 0.6 * F.col("n_turns")) | (F.col("n_words") == 0)
    return all_.withColumn("acceptable", ~poor)


def sync_report(timing: DataFrame) -> DataFrame:
    """Turns, those with timing of 0.1 s, and how many neighbours overlap and by how much."""
    w = Window.partitionBy("video_id").orderBy("turn_no")
    over = F.greatest(F.lit(0), F.lag("tts_end").over(w) - F.col("tts_start"))
    return timing.withColumn("over", over).groupBy("video_id").agg(F.count("*").alias("n_turns"), F.count(F.when(F.col("tts_end") - F.col("tts_start") >= 100, 1)).alias("n_timed"), F.count(F.when(F.col("over") > 0, 1)).alias("n_overlaps"), F.coalesce(F.sum("over"), F.lit(0)).alias("overlap_ms"))


def allocate_samples(shares: DataFrame, n: int) -> DataFrame:
    """n samples over the speakers of a recording: one each, the rest by whole shares of talk time."""
    w = Window.partitionBy("video_id")
    left = F.greatest(F.lit(0), F.lit(n) - F.count("*").over(w))
    return shares.withColumn("n_samples", (1 + F.floor(F.col("total_ms") / F.sum("total_ms").over(w) * left)).cast("int"))


def dub_summary(turns: DataFrame) -> DataFrame:
    """Per candidate: speech time, target words, natural time at 1.8 words a second, tempo and overflow past 1.25."""
    n = F.size(F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != ""))
    own = turns.groupBy("video_id", "cand_no").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.sum(n).alias("n_words"))
    tempo = F.col("n_words") / 1.8 * 1000 / F.col("speech_ms")
    return own.withColumn("natural_s", F.round(F.col("n_words") / 1.8, 6)).withColumn("tempo", F.round(tempo, 6)).withColumn("overflow", tempo > 1.25)
