"""Joins of points and spans with intervals of the same recording.

All of them go through candidate_pairs(): both sides are laid on time buckets and joined on (video_id, bucket),
so the work follows the number of pairs that lie near one another, not the square of a recording's length.
Intervals carry `iv_no`, their order, which decides ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.spans import overlap_ms

BUCKET_MS = 10_000


def _bucketed(df: DataFrame, start: Column, end: Column, size: int, prefix: str) -> DataFrame:
    first, last = F.floor(start / size), F.floor(F.greatest(start, end) / size)
    return df.withColumn(f"{prefix}_first", first).withColumn("bucket", F.explode(F.sequence(first, last)))


def candidate_pairs(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of rows of one video_id whose spans share a bucket, each pair once. Column names must differ but for
    video_id; rows of null bounds pair with nothing. The caller applies the exact condition."""
    a = _bucketed(left.filter(left_span[0].isNotNull() & left_span[1].isNotNull()), *left_span, bucket_ms, "a")
    b = _bucketed(right.filter(right_span[0].isNotNull() & right_span[1].isNotNull()), *right_span, bucket_ms, "b")
    pairs = a.join(b, ["video_id", "bucket"])
    return pairs.filter(F.col("bucket") == F.greatest("a_first", "b_first")).drop("bucket", "a_first", "b_first")


def _intervals(diar: DataFrame) -> DataFrame:
    return diar.select("video_id", F.col("iv_no"), F.col("speaker").alias("iv_speaker"), F.col("start_ms").alias("iv_start"), F.col("end_ms").alias("iv_end"))


def _span_pairs(spans: DataFrame, diar: DataFrame, keys: list[str]) -> DataFrame:
    side = spans.select("video_id", *keys, F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    pairs = candidate_pairs(side, _intervals(diar), (F.col("s"), F.col("e")), (F.col("iv_start"), F.col("iv_end")))
    return pairs.withColumn("overlap", overlap_ms(F.col("s"), F.col("e"), F.col("iv_start"), F.col("iv_end"))).filter("overlap > 0")


def assign_speaker_max(spans: DataFrame, diar: DataFrame, keys: list[str], default: str = "UNKNOWN") -> DataFrame:
    """Adds `assigned`: the speaker of the one interval that overlaps a span the most, the first of equals."""
    best = _span_pairs(spans, diar, keys).groupBy("video_id", *keys).agg(F.max_by("iv_speaker", F.struct("overlap", -F.col("iv_no"))).alias("assigned"))
    return spans.join(best, ["video_id", *keys], "left").withColumn("assigned", F.coalesce("assigned", F.lit(default)))


def assign_speaker_dominant(spans: DataFrame, diar: DataFrame, keys: list[str], default: str = "SPEAKER_UNKNOWN") -> DataFrame:
    """Adds `assigned`: the speaker with the largest summed overlap; of equals the one met first."""
    by_speaker = _span_pairs(spans, diar, keys).groupBy("video_id", *keys, "iv_speaker").agg(F.sum("overlap").alias("total"), F.min("iv_no").alias("met"))
    best = by_speaker.groupBy("video_id", *keys).agg(F.max_by("iv_speaker", F.struct("total", -F.col("met"))).alias("assigned"))
    return spans.join(best, ["video_id", *keys], "left").withColumn("assigned", F.coalesce("assigned", F.lit(default)))


def _at_points(points: DataFrame, diar: DataFrame, keys: list[str], at: Column, widen: int = 0) -> DataFrame:
    side = points.select("video_id", *keys, at.alias("t"))
    return candidate_pairs(side, _intervals(diar), (F.col("t"), F.col("t")), (F.col("iv_start") - widen, F.col("iv_end") + widen))


def assign_word_speaker_mid(words: DataFrame, diar: DataFrame, keys: list[str], fallback: str = "speaker") -> DataFrame:
    """Adds `assigned`: the speaker of the first interval that holds the word's middle, edges included, else the
    word's own `fallback` column."""
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    hits = _at_points(words, diar, keys, mid).filter("t between iv_start and iv_end").groupBy("video_id", *keys).agg(F.min_by("iv_speaker", "iv_no").alias("assigned"))
    return words.join(hits, ["video_id", *keys], "left").withColumn("assigned", F.coalesce("assigned", fallback))


def nearest_interval(points: DataFrame, diar: DataFrame, keys: list[str], at: Column, max_gap_ms: int = 500) -> DataFrame:
    """Adds `assigned`: the speaker of the first interval that holds the point, else of the interval with the
    nearest edge within max_gap_ms (the first of equals), else null."""
    t, s, e = F.col("t"), F.col("iv_start"), F.col("iv_end")
    inside = (t >= s) & (t <= e)
    gap = F.when(inside, 0.0).otherwise(F.least(F.abs(t - s), F.abs(t - e)).cast("double"))
    near = _at_points(points, diar, keys, at, max_gap_ms).withColumn("gap", gap).filter(F.col("gap") <= max_gap_ms)
    best = near.groupBy("video_id", *keys).agg(F.min_by("iv_speaker", F.struct((~inside).alias("out"), "gap", "iv_no")).alias("assigned"))
    return points.join(best, ["video_id", *keys], "left")


def overlay_speakers(turns: DataFrame, new_ivs: DataFrame, keys: list[str]) -> DataFrame:
    """Replaces `speaker` by that of the last interval in order with start <= turn start < end."""
    hits = _at_points(turns, new_ivs, keys, F.col("start_ms")).filter("t >= iv_start and t < iv_end").groupBy("video_id", *keys).agg(F.max_by("iv_speaker", "iv_no").alias("new"))
    return turns.join(hits, ["video_id", *keys], "left").withColumn("speaker", F.coalesce("new", "speaker")).drop("new")


def words_in_range(words: DataFrame, ranges: DataFrame, range_key: str, word_keys: list[str]) -> DataFrame:
    """Words that overlap each range: video_id, range_key, word_keys, word times."""
    side = ranges.select("video_id", range_key, F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    pairs = candidate_pairs(words.select("video_id", *word_keys, "start_ms", "end_ms"), side, (F.col("start_ms"), F.col("end_ms")), (F.col("r_start"), F.col("r_end")))
    return pairs.filter("start_ms < r_end and end_ms > r_start").drop("r_start", "r_end")


def segments_in_bounds(segs: DataFrame, bounds: DataFrame, tolerance_ms: int = 500, lossless: bool = False) -> DataFrame:
    """Segments within each chunk [b0, b1] with a tolerance at both ends. A segment that straddles a bound by more
    lies in no chunk, unless lossless, which places it by its middle; one within it can lie in two."""
    side = bounds.select("video_id", "chunk_no", F.col("start_ms").alias("b0"), F.col("end_ms").alias("b1"))
    pairs = candidate_pairs(segs, side, (F.col("start_ms"), F.col("end_ms")), (F.col("b0") - tolerance_ms, F.col("b1") + tolerance_ms), 30_000)
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    within = (F.col("start_ms") >= F.col("b0") - tolerance_ms) & (F.col("end_ms") <= F.col("b1") + tolerance_ms)
    if not lossless:
        return pairs.filter(within).drop("b0", "b1")
    home = F.row_number().over(Window.partitionBy("video_id", "seg_no").orderBy("chunk_no"))
    return pairs.filter((mid >= F.col("b0")) & (mid <= F.col("b1"))).withColumn("n", home).filter("n = 1").drop("n", "b0", "b1")


def speaker_by_change_times(turns: DataFrame, times: Column, n_speakers: int) -> DataFrame:
    """Adds `speaker_index`: how many change times are at or before the turn's start, n_speakers - 1 at most."""
    passed = F.size(F.filter(times, lambda t: t <= F.col("start_ms")))
    return turns.withColumn("speaker_index", F.least(passed, F.lit(n_speakers - 1)))


def speaker_at(points: DataFrame, turns: DataFrame, keys: list[str], at: Column, grid_ms: int = 100) -> DataFrame:
    """Adds `assigned`: the speaker on a time grid at the point's rounded place; later turns overwrite."""
    cell = lambda c: F.floor(c / grid_ms)
    side = turns.select("video_id", F.col("turn_no"), F.col("speaker").alias("iv_speaker"), (cell(F.col("start_ms")) * grid_ms).alias("iv_start"), (cell(F.col("end_ms")) * grid_ms).alias("iv_end"))
    asked = points.select("video_id", *keys, (F.bround(at / grid_ms, 0).cast("long") * grid_ms).alias("t"))
    hits = candidate_pairs(asked, side, (F.col("t"), F.col("t")), (F.col("iv_start"), F.col("iv_end"))).filter("t between iv_start and iv_end")
    best = hits.groupBy("video_id", *keys).agg(F.max_by("iv_speaker", "turn_no").alias("assigned"))
    return points.join(best, ["video_id", *keys], "left")


def words_to_turns(words: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `turn`: the first turn that holds the word's middle, else the turn with the nearest edge at any
    distance (the lower number of equals). Empty words and those without length are dropped.

    Leftover words meet turn edges on one sorted line: only the nearest edge on either side can win."""
    live = words.filter("trim(word) <> '' and end_ms > start_ms").withColumn("t", (F.col("start_ms") + F.col("end_ms")) / 2)
    ivs = turns.select("video_id", F.col("turn_no").alias("iv_no"), F.col("start_ms").alias("iv_start"), F.col("end_ms").alias("iv_end"))
    hits = candidate_pairs(live.select("video_id", *keys, "t"), ivs, (F.col("t"), F.col("t")), (F.col("iv_start"), F.col("iv_end"))).filter("t between iv_start and iv_end").groupBy("video_id", *keys).agg(F.min("iv_no").alias("hit"))
    joined = live.join(hits, ["video_id", *keys], "left")
    edges = ivs.select("video_id", F.explode(F.array("iv_start", "iv_end")).alias("t"), "iv_no").groupBy("video_id", "t").agg(F.min("iv_no").alias("edge_no"))
    none = [F.lit(None).cast(joined.schema[k].dataType).alias(k) for k in keys]
    line = joined.filter("hit is null").select("video_id", F.col("t").cast("double").alias("t"), *keys, F.lit(None).cast("long").alias("edge_no")).unionByName(edges.select("video_id", F.col("t").cast("double").alias("t"), *none, F.col("edge_no").cast("long").alias("edge_no")))
    edge = F.when(F.col("edge_no").isNotNull(), F.struct("t", "edge_no"))
    order = Window.partitionBy("video_id").orderBy("t")
    back = F.last(edge, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(edge, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    found = line.withColumn("b", back).withColumn("a", ahead).filter("edge_no is null")
    pick = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("t") - F.col(c)["t"]).alias("d"), F.col(c)["edge_no"].alias("n")))
    near = found.select("video_id", *keys, F.array_min(F.filter(F.array(pick("b"), pick("a")), lambda x: x.isNotNull()))["n"].alias("near"))
    return joined.join(near, ["video_id", *keys], "left").withColumn("turn", F.coalesce("hit", "near")).drop("t", "hit", "near")


def align_positional(expected: DataFrame, recognised: DataFrame, min_coverage: float = 0.7) -> DataFrame:
    """The n-th expected word with the n-th recognised one of its recording; turns of which a smaller share than
    min_coverage is matched are left out. expected: video_id, turn_no, word_no, word; recognised: video_id,
    word_no, start_ms, end_ms."""
    both = expected.select("video_id", "turn_no", "word_no", "word").join(recognised.select("video_id", "word_no", "start_ms", "end_ms"), ["video_id", "word_no"], "left")
    turn = Window.partitionBy("video_id", "turn_no")
    share = F.count("start_ms").over(turn) / F.count("*").over(turn)
    return both.withColumn("coverage", share).filter(F.col("coverage") >= min_coverage).filter("start_ms is not null")
