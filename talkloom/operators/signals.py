"""Sampled signals and intervals on a time line: filling, jumps, peaks, and splitting or absorbing intervals.

Samples: series, sample_no (their order), v. Intervals: series, start_ms, end_ms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.operators.intervals import candidate_pairs
from talkloom.operators.turns import islands


def _order(by: str = "sample_no"):
    return Window.partitionBy("series").orderBy(by)


def fill_and_smooth(samples: DataFrame, default: float = 0.5, width: int = 3) -> DataFrame:
    """Nulls take the last value (default before the first); then the mean of the last `width` samples."""
    filled = samples.withColumn("v", F.coalesce(F.last("v", ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(default)))
    return filled.withColumn("smooth", F.round(F.avg("v").over(_order().rowsBetween(1 - width, 0)), 9))


def detect_jumps(samples: DataFrame, scenes: DataFrame, jump: float = 0.15, least_ms: int = 2000) -> DataFrame:
    """Camera cuts inside scenes: midway between neighbouring samples (video_id, t_ms, v) of a scene (scene_no, start_ms
    <= time < end_ms) that differ by `jump` or more, at least least_ms from both ends of the scene; scenes shorter
    than twice that have none. Gives scene_no and at_ms; samples without a value are left out."""
    ranges = scenes.select("video_id", "scene_no", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1")).filter(F.col("s1") - F.col("s0") >= 2 * least_ms)
    side = samples.filter("v is not null").select("video_id", "t_ms", "v")
    inside = candidate_pairs(side, ranges, (F.col("t_ms"), F.col("t_ms")), (F.col("s0"), F.col("s1"))).filter("t_ms >= s0 and t_ms < s1")
    w = Window.partitionBy("video_id", "scene_no").orderBy("t_ms")
    rows = inside.withColumn("at_ms", (F.lag("t_ms").over(w) + F.col("t_ms")) / 2).withColumn("step", F.abs(F.col("v") - F.lag("v").over(w)))
    ok = (F.col("step") >= jump) & (F.col("at_ms") - F.col("s0") >= least_ms) & (F.col("s1") - F.col("at_ms") >= least_ms)
    return rows.filter(ok).select("video_id", "scene_no", "at_ms")


def local_peaks(samples: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Samples above the threshold and above both neighbours; the ends of a series are none."""
    before, after = F.lag("v").over(_order()), F.lead("v").over(_order())
    return samples.withColumn("peak", (F.col("v") > threshold) & (F.col("v") > before) & (F.col("v") > after)).filter("peak").drop("peak")


def anchor_intervals(samples: DataFrame, threshold: float = 0.08) -> DataFrame:
    """Intervals of samples: a new one begins where a value leaves the interval's first value by more than the
    threshold. Each cut depends on the last one: series are dealt to tasks whole, sorted, and read as a stream that
    holds one open interval, however long the series."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, now = ["series", "first_no", "last_no", "anchor"], None
        for frame in frames:
            done = []
            for s, n, v in frame.itertuples(index=False):
                if now is None or s != now[0] or abs(v - now[3]) > threshold:
                    done += [tuple(now)] if now else []
                    now = [s, n, n, v]
                else:
                    now[2] = n
            yield pd.DataFrame(done, columns=names)
        yield pd.DataFrame([tuple(now)] if now else [], columns=names)

    ordered = samples.filter("v is not null").select("series", "sample_no", "v").repartition("series").sortWithinPartitions("series", "sample_no")
    return ordered.mapInPandas(run, "series long, first_no long, last_no long, anchor double")


def split_at(ivs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Intervals cut at the times that lie inside them. Intervals and cuts meet on time buckets."""
    keyed = ivs.select(F.col("series").alias("video_id"), "start_ms", "end_ms").distinct()
    near = candidate_pairs(keyed, cuts.select(F.col("series").alias("video_id"), "at"), (F.col("start_ms"), F.col("end_ms")), (F.col("at"), F.col("at")))
    inner = near.filter("at > start_ms and at < end_ms")
    points = keyed.withColumn("at", F.explode(F.array("start_ms", "end_ms"))).unionByName(inner).distinct()
    nxt = F.lead("at").over(Window.partitionBy("video_id", "start_ms", "end_ms").orderBy("at"))
    return points.withColumn("to", nxt).filter("to is not null").select(F.col("video_id").alias("series"), F.col("at").alias("start_ms"), F.col("to").alias("end_ms"))


def absorb_short(ivs: DataFrame, least_ms: int = 1200) -> DataFrame:
    """Intervals under least_ms join the one before; the first one of a series always stands."""
    runs = islands(ivs, ["series"], ["start_ms"], F.col("end_ms") - F.col("start_ms") >= least_ms)
    return runs.groupBy("series", "island").agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "start_ms").alias("end_ms"), F.count("*").alias("n")).drop("island")


def pitch_class(samples: DataFrame, speakers: DataFrame, split_hz: float = 165.0) -> DataFrame:
    """Median pitch of each speaker as high or low; unknown without samples."""
    own = samples.filter("f0 is not null").groupBy("speaker").agg(F.median("f0").alias("f0"))
    return speakers.join(own, "speaker", "left").select("speaker", F.when(F.col("f0").isNull(), "unknown").when(F.col("f0") >= split_hz, "high").otherwise("low").alias("pitch"))
