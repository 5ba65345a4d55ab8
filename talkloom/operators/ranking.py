"""Scores, tiers, ranking and the greedy rules over candidates of a recording."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Criteria and their weights, in the order they are added.
WEIGHTS = [("completeness_arc", 0.30), ("surprise_novelty", 0.15), ("hook_quality", 0.15), ("personal_connection", 0.10), ("specificity_score", 0.10), ("actionability_score", 0.10), ("clarity_simplicity", 0.10)]
CRITERIA = [name for name, _ in WEIGHTS]
BENEFITS = ["high", "medium", "low", "none"]


def parse_scores(raw: Column) -> Column:
    """A struct of criteria from a model's JSON text. Numbers are cut to 0..1 (not a number: 0, missing: 0.5, merged
    completeness 0), flags are true for true, 1 and yes, trims are whole numbers within 0..3, the merged duration
    is not negative, and the benefit is one of four words. Text that can't be read gives the defaults."""
    names = [*CRITERIA, "merged_completeness_score", "needs_previous_context", "needs_next_context", "trim_first_sentences", "trim_last_sentences", "estimated_merged_duration", "merge_benefit"]
    s = F.from_json(raw, ", ".join(f"{n} string" for n in names))
    get = lambda n: F.trim(s[n])
    number = lambda n, default: F.when(get(n).isNull(), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(get(n).try_cast("double"), F.lit(0.0)))))
    whole = lambda n: F.coalesce(get(n).try_cast("double").cast("int"), F.lit(0))
    fields = [number(n, 0.5).alias(n) for n in CRITERIA] + [number("merged_completeness_score", 0.0).alias("merged_completeness_score")]
    fields += [F.coalesce(F.lower(get(n)).isin("true", "1", "yes"), F.lit(False)).alias(n) for n in ("needs_previous_context", "needs_next_context")]
    fields += [F.greatest(F.lit(0), F.least(F.lit(3), whole(n))).alias(n) for n in ("trim_first_sentences", "trim_last_sentences")]
    fields += [F.greatest(F.lit(0), whole("estimated_merged_duration")).alias("estimated_merged_duration")]
    fields += [F.when(get("merge_benefit").isin(*BENEFITS), get("merge_benefit")).otherwise("none").alias("merge_benefit")]
    return F.struct(*fields)


def highlight_score(values: dict[str, Column], needs_prev: Column, needs_next: Column) -> Column:
    """Weighted criteria, at most 0.25 for candidates that need a neighbour and at most 1 otherwise."""
    total = None
    for name, weight in WEIGHTS:
        part = values[name] * F.lit(weight)
        total = part if total is None else total + part
    return F.round(F.least(total, F.when(needs_prev | needs_next, 0.25).otherwise(1.0)), 9)


def tier(score: Column) -> Column:
    return F.when(score >= 0.35, "strict").when(score >= 0.25, "extended")


def fill_fallback(cands: DataFrame, mins: DataFrame, lowest: float = 0.15) -> DataFrame:
    """Chosen candidates (those with a tier), and where there are fewer than n_min of a recording the best of the
    others with at least `lowest`, as tier fallback. Ties go to the lower cand_no."""
    w = Window.partitionBy("video_id")
    chosen = F.count("tier").over(w)
    place = F.row_number().over(Window.partitionBy("video_id", F.col("tier").isNull()).orderBy(F.desc("score"), "cand_no"))
    rows = cands.withColumn("chosen", chosen).withColumn("place", place).join(mins, "video_id", "left")
    more = F.col("tier").isNull() & (F.col("score") >= lowest) & (F.col("place") <= F.coalesce("n_min", F.lit(0)) - F.col("chosen"))
    return rows.filter(F.col("tier").isNotNull() | more).withColumn("tier", F.coalesce("tier", F.lit("fallback"))).drop("chosen", "place", "n_min")


def top_k(cands: DataFrame, k: int = 60) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "cand_no"))
    return cands.withColumn("place", place).filter(F.col("place") <= k)


def tier_counts(cands: DataFrame) -> DataFrame:
    """Counts by tier; candidates without one count as extended."""
    return cands.withColumn("tier", F.coalesce("tier", F.lit("extended"))).groupBy("video_id").pivot("tier", ["strict", "extended", "fallback"]).count().fillna(0)


def suppress_overlaps(cands: DataFrame, iou: float = 0.5, min_gap_ms: int = 10_000, desired: int | None = None) -> DataFrame:
    """Greedy choice by descending score (ties: lower cand_no). Against the kept ones, in the order they were kept:
    a candidate within a kept one goes; one that holds a kept one takes its place and is not compared further; one
    of too large IoU or too near a start goes. With `desired`, dropped ones fill up in score order; kept ones that
    were replaced don't come back. The result is in order of start. At most 60 rows a recording come in (top_k)."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["score", "cand_no"], ascending=[False, True], kind="stable").to_dict("records")
        kept, dropped = [], []
        for r in rows:
            verdict = True
            for other in kept:
                a, b, c, d = r["start_ms"], r["end_ms"], other["start_ms"], other["end_ms"]
                if a >= c and b <= d:
                    verdict = False
                elif c >= a and d <= b:
                    kept.remove(other)
                    break
                else:
                    common, covered = min(b, d) - max(a, c), max(b, d) - min(a, c)
                    verdict = not ((common >= 0 and (covered <= 0 or common / covered >= iou)) or abs(a - c) < min_gap_ms)
                if not verdict:
                    break
            (kept if verdict else dropped).append(r)
        if desired:
            kept += dropped[: max(0, desired - len(kept))]
        return pd.DataFrame(sorted(kept, key=lambda r: r["start_ms"]), columns=pdf.columns)

    return cands.groupBy("video_id").applyInPandas(choose, cands.schema)


def merge_pairs(cands: DataFrame, max_ms: int = 180_000, limit_ms: int = 200_000) -> DataFrame:
    """Marks candidates that merge with the next one (`merge`). cands: score, needs_prev, needs_next, benefit.

    Whether two neighbours may merge is seen from the two rows; pairs are then taken from the left without
    sharing, that is every other one of a run of such neighbours."""
    w = Window.partitionBy("video_id").orderBy("cand_no")
    nxt = {c: F.lead(c).over(w) for c in ("needs_prev", "benefit", "score", "end_ms")}
    d, b = nxt["end_ms"] - F.col("start_ms"), nxt["benefit"]
    fits, short = d <= min(max_ms, limit_ms), d <= 180_000
    good = lambda c: c.isin("high", "medium")
    both = good(F.col("benefit")) | good(b) | short
    first = (F.col("benefit") == "high") | ((F.col("benefit") == "medium") & short) | (~((F.col("benefit") == "high") | ((F.col("benefit") == "medium") & short)) & (F.col("score") < 0.35) & (nxt["score"] < 0.35) & short)
    second = (b == "high") | ((b == "medium") & short) | ((F.col("score") < 0.40) & short)
    may = F.when(F.col("needs_next") & nxt["needs_prev"] & fits, both).when(F.col("needs_next") & fits, first).when(nxt["needs_prev"] & fits, second)
    rows = cands.withColumn("may", F.coalesce(may, F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("may"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.row_number().over(Window.partitionBy("video_id", "run", "may").orderBy("cand_no"))
    return rows.withColumn("merge", F.col("may") & (at % 2 == 1)).drop("may", "run")


def merged_into(pairs: DataFrame) -> DataFrame:
    """Adds `into` to the candidates of merge_pairs(): the one that each becomes part of."""
    w = Window.partitionBy("video_id").orderBy("cand_no")
    return pairs.withColumn("into", F.when(F.coalesce(F.lag("merge").over(w), F.lit(False)), F.lag("cand_no").over(w)).otherwise(F.col("cand_no")))


def apply_merges(pairs: DataFrame, values: list[str]) -> DataFrame:
    """Merged candidates of merge_pairs(): criteria averaged by duration, the outer context flags, joined text. Their
    turns follow by join_turns() with merged_into()."""
    rows = merged_into(pairs).withColumn("d", F.col("end_ms") - F.col("start_ms"))
    mean = [F.round(F.sum(F.coalesce(v, F.lit(0.25)) * F.col("d")) / F.sum("d"), 9).alias(v) for v in values]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cand_no", "text"))), lambda r: r["text"]), " ")
    return rows.groupBy("video_id", "into").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), *mean, F.min_by("needs_prev", "cand_no").alias("needs_prev"), F.max_by("needs_next", "cand_no").alias("needs_next"), text.alias("text"), F.count("*").alias("n_merged")).withColumnRenamed("into", "cand_no")


def expand_tail(cands: DataFrame, segs: DataFrame, max_ms: int = 180_000, gain_ms: int = 30_000, least_ms: int = 5_000) -> DataFrame:
    """The last candidate of a recording, where it needs what follows, takes the segments after it until gain_ms
    are won or max_ms would be passed; kept if more than least_ms are won. Gives the new end_ms."""
    last = cands.withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("cand_no")))).filter("n = 1 and needs_next")
    rows = last.select("video_id", "cand_no", F.col("start_ms").alias("c0"), F.col("end_ms").alias("c1")).join(segs.select("video_id", "seg_no", "start_ms", "end_ms"), "video_id").filter(F.col("start_ms") >= F.col("c1") - 500)
    w = Window.partitionBy("video_id").orderBy("start_ms", "seg_no")
    stop = F.max((F.col("end_ms") - F.col("c0") > max_ms).cast("int")).over(w) == 0
    target = F.least(F.lit(gain_ms), max_ms - (F.col("c1") - F.col("c0")))
    done = F.coalesce(F.max((F.col("end_ms") - F.col("c0") >= F.col("c1") - F.col("c0") + target).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0
    taken = rows.withColumn("ok", stop & done).filter("ok").groupBy("video_id", "cand_no").agg(F.max_by("end_ms", F.struct("start_ms", "seg_no")).alias("new_end_ms"), F.min("c1").alias("c1"), F.count("*").alias("n_added"))
    return taken.filter(F.col("new_end_ms") > F.col("c1") + least_ms).drop("c1")


def number_candidates(cands: DataFrame) -> DataFrame:
    """Chronological numbers, and numbers by tier (strict, extended, fallback) in input order."""
    rank = F.when(F.col("tier") == "strict", 0).when(F.col("tier") == "fallback", 2).otherwise(1)
    w = Window.partitionBy("video_id")
    return cands.withColumn("by_time", F.row_number().over(w.orderBy("start_ms", "cand_no"))).withColumn("by_tier", F.row_number().over(w.orderBy(rank, "cand_no")))


def score_label(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def duration_bucket(ms: Column) -> Column:
    return F.when(ms < 60_000, "under 60 s").when(ms < 90_000, "60 to 90 s").when(ms < 120_000, "90 to 120 s").otherwise("over 120 s")


def resolve_boundaries(bounds: DataFrame) -> DataFrame:
    """Sentence ranges [start_idx, end_idx]: a later one starts after the earlier ends and keeps a sentence."""
    before = F.lag("end_idx").over(Window.partitionBy("video_id").orderBy("cand_no"))
    start = F.greatest(F.col("start_idx"), F.coalesce(before + 1, F.col("start_idx")))
    return bounds.withColumn("start_idx", F.least(start, F.col("end_idx")))


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def shift_boundary(bounds: DataFrame, moves: DataFrame) -> DataFrame:
    """One batch of single moves of sentence ranges (video_id, cand_no, start_idx, end_idx). A move names an edge
    (`start` or `end`) and a step; moving out pushes the neighbour's edge along. A move is refused if the range
    would be empty or leave the text (0 .. n_sentences - 1), or if it would empty the neighbour. At most one move
    a recording is taken (the lowest cand_no, start before end)."""
    w = Window.partitionBy("video_id").orderBy("cand_no")
    one = first_by_key(moves, ["video_id"], ["cand_no", "edge"]).select("video_id", F.col("cand_no").alias("m_no"), "edge", "step", "n_sentences")
    names = ("cand_no", "start_idx", "end_idx")
    rows = bounds.select("video_id", *names).withColumns({f"p_{c}": F.lag(c).over(w) for c in names} | {f"n_{c}": F.lead(c).over(w) for c in names}).join(one, "video_id", "left")
    start, end = F.col("start_idx") + F.col("step"), F.col("end_idx") + F.col("step")
    push_p = (F.col("step") < 0) & (start <= F.col("p_end_idx"))
    push_n = (F.col("step") > 0) & (end >= F.col("n_start_idx"))
    ok_start = (F.col("edge") == "start") & (start >= 0) & (start <= F.col("end_idx")) & ~F.coalesce(push_p & (start - 1 < F.col("p_start_idx")), F.lit(False))
    ok_end = (F.col("edge") == "end") & (end < F.col("n_sentences")) & (end >= F.col("start_idx")) & ~F.coalesce(push_n & (end + 1 > F.col("n_end_idx")), F.lit(False))
    done = (F.col("cand_no") == F.col("m_no")) & (ok_start | ok_end)
    rows = rows.withColumn("new_start", F.when(done & (F.col("edge") == "start"), start)).withColumn("new_end", F.when(done & (F.col("edge") == "end"), end))
    after, before = F.lead("new_start").over(w), F.lag("new_end").over(w)
    end_out = F.coalesce(F.col("new_end"), F.when(after <= F.col("end_idx"), after - 1), F.col("end_idx"))
    start_out = F.coalesce(F.col("new_start"), F.when(before >= F.col("start_idx"), before + 1), F.col("start_idx"))
    return rows.select("video_id", "cand_no", start_out.alias("start_idx"), end_out.alias("end_idx"))
