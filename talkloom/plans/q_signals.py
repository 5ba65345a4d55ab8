"""Queries of signals and intervals on a time line, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkloom.operators import signals as G
from talkloom.plans.fixtures import oracle, view


def _q(fn):
    return lambda spark, d: fn(lambda name: view(spark, d, name))


def _s(v):
    return v("fx_samples")


def _ivs(v):
    return v("fx_segs").select(F.col("video_id").alias("series"), "start_ms", "end_ms")


def _cuts(v):
    return v("fx_words").filter("word_no % 7 = 3").select(F.col("video_id").alias("series"), F.col("start_ms").alias("at"))


def _positions(v):
    """Of each frame the place of the face of most score and area."""
    best = Window.partitionBy("video_id", "ts_ms").orderBy(F.desc(F.col("score") * F.col("area")), "box_no")
    rows = v("fx_boxes").withColumn("n", F.row_number().over(best)).filter("n = 1")
    return rows.select("video_id", F.col("ts_ms").alias("t_ms"), (F.col("center_x") / 1920).alias("v"))


def _speakers(v):
    return v("fx_samples").select(F.concat(F.lit("S"), F.col("series")).alias("speaker")).distinct()


QUERIES = {
    "w10_fill_and_smooth": _q(lambda v: G.fill_and_smooth(_s(v))),
    "w11_detect_jumps": _q(lambda v: G.detect_jumps(_positions(v), v("fx_scenes"))),
    "w12_local_peaks": _q(lambda v: G.local_peaks(_s(v))),
    "w13_anchor_intervals": _q(lambda v: G.anchor_intervals(_s(v), 0.2)),
    "w14_split_at": _q(lambda v: G.split_at(_ivs(v), _cuts(v))),
    "w15_absorb_short": _q(lambda v: G.absorb_short(_ivs(v), 4000)),
    "a9_pitch_class": _q(lambda v: G.pitch_class(_s(v).select(F.concat(F.lit("S"), F.col("series")).alias("speaker"), F.when(F.col("series") % 5 != 0, F.col("v") * 330).alias("f0")), _speakers(v))),
}
_P = "PARTITION BY series ORDER BY sample_no"
ORACLES = {k: oracle(v) for k, v in {
    "w10_fill_and_smooth": f"""
WITH f AS (SELECT series, sample_no, coalesce(last_value(v IGNORE NULLS) OVER ({_P}), 0.5) AS v FROM {{fx_samples}})
  SELECT *, round(avg(v) OVER ({_P} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS smooth FROM f""",
    "w11_detect_jumps": """
WITH b AS (
  SELECT video_id, ts_ms, center_x / 1920 AS v, row_number() OVER (PARTITION BY video_id, ts_ms ORDER BY score * area DESC, box_no) AS n FROM {fx_boxes}),
s AS (
  SELECT c.video_id, c.scene_no, c.start_ms AS a, c.end_ms AS z, b.ts_ms AS t, b.v, lag(b.ts_ms) OVER w AS pt, lag(b.v) OVER w AS pv
  FROM {fx_scenes} c JOIN b ON b.video_id = c.video_id AND b.n = 1 AND b.ts_ms >= c.start_ms AND b.ts_ms < c.end_ms
  WHERE c.end_ms - c.start_ms >= 4000
  WINDOW w AS (PARTITION BY c.video_id, c.scene_no ORDER BY b.ts_ms))
SELECT video_id, scene_no, (pt + t) / 2 AS at_ms FROM s WHERE abs(v - pv) >= 0.15::DOUBLE AND (pt + t) / 2 - a >= 2000 AND z - (pt + t) / 2 >= 2000""",
    "w12_local_peaks": f"""
SELECT series, sample_no, v FROM (SELECT *, lag(v) OVER ({_P}) AS b, lead(v) OVER ({_P}) AS a FROM {{fx_samples}}) x
  WHERE v > 0.05 AND v > b AND v > a""",
    "w13_anchor_intervals": f"""
WITH RECURSIVE s AS (SELECT series, sample_no, v, row_number() OVER ({_P}) AS k FROM {{fx_samples}} WHERE v IS NOT NULL),
r AS (SELECT series, sample_no, k, 0 AS n, v AS anchor FROM s WHERE k = 1 UNION ALL
  SELECT s.series, s.sample_no, s.k, CASE WHEN abs(s.v - r.anchor) > 0.2 THEN r.n + 1 ELSE r.n END,
    CASE WHEN abs(s.v - r.anchor) > 0.2 THEN s.v ELSE r.anchor END
  FROM r JOIN s ON s.series = r.series AND s.k = r.k + 1)
  SELECT series, min(sample_no) AS first_no, max(sample_no) AS last_no, min(anchor) AS anchor FROM r GROUP BY series, n""",
    "w14_split_at": """
WITH i AS (SELECT video_id AS series, start_ms AS a, end_ms AS b FROM {fx_segs}),
p AS (SELECT series, a, b, a AS t FROM i UNION SELECT series, a, b, b FROM i UNION SELECT i.series, a, b, w.start_ms
  FROM i JOIN {fx_words} w ON w.video_id = i.series AND w.word_no % 7 = 3 AND w.start_ms > a AND w.start_ms < b),
n AS (SELECT *, lead(t) OVER (PARTITION BY series, a, b ORDER BY t) AS u FROM p) SELECT series, t AS start_ms, u AS end_ms FROM n
  WHERE u IS NOT NULL""",
    "w15_absorb_short": """
WITH a AS (SELECT video_id AS series, start_ms, end_ms, CASE WHEN end_ms - start_ms >= 4000 OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c
  FROM {fx_segs} WINDOW w AS (PARTITION BY video_id ORDER BY start_ms)),
b AS (SELECT *, sum(c) OVER (PARTITION BY series ORDER BY start_ms) AS k FROM a)
  SELECT series, min(start_ms) AS start_ms, arg_max(end_ms, start_ms) AS end_ms, count(*) AS n FROM b GROUP BY series, k""",
    "a9_pitch_class": """
WITH s AS (SELECT DISTINCT series FROM {fx_samples}),
m AS (SELECT series, median(v * 330) AS f FROM {fx_samples} WHERE series % 5 <> 0 GROUP BY ALL)
  SELECT 'S' || series AS speaker, CASE WHEN f IS NULL THEN 'unknown' WHEN f >= 165 THEN 'high' ELSE 'low' END AS pitch FROM s
  LEFT JOIN m USING (series)""",
}.items()}
