"""Queries of the interval joins, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.functions import spans as S
from talkloom.operators import intervals as J
from talkloom.operators import selection as L
from talkloom.plans.fixtures import oracle, view

SEG, WORD = ["seg_no"], ["turn_no", "pos"]


def _q(fn):
    return lambda spark, d: fn(lambda name: view(spark, d, name))


def _pairs(v):
    a = v("fx_over").select("video_id", F.col("cand_no").alias("a_no"), F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"))
    b = v("fx_over").select("video_id", F.col("cand_no").alias("b_no"), F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    own = [F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")]
    return J.candidate_pairs(a, b, (own[0], own[1]), (own[2], own[3])).filter("a_no < b_no").withColumn("overlaps", S.overlaps(*own)).withColumn("inside", S.contained(*own)).withColumn("iou", F.round(S.iou(*own), 6))


def _recognised(v):
    """Recognised words, numbered on; those of some turns under numbers that no expected word has."""
    gone = (F.col("video_id") % 3 == 0) & (F.col("turn_no") % 2 == 1)
    return v("fx_words").withColumn("word_no", F.col("word_no") + F.col("video_id") % 3 + F.when(gone, 1_000_000).otherwise(0))


def _sparse(v):
    """Turns of which every third is moved an hour away, so that its words lie in no turn."""
    by = F.when(F.col("turn_no") % 3 == 1, 3_600_000).otherwise(0)
    return v("fx_turns").withColumn("start_ms", F.col("start_ms") + by).withColumn("end_ms", F.col("end_ms") + by)


QUERIES = {
    "j1_speaker_max_segments": _q(lambda v: J.assign_speaker_max(v("fx_segs"), v("fx_diar"), SEG).select("video_id", "seg_no", "assigned")),
    "j1_speaker_max_words": _q(lambda v: J.assign_speaker_max(v("fx_words"), v("fx_diar"), WORD, "").select("video_id", *WORD, "assigned")),
    "j2_speaker_dominant": _q(lambda v: J.assign_speaker_dominant(v("fx_segs"), v("fx_diar"), SEG).select("video_id", "seg_no", "assigned")),
    "j3_word_speaker_mid": _q(lambda v: J.assign_word_speaker_mid(v("fx_words"), v("fx_diar"), WORD).select("video_id", *WORD, "assigned")),
    "j4_nearest_interval": _q(lambda v: J.nearest_interval(v("fx_words"), v("fx_diar"), WORD, (F.col("start_ms") + F.col("end_ms")) / 2).select("video_id", *WORD, "assigned")),
    "j6_overlay_speakers": _q(lambda v: J.overlay_speakers(v("fx_segs"), v("fx_diar"), SEG).select("video_id", "seg_no", "speaker")),
    "j8_words_in_range": _q(lambda v: J.words_in_range(v("fx_words"), v("fx_over"), "cand_no", WORD).groupBy("video_id", "cand_no").agg(F.count("*").alias("n_words"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))),
    "j9_segments_in_bounds": _q(lambda v: J.segments_in_bounds(v("fx_segs").select("video_id", "seg_no", "start_ms", "end_ms"), v("fx_cands").withColumn("start_ms", F.col("start_ms") + 700).withColumnRenamed("cand_no", "chunk_no")).select("video_id", "seg_no", "chunk_no")),
    "j10_change_times": _q(lambda v: J.speaker_by_change_times(v("fx_turns"), F.array(*[F.lit(t).cast("long") for t in (20_000, 45_000, 90_000)]), 3).select("video_id", "turn_no", "speaker_index")),
    "j13_speaker_at": _q(lambda v: J.speaker_at(v("fx_cands"), v("fx_turns"), ["cand_no"], F.col("start_ms") + 333).select("video_id", "cand_no", "assigned")),
    "j16_missing_results": _q(lambda v: L.missing_ids(v("fx_segs"), v("fx_cands").select("video_id", F.col("cand_no").alias("seg_no")), ["video_id", "seg_no"])),
    "j18_align_positional": _q(lambda v: J.align_positional(v("fx_words"), _recognised(v)).select("video_id", "turn_no", "word_no", "word", "start_ms", "end_ms")),
    "j20_words_to_turns": _q(lambda v: J.words_to_turns(v("fx_words"), _sparse(v), WORD).select("video_id", *WORD, "turn")),
    "p4_p5_span_pairs": _q(_pairs),
}

_OVER = "greatest(0, least(s.end_ms, d.end_ms) - greatest(s.start_ms, d.start_ms))"
ORACLES = {k: oracle(v) for k, v in {
    "j1_speaker_max_segments": f"""
WITH p AS (SELECT s.video_id, s.seg_no, d.speaker, row_number() OVER (PARTITION BY s.video_id, s.seg_no ORDER BY {_OVER} DESC, d.iv_no) AS n
  FROM {{fx_segs}} s JOIN {{fx_diar}} d ON s.video_id = d.video_id AND {_OVER} > 0)
  SELECT s.video_id, s.seg_no, coalesce(p.speaker, 'UNKNOWN') AS assigned FROM {{fx_segs}} s
  LEFT JOIN p ON p.video_id = s.video_id AND p.seg_no = s.seg_no AND p.n = 1""",
    "j1_speaker_max_words": f"""
WITH p AS (SELECT s.video_id, s.turn_no, s.pos, d.speaker, row_number() OVER (PARTITION BY s.video_id, s.turn_no, s.pos
  ORDER BY {_OVER} DESC, d.iv_no) AS n FROM {{fx_words}} s JOIN {{fx_diar}} d ON s.video_id = d.video_id AND {_OVER} > 0)
  SELECT s.video_id, s.turn_no, s.pos, coalesce(p.speaker, '') AS assigned FROM {{fx_words}} s
  LEFT JOIN p ON p.video_id = s.video_id AND p.turn_no = s.turn_no AND p.pos = s.pos AND p.n = 1""",
    "j2_speaker_dominant": f"""
WITH p AS (SELECT s.video_id, s.seg_no, d.speaker, sum({_OVER}) AS t, min(d.iv_no) AS m
  FROM {{fx_segs}} s JOIN {{fx_diar}} d ON s.video_id = d.video_id AND {_OVER} > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, seg_no ORDER BY t DESC, m) AS n FROM p)
  SELECT s.video_id, s.seg_no, coalesce(r.speaker, 'SPEAKER_UNKNOWN') AS assigned FROM {{fx_segs}} s
  LEFT JOIN r ON r.video_id = s.video_id AND r.seg_no = s.seg_no AND r.n = 1""",
    "j3_word_speaker_mid": """
WITH p AS (SELECT s.video_id, s.turn_no, s.pos, arg_min(d.speaker, d.iv_no) AS sp
  FROM {fx_words} s JOIN {fx_diar} d ON s.video_id = d.video_id AND (s.start_ms + s.end_ms) / 2 BETWEEN d.start_ms AND d.end_ms
  GROUP BY ALL) SELECT s.video_id, s.turn_no, s.pos, coalesce(sp, speaker) AS assigned FROM {fx_words} s
  LEFT JOIN p USING (video_id, turn_no, pos)""",
    "j4_nearest_interval": """
WITH p AS (SELECT s.video_id, s.turn_no, s.pos, d.speaker, d.iv_no, (s.start_ms + s.end_ms) / 2 AS t, d.start_ms AS a, d.end_ms AS b
  FROM {fx_words} s JOIN {fx_diar} d ON s.video_id = d.video_id),
q AS (SELECT *, CASE WHEN t BETWEEN a AND b THEN 0 ELSE 1 END AS o, CASE WHEN t BETWEEN a AND b THEN 0 ELSE least(abs(t - a), abs(t - b)) END AS g
  FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, turn_no, pos ORDER BY o, g, iv_no) AS n FROM q WHERE g <= 500)
  SELECT s.video_id, s.turn_no, s.pos, r.speaker AS assigned FROM {fx_words} s
  LEFT JOIN r ON r.video_id = s.video_id AND r.turn_no = s.turn_no AND r.pos = s.pos AND r.n = 1""",
    "j6_overlay_speakers": """
WITH p AS (SELECT s.video_id, s.seg_no, arg_max(d.speaker, d.iv_no) AS sp
  FROM {fx_segs} s JOIN {fx_diar} d ON s.video_id = d.video_id AND s.start_ms >= d.start_ms AND s.start_ms < d.end_ms GROUP BY ALL)
  SELECT video_id, seg_no, coalesce(sp, speaker) AS speaker FROM {fx_segs} LEFT JOIN p USING (video_id, seg_no)""",
    "j8_words_in_range": """
SELECT w.video_id, r.cand_no, count(*) AS n_words, min(w.start_ms) AS first_ms, max(w.end_ms) AS last_ms
  FROM {fx_words} w JOIN {fx_over} r ON w.video_id = r.video_id AND w.start_ms < r.end_ms AND w.end_ms > r.start_ms GROUP BY ALL""",
    "j9_segments_in_bounds": """
SELECT s.video_id, s.seg_no, c.cand_no AS chunk_no
  FROM {fx_segs} s JOIN {fx_cands} c ON s.video_id = c.video_id AND s.start_ms >= c.start_ms + 700 - 500 AND s.end_ms <= c.end_ms + 500""",
    "j10_change_times": """
SELECT video_id, turn_no, CAST(least(2, (20000 <= start_ms)::INT + (45000 <= start_ms)::INT + (90000 <= start_ms)::INT) AS INTEGER) AS speaker_index
  FROM {fx_turns}""",
    "j13_speaker_at": """
WITH p AS (SELECT video_id, cand_no, CAST(round_even((start_ms + 333) / 100, 0) AS BIGINT) AS g FROM {fx_cands}),
h AS (SELECT p.video_id, p.cand_no, arg_max(t.speaker, t.turn_no) AS sp
  FROM p JOIN {fx_turns} t ON p.video_id = t.video_id AND g BETWEEN t.start_ms // 100 AND t.end_ms // 100 GROUP BY ALL)
  SELECT video_id, cand_no, sp AS assigned FROM p LEFT JOIN h USING (video_id, cand_no)""",
    "j16_missing_results": """
SELECT video_id, seg_no FROM {fx_segs} s WHERE NOT EXISTS (SELECT 1 FROM {fx_cands} c
  WHERE c.video_id = s.video_id AND c.cand_no = s.seg_no)""",
    "j18_align_positional": """
WITH b AS (SELECT e.video_id, e.turn_no, e.word_no, e.word, r.start_ms, r.end_ms, count(r.start_ms) OVER (PARTITION BY e.video_id,
    e.turn_no) AS k, count(*) OVER (PARTITION BY e.video_id, e.turn_no) AS n
  FROM {fx_words} e
  LEFT JOIN {fx_words} r ON r.video_id = e.video_id AND r.word_no + r.video_id % 3 + CASE WHEN r.video_id % 3 = 0 AND r.turn_no % 2 = 1
    THEN 1000000 ELSE 0 END = e.word_no)
  SELECT video_id, turn_no, word_no, word, start_ms, end_ms FROM b WHERE k / n >= 0.7 AND start_ms IS NOT NULL""",
    "j20_words_to_turns": """
WITH p AS (SELECT w.video_id, w.turn_no, w.pos, t.turn_no AS tn, (w.start_ms + w.end_ms) / 2 AS m,
    t.start_ms + CASE WHEN t.turn_no % 3 = 1 THEN 3600000 ELSE 0 END AS a, t.end_ms + CASE WHEN t.turn_no % 3 = 1 THEN 3600000 ELSE 0 END AS b
  FROM {fx_words} w JOIN {fx_turns} t ON w.video_id = t.video_id),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, turn_no, pos
  ORDER BY CASE WHEN m BETWEEN a AND b THEN 0 ELSE 1 END, CASE WHEN m BETWEEN a AND b THEN 0 ELSE least(abs(m - a), abs(m - b)) END, tn) AS n
  FROM p) SELECT w.video_id, w.turn_no, w.pos, r.tn AS turn FROM {fx_words} w
  LEFT JOIN r ON r.video_id = w.video_id AND r.turn_no = w.turn_no AND r.pos = w.pos AND r.n = 1""",
    "p4_p5_span_pairs": """
WITH p AS (SELECT a.video_id, a.cand_no AS a_no, a.start_ms AS a_start, a.end_ms AS a_end, b.cand_no AS b_no, b.start_ms AS b_start, b.end_ms AS b_end
  FROM {fx_over} a JOIN {fx_over} b ON a.video_id = b.video_id AND a.cand_no < b.cand_no AND a.start_ms // 10000 <= b.end_ms // 10000
    AND b.start_ms // 10000 <= a.end_ms // 10000)
  SELECT *, a_start < b_end AND a_end > b_start AS overlaps, a_start >= b_start AND a_end <= b_end AS inside, CASE WHEN least(a_end,
    b_end) < greatest(a_start, b_start) THEN 0.0::DOUBLE ELSE round((least(a_end, b_end) - greatest(a_start, b_start)) / (greatest(a_end,
    b_end) - least(a_start, b_start)), 6) END AS iou
  FROM p""",
}.items()}
