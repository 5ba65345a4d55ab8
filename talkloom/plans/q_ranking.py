"""Queries of scoring and ranking, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.operators import ranking as R
from talkloom.operators import selection as L
from talkloom.operators import turns as T
from talkloom.plans.fixtures import oracle, view

CS = [f"c{k}" for k in range(7)]


def _q(fn):
    return lambda spark, d: fn(lambda name: view(spark, d, name))


def _scored(v):
    c = v("fx_scores")
    score = R.highlight_score({n: F.col(k) for n, k in zip(R.CRITERIA, CS, strict=True)}, F.col("needs_prev"), F.col("needs_next"))
    return c.withColumn("score", score).withColumn("tier", R.tier(F.col("score")))


def _raw(v):
    """Scores as a model's JSON: every third wrapped in prose, every seventh broken, every eleventh short of a field."""
    c, n = F.col, F.col("cand_no")
    body = F.concat(F.lit('{"completeness_arc": '), c("c0"), F.lit(', "surprise_novelty": "'), c("c1"), F.lit('", "hook_quality": '), c("c2") * 3, F.when(n % 11 != 5, F.concat(F.lit(', "personal_connection": '), c("c3"))).otherwise(""), F.lit(', "needs_next_context": "Yes", "trim_last_sentences": '), n, F.lit(', "merge_benefit": "'), F.when(n % 2 == 0, "low").otherwise("great"), F.lit('"}'))
    return v("fx_scores").withColumn("raw", F.when(n % 7 == 6, '{"completeness_arc": 0.').when(n % 3 == 0, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise(body))


def _parsed(v):
    from talkloom.functions.text import extract_json

    return _raw(v).select("video_id", "cand_no", R.parse_scores(extract_json(F.col("raw"))).alias("s")).select("video_id", "cand_no", "s.*")


def _mins(v):
    return v("fx_segs").groupBy("video_id").agg((F.count("*") % 9).cast("int").alias("n_min"))


def _over(v):
    return v("fx_over").select("video_id", "cand_no", "start_ms", "end_ms", F.round("score", 4).alias("score"))


def _bounds(v):
    return v("fx_cands").select("video_id", "cand_no", (F.col("cand_no") * 5).alias("start_idx"), (F.col("cand_no") * 5 + 2 + (F.col("video_id") + F.col("cand_no")) % 3).alias("end_idx"))


def _moves(v):
    """A move of one candidate of each recording; steps of -4, -1, 2 and 5."""
    at = v("fx_cands").filter("cand_no = video_id % 4")
    return at.select("video_id", "cand_no", F.when(F.col("video_id") % 2 == 0, "start").otherwise("end").alias("edge"), ((F.floor(F.col("video_id") / 2) % 4) * 3 - 4).alias("step"), F.lit(40).cast("long").alias("n_sentences"))


def _cut_short(v):
    """Candidates that end in the middle of their time, so that segments follow the last one too."""
    half = F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) / 2)
    return _scored(v).withColumn("end_ms", half).withColumn("needs_next", (F.col("video_id") + F.col("cand_no")) % 4 > 0)


QUERIES = {
    "r1_parse_scores": _q(_parsed),
    "r2_r3_score_and_tier": _q(lambda v: _scored(v).select("video_id", "cand_no", "score", "tier")),
    "r4_fill_fallback": _q(lambda v: R.fill_fallback(_scored(v).select("video_id", "cand_no", "score", F.when(F.col("score") > 0.55, F.col("tier")).alias("tier")), _mins(v))),
    "r5_top_k": _q(lambda v: R.top_k(_over(v), 12)),
    "r6_suppress_overlaps": _q(lambda v: R.suppress_overlaps(R.top_k(_over(v)).drop("place"), desired=4)),
    "r7_merge_pairs": _q(lambda v: R.merge_pairs(_scored(v)).select("video_id", "cand_no", "merge")),
    "r8_apply_merges": _q(lambda v: R.apply_merges(R.merge_pairs(_scored(v)), CS)),
    "r8_merged_turns": _q(lambda v: T.join_turns(v("fx_cand_turns"), R.merged_into(R.merge_pairs(_scored(v))), "cand_no")),
    "r9_expand_tail": _q(lambda v: R.expand_tail(_cut_short(v), v("fx_segs"))),
    "r11_labels": _q(lambda v: _over(v).select("video_id", "cand_no", R.score_label(F.col("score")).alias("label"), R.duration_bucket(F.col("end_ms") - F.col("start_ms")).alias("bucket"))),
    "r12_resolve_boundaries": _q(lambda v: R.resolve_boundaries(v("fx_cands").select("video_id", "cand_no", (F.col("cand_no") * 5).alias("start_idx"), (F.col("cand_no") * 5 + 3 + (F.col("video_id") + F.col("cand_no")) % 4).alias("end_idx")))),
    "r14_shift_boundary": _q(lambda v: R.shift_boundary(_bounds(v), _moves(v))),
    "a5_tier_counts": _q(lambda v: R.tier_counts(_scored(v))),
    "w2_number_candidates": _q(lambda v: R.number_candidates(_scored(v)).select("video_id", "cand_no", "by_time", "by_tier")),
    "x1_first_by_key": _q(lambda v: R.first_by_key(v("fx_segs").select("video_id", "seg_no", "text"), ["text"], ["video_id", "seg_no"])),
    "x2_union_points": _q(
        lambda v: L.union_points(v("fx_segs").withColumnRenamed("end_ms", "at_ms"), v("fx_cands").withColumnRenamed("end_ms", "at_ms"), ["video_id", "at_ms"])
    ),
    "flagship_top_highlights": _q(lambda v: R.top_k(R.fill_fallback(_scored(v).select("video_id", "cand_no", "start_ms", "end_ms", "score", "tier"), T.min_highlights(v("fx_segs")).select("video_id", "n_min")), 5)),
}

_SC = """
sc AS (SELECT *, round(least(c0 * 0.3 + c1 * 0.15 + c2 * 0.15 + c3 * 0.1 + c4 * 0.1 + c5 * 0.1 + c6 * 0.1,
    CASE WHEN needs_prev OR needs_next THEN 0.25 ELSE 1.0 END)::DOUBLE, 9) AS score
  FROM {fx_scores}),
st AS (SELECT *, CASE WHEN score >= 0.35 THEN 'strict' WHEN score >= 0.25 THEN 'extended' END AS tier FROM sc)"""
_OV = "ov AS (SELECT video_id, cand_no, start_ms, end_ms, round(score, 4) AS score FROM {fx_over})"
_MAY = """
n AS (SELECT *, lead(needs_prev) OVER w AS np, lead(benefit) OVER w AS nb, lead(score) OVER w AS ns, lead(end_ms) OVER w - start_ms AS d
  FROM st WINDOW w AS (PARTITION BY video_id ORDER BY cand_no)),
m AS (SELECT *, coalesce(CASE WHEN needs_next AND np AND d <= 180000 THEN true WHEN needs_next AND d <= 180000 THEN benefit IN ('high',
    'medium') OR (score < 0.35 AND ns < 0.35) WHEN np AND d <= 180000 THEN nb IN ('high', 'medium') OR score < 0.4 END, false) AS may
  FROM n),
g AS (SELECT *, sum(CASE WHEN may THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY cand_no) AS k FROM m),
p AS (SELECT *, may AND row_number() OVER (PARTITION BY video_id, k, may ORDER BY cand_no) % 2 = 1 AS merge FROM g)"""


def _fill(src: str, mins: str) -> str:
    return f"mn AS ({mins}), f AS (SELECT s.*, n_min, count(tier) OVER (PARTITION BY s.video_id) AS ch, row_number() OVER (PARTITION BY s.video_id, tier IS NULL ORDER BY score DESC, cand_no) AS pl FROM ({src}) s LEFT JOIN mn ON mn.video_id = s.video_id)"


ORACLES = {k: oracle(v) for k, v in {
    "r6_suppress_overlaps": """
WITH RECURSIVE t AS (
  SELECT video_id, cand_no, start_ms AS a, end_ms AS b, round(score, 4) AS score, row_number() OVER (PARTITION BY video_id ORDER BY round(score, 4) DESC, cand_no) AS k
  FROM {fx_over}),
s AS (SELECT * FROM t WHERE k <= 60),
-- kept: in the order in which they were kept; dropped: in score order. x is the kept one that decides on the next.
r(video_id, k, kept, dropped) AS (
  SELECT video_id, k, [{'n': cand_no, 'a': a, 'b': b, 's': score}], list_filter([{'n': cand_no, 'a': a, 'b': b, 's': score}], lambda x: false) FROM s WHERE k = 1
  UNION ALL
  SELECT s.video_id, s.k,
    CASE WHEN x IS NULL THEN list_append(r.kept, me) WHEN s.a >= x.a AND s.b <= x.b THEN r.kept
      WHEN x.a >= s.a AND x.b <= s.b THEN list_append(list_filter(r.kept, lambda o: o.n <> x.n), me) ELSE r.kept END,
    CASE WHEN x IS NULL OR (x.a >= s.a AND x.b <= s.b AND NOT (s.a >= x.a AND s.b <= x.b)) THEN r.dropped ELSE list_append(r.dropped, me) END
  FROM r JOIN s ON s.video_id = r.video_id AND s.k = r.k + 1,
    LATERAL (SELECT {'n': s.cand_no, 'a': s.a, 'b': s.b, 's': s.score} AS me,
      list_filter(r.kept, lambda o: (s.a >= o.a AND s.b <= o.b) OR (o.a >= s.a AND o.b <= s.b) OR abs(s.a - o.a) < 10000
        OR (least(s.b, o.b) >= greatest(s.a, o.a) AND (least(s.b, o.b) - greatest(s.a, o.a)) / (greatest(s.b, o.b) - least(s.a, o.a)) >= 0.5))[1] AS x) y),
l AS (SELECT video_id, arg_max(kept, k) AS kept, arg_max(dropped, k) AS dropped FROM r GROUP BY video_id),
o AS (SELECT video_id, unnest(list_concat(kept, dropped[:greatest(0, 4 - len(kept))])) AS c FROM l)
SELECT video_id, c.n AS cand_no, c.a AS start_ms, c.b AS end_ms, c.s AS score FROM o""",
    "r8_merged_turns": """
WITH PAIRS,
i AS (SELECT video_id, cand_no, CASE WHEN lag(merge) OVER w THEN lag(cand_no) OVER w ELSE cand_no END AS dest FROM p WINDOW w AS (PARTITION BY video_id ORDER BY cand_no)),
t AS (SELECT t.*, i.dest FROM {fx_cand_turns} t JOIN i ON i.video_id = t.video_id AND i.cand_no = t.cand_no),
a AS (
  SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c
  FROM t WINDOW w AS (PARTITION BY video_id, dest ORDER BY cand_no, turn_no)),
b AS (SELECT *, CAST(sum(c) OVER (PARTITION BY video_id, dest ORDER BY cand_no, turn_no) AS BIGINT) AS k FROM a)
SELECT video_id, dest AS cand_no, k AS turn_no, min(speaker) AS speaker, string_agg(text, ' ' ORDER BY cand_no, turn_no) AS text,
  arg_min(start_ms, (cand_no, turn_no)) AS start_ms, arg_max(end_ms, (cand_no, turn_no)) AS end_ms
FROM b GROUP BY video_id, dest, k""".replace("PAIRS", f"{_SC}, {_MAY}"),
    "r1_parse_scores": """
SELECT video_id, cand_no, CASE WHEN b THEN 0.5 ELSE c0 END AS completeness_arc, CASE WHEN b THEN 0.5 ELSE c1 END AS surprise_novelty,
    CASE WHEN b THEN 0.5 ELSE least(1.0, c2 * 3)::DOUBLE END AS hook_quality,
    CASE WHEN b OR cand_no % 11 = 5 THEN 0.5 ELSE c3 END AS personal_connection, 0.5::DOUBLE AS specificity_score,
    0.5::DOUBLE AS actionability_score, 0.5::DOUBLE AS clarity_simplicity, 0.0::DOUBLE AS merged_completeness_score,
    false AS needs_previous_context, NOT b AS needs_next_context, 0 AS trim_first_sentences, CASE WHEN b THEN 0 ELSE least(3,
    cand_no)::INT END AS trim_last_sentences, 0 AS estimated_merged_duration,
    CASE WHEN NOT b AND cand_no % 2 = 0 THEN 'low' ELSE 'none' END AS merge_benefit
  FROM (SELECT *, cand_no % 7 = 6 AS b FROM {fx_scores}) x""",
    "r2_r3_score_and_tier": f"WITH {_SC} SELECT video_id, cand_no, score, tier FROM st",
    "r4_fill_fallback": f"WITH {_SC}, {_fill('SELECT video_id, cand_no, score, CASE WHEN score > 0.55 THEN tier END AS tier FROM st', 'SELECT video_id, count(*) % 9 AS n_min FROM {fx_segs} GROUP BY ALL')} SELECT video_id, cand_no, score, coalesce(tier, 'fallback') AS tier FROM f WHERE tier IS NOT NULL OR (score >= 0.15 AND pl <= coalesce(n_min, 0) - ch)",
    "r5_top_k": f"""
WITH {_OV} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY score DESC, cand_no) AS INTEGER) AS place
  FROM ov) x WHERE place <= 12""",
    "r7_merge_pairs": f"WITH {_SC}, {_MAY} SELECT video_id, cand_no, merge FROM p",
    "r8_apply_merges": f"WITH {_SC}, {_MAY}, q AS (SELECT *, end_ms - start_ms AS du, CASE WHEN lag(merge) OVER w THEN lag(cand_no) OVER w ELSE cand_no END AS t FROM p WINDOW w AS (PARTITION BY video_id ORDER BY cand_no)) SELECT video_id, t AS cand_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, " + ", ".join(f"round(sum(c{k} * du) / sum(du), 9) AS c{k}" for k in range(7)) + ", arg_min(needs_prev, q.cand_no) AS needs_prev, arg_max(needs_next, q.cand_no) AS needs_next, string_agg(text, ' ' ORDER BY q.cand_no) AS text, count(*) AS n_merged FROM q GROUP BY video_id, t",
    "r9_expand_tail": """
WITH l AS (SELECT video_id, max(cand_no) AS cand_no, arg_max(start_ms, cand_no) AS c0, arg_max(end_ms, cand_no) AS c1
  FROM (SELECT * REPLACE (start_ms + (end_ms - start_ms) // 2 AS end_ms) FROM {fx_cands}) q GROUP BY video_id
  HAVING (video_id + max(cand_no)) % 4 > 0),
r AS (SELECT l.*, s.start_ms, s.end_ms, s.seg_no FROM l JOIN {fx_segs} s ON s.video_id = l.video_id AND s.start_ms >= c1 - 500),
k AS (SELECT *, max((end_ms - c0 > 180000)::INT) OVER w AS over, coalesce(max((end_ms >= c1 + least(30000,
    180000 - (c1 - c0)))::INT) OVER (PARTITION BY video_id
  ORDER BY start_ms, seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM r WINDOW w AS (PARTITION BY video_id
  ORDER BY start_ms, seg_no)) SELECT video_id, cand_no, max(end_ms) AS new_end_ms, count(*) AS n_added FROM k WHERE over = 0 AND done = 0
  GROUP BY video_id, cand_no HAVING max(end_ms) > min(c1) + 5000""",
    "r11_labels": f"""
WITH {_OV}
  SELECT video_id, cand_no, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS label,
    CASE WHEN end_ms - start_ms < 60000 THEN 'under 60 s' WHEN end_ms - start_ms < 90000 THEN '60 to 90 s' WHEN end_ms - start_ms < 120000
    THEN '90 to 120 s' ELSE 'over 120 s' END AS bucket
  FROM ov""",
    "r12_resolve_boundaries": """
WITH b AS (SELECT video_id, cand_no, cand_no * 5 AS s, cand_no * 5 + 3 + (video_id + cand_no) % 4 AS e FROM {fx_cands})
  SELECT video_id, cand_no, least(e, greatest(s, coalesce(lag(e) OVER (PARTITION BY video_id
  ORDER BY cand_no) + 1, s))) AS start_idx, e AS end_idx FROM b""",
    "r14_shift_boundary": """
WITH b AS (SELECT video_id, cand_no, cand_no * 5 AS s, cand_no * 5 + 2 + (video_id + cand_no) % 3 AS e, video_id % 4 AS m,
    video_id % 2 = 0 AS st, video_id // 2 % 4 * 3 - 4 AS d
  FROM {fx_cands}),
n AS (SELECT *, lag(s) OVER w AS ps, lag(e) OVER w AS pe, lead(s) OVER w AS ns, lead(e) OVER w AS ne FROM b
  WINDOW w AS (PARTITION BY video_id ORDER BY cand_no)),
o AS (SELECT video_id, m, st, CASE WHEN st THEN s + d ELSE e + d END AS t FROM n
  WHERE cand_no = m AND CASE WHEN st THEN s + d >= 0 AND s + d <= e AND NOT coalesce(d < 0 AND s + d <= pe AND s + d - 1 < ps,
    false) ELSE e + d < 40 AND e + d >= s AND NOT coalesce(d > 0 AND e + d >= ns AND e + d + 1 > ne, false) END)
  SELECT b.video_id, b.cand_no, CASE WHEN o.st AND b.cand_no = o.m THEN t WHEN NOT o.st AND b.cand_no = o.m + 1 AND t >= s THEN t + 1 ELSE s END
    AS start_idx, CASE WHEN NOT o.st AND b.cand_no = o.m THEN t WHEN o.st AND b.cand_no = o.m - 1 AND t <= e THEN t - 1 ELSE e END AS end_idx
  FROM b LEFT JOIN o ON o.video_id = b.video_id""",
    "a5_tier_counts": f"""
WITH {_SC}
  SELECT video_id, count(*) FILTER (tier = 'strict') AS strict, count(*) FILTER (coalesce(tier, 'extended') = 'extended') AS extended,
    count(*) FILTER (tier = 'fallback') AS fallback
  FROM st GROUP BY video_id""",
    "w2_number_candidates": f"""
WITH {_SC} SELECT video_id, cand_no, CAST(row_number() OVER (PARTITION BY video_id
  ORDER BY start_ms, cand_no) AS INTEGER) AS by_time, CAST(row_number() OVER (PARTITION BY video_id
  ORDER BY CASE tier WHEN 'strict' THEN 0 WHEN 'fallback' THEN 2 ELSE 1 END, cand_no) AS INTEGER) AS by_tier FROM st""",
    "x1_first_by_key": """
SELECT video_id, seg_no, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY video_id, seg_no) AS n FROM {fx_segs}) x
  WHERE n = 1""",
    "x2_union_points": "SELECT video_id, end_ms AS at_ms FROM {fx_segs} UNION SELECT video_id, end_ms FROM {fx_cands}",
    "flagship_top_highlights": f"WITH {_SC}, {_fill('SELECT video_id, cand_no, start_ms, end_ms, score, tier FROM st', 'SELECT video_id, 3 + arg_max(end_ms, seg_no) // 1200000 AS n_min FROM {fx_segs} GROUP BY ALL')}, t AS (SELECT video_id, cand_no, start_ms, end_ms, score, coalesce(tier, 'fallback') AS tier FROM f WHERE tier IS NOT NULL OR (score >= 0.15 AND pl <= coalesce(n_min, 0) - ch)) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY score DESC, cand_no) AS INTEGER) AS place FROM t) x WHERE place <= 5",
}.items()}
