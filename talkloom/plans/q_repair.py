"""Queries of the repair of words and turns, with the SQL that gives the same rows (folds as recursive queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.operators import repair as P
from talkloom.plans.fixtures import oracle, view
from talkloom.plans.q_timing import _edged, _tight

WORD = ("video_id", "turn_no", "pos", "start_ms", "end_ms")


def _q(fn):
    return lambda spark, d: fn(lambda name: view(spark, d, name))


def _rough(v):
    """Words of which some end late, over the next one, and some end early."""
    late = F.when(F.col("pos") % 4 == 1, 350).when(F.col("pos") % 5 == 2, -F.floor((F.col("end_ms") - F.col("start_ms")) * 3 / 4)).otherwise(0)
    return v("fx_words").select("video_id", "turn_no", "pos", "word", "start_ms", (F.col("end_ms") + late).alias("end_ms"))


def _dubbed(v):
    """Turns with the timing of a dub: shorter than the original by a part that differs from turn to turn."""
    length = F.floor((F.col("end_ms") - F.col("start_ms")) * (60 + (F.col("video_id") * 7 + F.col("turn_no") * 13) % 40) / 100)
    t = v("fx_turns").select("video_id", "turn_no", "speaker", "text", "start_ms", "end_ms", length.alias("d"))
    return t.withColumn("tts_start", F.floor(F.col("start_ms") * 7 / 10) + F.col("turn_no") * 40).withColumn("tts_end", F.col("tts_start") + F.col("d"))


def _untimed(v):
    """Turns of which some have no timing, some of these a segment of their own."""
    n, vid = F.col("turn_no"), F.col("video_id")
    gone, own = (vid * 3 + n) % 4 > 0, (vid + n) % 3 == 0
    known = lambda c: F.when(~gone, F.col(c))
    rows = _dubbed(v).withColumn("s", known("tts_start")).withColumn("e", known("tts_end"))
    seg = lambda c: F.when(own | (vid % 5 == 0), F.col(c) - 37)
    return rows.select("video_id", "turn_no", F.size(F.split("text", " ")).alias("n_words"), F.col("s").alias("tts_start"), F.col("e").alias("tts_end"), seg("tts_start").alias("seg_start"), seg("tts_end").alias("seg_end"), F.lit(120).alias("leading_ms"), F.lit(600_000).alias("duration_ms"))


def _crowded(v):
    """Turns in threes that end together, and some that begin before the last one has ended."""
    n = F.col("turn_no")
    at = F.floor(n / 3) * 4000 - F.when(n % 6 == 3, 900).otherwise(0)
    return v("fx_turns").select("video_id", "turn_no", (at + n % 3 * 100).alias("tts_start"), (at + 1200 + n % 3 * F.col("video_id") % 5 * 30).alias("tts_end"), F.lit(90_000).alias("duration_ms"))


QUERIES = {
    "t2_redistribute_bunches": _q(lambda v: P.redistribute_bunches(_tight(v, 4)).select(*WORD)),
    "t4_expand_short_words": _q(lambda v: P.expand_short_words(_rough(v)).select(*WORD)),
    "t9_share_overlaps": _q(lambda v: P.share_overlaps(_rough(v)).select(*WORD)),
    "t9_close_gaps": _q(lambda v: P.close_gaps(_rough(v)).select(*WORD)),
    "t9_borrow_slack": _q(lambda v: P.borrow_slack(_rough(v)).select(*WORD)),
    "t14_interpolate_turns": _q(lambda v: P.interpolate_turns(_untimed(v)).select("video_id", "turn_no", "tts_start", "tts_end", "source")),
    "t15_spread_turns": _q(lambda v: P.spread_turns(_crowded(v))),
    "t15_words_of_spread_turns": _q(lambda v: P.words_of_spread_turns(v("fx_words"), P.spread_turns(_crowded(v))).select(*WORD)),
    "t17_drift_plan": _q(lambda v: P.drift_plan(_dubbed(v))),
}

_TURN = "PARTITION BY video_id, turn_no"
#: Words with their number in the turn.
_WORDS = f"""
q AS (
  SELECT video_id, turn_no, pos, word, start_ms AS s,
    end_ms + CASE WHEN pos % 4 = 1 THEN 350 WHEN pos % 5 = 2 THEN -((end_ms - start_ms) * 3 // 4) ELSE 0 END AS e,
    row_number() OVER ({_TURN} ORDER BY pos) AS k
  FROM {{fx_words}}),
w AS (SELECT *, lead(s) OVER ({_TURN} ORDER BY k) AS ns FROM q)"""
_DUB = """
dub AS (
  SELECT video_id, turn_no, speaker, text, start_ms, start_ms * 7 // 10 + turn_no * 40 AS a,
    start_ms * 7 // 10 + turn_no * 40 + (end_ms - start_ms) * (60 + (video_id * 7 + turn_no * 13) % 40) // 100 AS b,
    row_number() OVER (PARTITION BY video_id ORDER BY turn_no) AS k
  FROM {fx_turns})"""
_CROWD = """
t AS (
  SELECT video_id, turn_no, turn_no // 3 * 4000 - CASE WHEN turn_no % 6 = 3 THEN 900 ELSE 0 END + turn_no % 3 * 100 AS a,
    turn_no // 3 * 4000 - CASE WHEN turn_no % 6 = 3 THEN 900 ELSE 0 END + 1200 + turn_no % 3 * video_id % 5 * 30 AS b,
    row_number() OVER (PARTITION BY video_id ORDER BY turn_no) AS k
  FROM {fx_turns}),
-- Bunches are measured from their first turn's end.
g(video_id, k, g, base) AS (
  SELECT video_id, k, k, b FROM t WHERE k = 1
  UNION ALL
  SELECT t.video_id, t.k, CASE WHEN abs(t.b - g.base) < 150 THEN g.g ELSE t.k END, CASE WHEN abs(t.b - g.base) < 150 THEN g.base ELSE t.b END
  FROM g JOIN t ON t.video_id = g.video_id AND t.k = g.k + 1),
h AS (
  SELECT t.*, g.g, count(*) OVER w AS n, first_value(a) OVER w AS a0, last_value(b) OVER w AS b0, t.k - g.g AS i,
    lead(a) OVER (PARTITION BY t.video_id ORDER BY t.k) AS na
  FROM t JOIN g USING (video_id, k)
  WINDOW w AS (PARTITION BY t.video_id, g.g ORDER BY t.k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m AS (SELECT *, last_value(na) OVER (PARTITION BY video_id, g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS after FROM h),
e AS (
  SELECT *, CASE WHEN b0 - a0 < n * 450 - 50 THEN least(a0 + n * 450 - 50, coalesce(after - 50, 90000)) ELSE b0 END AS stop FROM m),
s AS (SELECT *, greatest(400, CAST(floor((stop - a0 - (n - 1) * 50) / n) AS BIGINT)) AS each FROM e),
u AS (
  SELECT video_id, turn_no, k, n > 1 AS spread, CASE WHEN n > 1 THEN a0 + i * (each + 50) ELSE a END AS a,
    CASE WHEN n > 1 THEN a0 + i * (each + 50) + each ELSE b END AS b
  FROM s),
-- Then turns move behind the one before.
r(video_id, k, a, b, moved) AS (
  SELECT video_id, k, a, b, CAST(0 AS BIGINT) FROM u WHERE k = 1
  UNION ALL
  SELECT u.video_id, u.k, u.a + x.d, u.b + x.d, x.d
  FROM r JOIN u ON u.video_id = r.video_id AND u.k = r.k + 1, LATERAL (SELECT CASE WHEN r.b > u.a + 10 THEN r.b - u.a + 50 ELSE 0 END AS d) x),
z AS (SELECT r.video_id, u.turn_no, r.a AS tts_start, r.b AS tts_end, u.spread, r.moved AS shift_ms FROM r JOIN u USING (video_id, k))"""
_LETTERS = "length(regexp_replace(word, '[.,!?;:—–\\-…\"''«»()]', '', 'g'))"
ORACLES = {k: oracle(v) for k, v in {
    "t2_redistribute_bunches": f"""
WITH e AS (
  SELECT w.video_id, w.turn_no, w.pos, t.start_ms AS ts, t.end_ms AS te,
    CASE WHEN w.turn_no % 2 = 1 THEN t.start_ms + (w.start_ms - t.start_ms) // 4 ELSE w.start_ms END AS s,
    CASE WHEN w.turn_no % 2 = 1 THEN t.start_ms + (w.end_ms - t.start_ms) // 4 ELSE w.end_ms END AS e
  FROM {{fx_words}} w JOIN {{fx_turns}} t ON t.video_id = w.video_id AND t.turn_no = w.turn_no),
c AS (SELECT *, CASE WHEN s - lag(s) OVER w < 200 THEN 0 ELSE 1 END AS c, row_number() OVER w - 1 AS place FROM e WINDOW w AS ({_TURN} ORDER BY pos)),
g AS (SELECT *, sum(c) OVER ({_TURN} ORDER BY pos) AS g, count(*) OVER ({_TURN}) AS total FROM c),
b AS (
  SELECT video_id, turn_no, g, count(*) AS n, min(s) AS a, arg_max(e, pos) AS b, min(te) AS te FROM g GROUP BY ALL),
x AS (SELECT *, lead(a) OVER ({_TURN} ORDER BY g) AS nx FROM b),
y AS (
  SELECT *, CASE WHEN nx IS NULL THEN te ELSE least(b + greatest(0, least(CAST(floor((nx - b) / 2) AS BIGINT), nx - b - 50)), nx - 20) END - a AS w FROM x),
z AS (
  SELECT g.*, y.n, y.a, y.w, g.place - min(g.place) OVER (PARTITION BY g.video_id, g.turn_no, g.g) AS k,
    bool_or(y.n >= 5 AND y.w > 0 AND y.w / y.n < 100) OVER (PARTITION BY g.video_id, g.turn_no) AND (g.te - g.ts) / g.total >= 150 AS wrong
  FROM g JOIN y ON y.video_id = g.video_id AND y.turn_no = g.turn_no AND y.g = g.g)
SELECT video_id, turn_no, pos,
  CASE WHEN wrong THEN ts + (te - ts) * place // total WHEN n > 1 THEN a + CASE WHEN w > 0 THEN w * k // n ELSE 100 * k END ELSE s END AS start_ms,
  CASE WHEN wrong THEN ts + (te - ts) * (place + 1) // total WHEN n > 1 THEN a + CASE WHEN w > 0 THEN w * (k + 1) // n ELSE 100 * (k + 1) END ELSE e END AS end_ms
FROM z""",
    "t4_expand_short_words": f"""
WITH RECURSIVE {_WORDS.strip()},
l AS (
  SELECT *, regexp_full_match(word, '[^\\p{{L}}\\p{{N}}]+') AS mark, greatest(150, 35 * length(regexp_replace(word, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))) AS want
  FROM w),
r(video_id, turn_no, k, s, e) AS (
  SELECT video_id, turn_no, k, s - CASE WHEN lack > 0 THEN lack - ahead ELSE 0 END, e + CASE WHEN lack > 0 THEN ahead ELSE 0 END
  FROM l, LATERAL (SELECT CASE WHEN mark THEN 0 ELSE want - (e - s) END AS lack) a, LATERAL (SELECT least(lack, greatest(0, coalesce(ns - e, lack))) AS ahead) b
  WHERE k = 1
  UNION ALL
  SELECT l.video_id, l.turn_no, l.k, s2 - CASE WHEN lack > 0 THEN least(lack - ahead, greatest(0, s2 - r.e)) ELSE 0 END, l.e + CASE WHEN lack > 0 THEN ahead ELSE 0 END
  FROM r JOIN l ON l.video_id = r.video_id AND l.turn_no = r.turn_no AND l.k = r.k + 1, LATERAL (SELECT greatest(l.s, r.e) AS s2) a,
    LATERAL (SELECT CASE WHEN l.mark THEN 0 ELSE l.want - (l.e - s2) END AS lack) b, LATERAL (SELECT least(lack, greatest(0, coalesce(l.ns - l.e, lack))) AS ahead) c)
SELECT r.video_id, r.turn_no, q.pos, r.s AS start_ms, r.e AS end_ms FROM r JOIN q USING (video_id, turn_no, k)""",
    "t9_share_overlaps": f"""
WITH RECURSIVE {_WORDS.strip()},
-- s: a word's start after the word before; the end follows from the next word.
r(video_id, turn_no, k, s) AS (
  SELECT video_id, turn_no, k, s FROM q WHERE k = 1
  UNION ALL
  SELECT n.video_id, n.turn_no, n.k, CASE WHEN over > 0 THEN q.e - CASE WHEN total > 0 THEN over * (n.e - n.s) // total ELSE over // 2 END ELSE n.s END
  FROM r JOIN q USING (video_id, turn_no, k) JOIN q n ON n.video_id = r.video_id AND n.turn_no = r.turn_no AND n.k = r.k + 1,
    LATERAL (SELECT q.e - n.s AS over, q.e - r.s + n.e - n.s AS total) x)
SELECT r.video_id, r.turn_no, q.pos, r.s AS start_ms, CASE WHEN q.e > w.ns THEN nx.s ELSE q.e END AS end_ms
FROM r JOIN q USING (video_id, turn_no, k) JOIN w USING (video_id, turn_no, k)
LEFT JOIN r nx ON nx.video_id = r.video_id AND nx.turn_no = r.turn_no AND nx.k = r.k + 1""",
    "t9_close_gaps": f"""
WITH {_WORDS.strip()}
SELECT video_id, turn_no, pos, s AS start_ms, CASE WHEN ns - e > 0 AND ns - e <= 250 THEN ns ELSE e END AS end_ms FROM w""",
    "t9_borrow_slack": f"""
WITH RECURSIVE {_WORDS.strip()},
l AS (SELECT *, {_LETTERS} AS n, greatest(250, 60 * {_LETTERS}) AS want FROM q),
-- s: a word's start after it has borrowed; took: what it took from the word before.
r(video_id, turn_no, k, s, took) AS (
  SELECT video_id, turn_no, k, s, CAST(0 AS BIGINT) FROM l WHERE k = 1
  UNION ALL
  SELECT n.video_id, n.turn_no, n.k, n.s - y.took, y.took
  FROM r JOIN l USING (video_id, turn_no, k) JOIN l n ON n.video_id = r.video_id AND n.turn_no = r.turn_no AND n.k = r.k + 1,
    LATERAL (SELECT n.want - (n.e - n.s) AS lack, greatest(0, l.e - r.s - l.want) // 2 AS spare) x,
    LATERAL (SELECT CASE WHEN lack > 0 AND n.n > 0 AND least(lack, spare) > 20 THEN least(lack, spare) ELSE 0 END AS took) y)
SELECT r.video_id, r.turn_no, q.pos, r.s AS start_ms, q.e - coalesce(nx.took, 0) AS end_ms
FROM r JOIN q USING (video_id, turn_no, k) LEFT JOIN r nx ON nx.video_id = r.video_id AND nx.turn_no = r.turn_no AND nx.k = r.k + 1""",
    "t14_interpolate_turns": f"""
WITH {_DUB.strip()},
d AS (
  SELECT *, (video_id * 3 + turn_no) % 4 = 0 AS timed, CASE WHEN (video_id + turn_no) % 3 = 0 OR video_id % 5 = 0 THEN a - 37 END AS sa,
    CASE WHEN (video_id + turn_no) % 3 = 0 OR video_id % 5 = 0 THEN b - 37 END AS sb, len(string_split(text, ' ')) AS n
  FROM dub),
x AS (
  SELECT *, sum(CASE WHEN timed THEN 1 ELSE 0 END) OVER w AS run,
    last_value(CASE WHEN timed THEN b END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb,
    first_value(CASE WHEN timed THEN a END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS na
  FROM d WINDOW w AS (PARTITION BY video_id ORDER BY k)),
y AS (
  SELECT *, coalesce(pb + 50, 120) AS f, bool_and(coalesce(sb - sa >= 100, false)) OVER g AS own,
    greatest(100, coalesce(na - 50, 600000) - coalesce(pb + 50, 120)) - (count(*) OVER g - 1) * 50 AS speech, CAST(sum(n) OVER g AS BIGINT) AS total
  FROM x WINDOW g AS (PARTITION BY video_id, run, timed)),
z AS (SELECT *, greatest(300, CAST(floor(speech * n / total) AS BIGINT)) AS d FROM y),
v AS (
  SELECT *, f + CAST(coalesce(sum(d + 50) OVER (PARTITION BY video_id, run, timed ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM z)
SELECT video_id, turn_no, CASE WHEN timed THEN a WHEN own THEN sa + 120 ELSE s END AS tts_start, CASE WHEN timed THEN b WHEN own THEN sb + 120 ELSE s + d END AS tts_end,
  CASE WHEN timed THEN 'timed' WHEN own THEN 'segment' ELSE 'interpolated' END AS source
FROM v""",
    "t15_spread_turns": f"WITH RECURSIVE {_CROWD.strip()} SELECT * FROM z",
    "t15_words_of_spread_turns": f"""
WITH RECURSIVE {_CROWD.strip()},
w AS (
  SELECT w.*, z.tts_start AS a, z.tts_end AS b, spread, shift_ms, count(*) OVER (PARTITION BY w.video_id, w.turn_no) AS n,
    row_number() OVER (PARTITION BY w.video_id, w.turn_no ORDER BY pos) - 1 AS k
  FROM {{fx_words}} w JOIN z ON z.video_id = w.video_id AND z.turn_no = w.turn_no)
SELECT video_id, turn_no, pos, CASE WHEN spread THEN a + (b - a) * k // n ELSE start_ms + shift_ms END AS start_ms,
  CASE WHEN spread THEN a + (b - a) * (k + 1) // n ELSE end_ms + shift_ms END AS end_ms
FROM w""",
    "t17_drift_plan": f"""
WITH RECURSIVE {_DUB.strip()},
r(video_id, k, ins, cut, skip, off) AS (
  SELECT video_id, k, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM dub WHERE k = 1
  UNION ALL
  SELECT n.video_id, n.k, CASE WHEN ok THEN least(lack, 2000) ELSE 0 END, CASE WHEN ok THEN greatest(0, p.b) END, CASE WHEN ok THEN n.a END,
    r.off + CASE WHEN ok THEN least(lack, 2000) - (n.a - greatest(0, p.b)) ELSE 0 END
  FROM r JOIN dub p USING (video_id, k) JOIN dub n ON n.video_id = r.video_id AND n.k = r.k + 1 JOIN dub f ON f.video_id = r.video_id AND f.k = 1,
    LATERAL (SELECT n.start_ms - f.start_ms - (n.a + r.off) AS lack) x, LATERAL (SELECT p.speaker <> n.speaker AND lack >= 500 AND n.a - p.b >= 80 AS ok) y)
SELECT r.video_id, dub.turn_no, ins AS insert_ms, cut AS cut_ms, skip AS skip_to_ms, off AS offset_ms FROM r JOIN dub USING (video_id, k)""",
}.items()}
