"""Queries of chunking, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.functions.text import TYPOGRAPHY, clean_text
from talkloom.operators import chunking as C
from talkloom.operators.turns import join_turns
from talkloom.plans.fixtures import oracle, view
from talkloom.plans.q_text import _SQ as SQUEEZED
from talkloom.plans.q_text import _nest as nested


def _q(fn):
    return lambda spark, d: fn(lambda name: view(spark, d, name))


def _pieces(make):
    return _q(lambda v: v("fx_turns").select("video_id", "turn_no", F.posexplode(make(F.col("text"))).alias("n", "piece")))


def _c3(v):
    """Candidates as chunks, a tenth of their words without a start."""
    c = v("fx_cands").select("video_id", F.col("cand_no").alias("chunk_no"), "text")
    start = F.when(F.col("word_no") % 10 != 3, F.col("start_ms"))
    w = v("fx_cand_words").select("video_id", F.col("cand_no").alias("chunk_no"), "word_no", start.alias("start_ms"))
    return C.boundary_times(c, w, c.select("video_id", "chunk_no", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("n")))


def _chunked(v):
    """Segments as chunks of one speaker; every fourth names another one first."""
    listed = F.when(F.col("chunk_no") % 4 == 1, F.array(F.lit("SPEAKER_07"), F.col("speaker"))).otherwise(F.array("speaker"))
    return v("fx_segs").withColumnRenamed("seg_no", "chunk_no").withColumn("speakers", listed)


QUERIES = {
    "c1_time_windows": _q(lambda v: C.time_windows(v("fx_segs"), 30, 60)),
    "c2_large_chunks": _q(lambda v: C.large_chunks(v("fx_segs"), 60_000, 12_000)),
    "c3_boundary_times": _q(_c3),
    "c4_thin_boundaries": _q(lambda v: C.thin_boundaries(v("fx_segs").select("video_id", F.col("end_ms").alias("at_ms")).distinct())),
    "c5_split_by_span": _q(lambda v: C.split_by_span(v("fx_segs"), 40_000)),
    "c6_dedup_chunks": _q(lambda v: C.dedup_chunks(v("fx_over").withColumn("start_ms", F.col("start_ms") + F.col("cand_no") * 137).withColumnRenamed("cand_no", "chunk_no"))),
    "c7_merge_short": _q(lambda v: C.merge_short(_chunked(v), 6_000).withColumn("speakers", F.array_join("speakers", ","))),
    "c7_merged_turns": _q(
        lambda v: join_turns(v("fx_segs").select("video_id", F.col("seg_no").alias("chunk_no"), F.lit(1).alias("turn_no"), "speaker", "text", "start_ms", "end_ms"), C.short_runs(_chunked(v), 6_000), "chunk_no")
    ),
    "c8_plan_parts": _q(lambda v: C.plan_parts(v("fx_words").groupBy("video_id").agg(F.max("end_ms").alias("duration_ms")), 50_000)),
    "c8_merge_parts": _q(lambda v: C.merge_parts(v("fx_diar").select("video_id", (F.col("iv_no") % 3).alias("part"), (F.col("iv_no") % 3 * 50_000).alias("part_start"), "start_ms", "end_ms", F.when(F.col("iv_no") % 5 == 4, "guest").otherwise(F.col("speaker")).alias("speaker")))),
    "c9_batch_rows": _q(lambda v: C.batch_rows(v("fx_segs"), 5, 300)),
    "c10_chunk_text": _pieces(lambda t: C.chunk_text(t, 120)),
    "c11_force_split": _pieces(lambda t: C.force_split(t, 80)),
    "c12_turn_chunks": _pieces(lambda t: C.turn_chunks(t, clean_text)),
}

_SENTENCES = (
    "list_filter(string_split(trim(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g')), chr(1)), lambda x: x <> '')"
)
_WORDS = "list_filter(string_split_regex({}, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"
_CLEAN = SQUEEZED.format("regexp_replace(" + nested(TYPOGRAPHY, "s") + ", '[^0-9A-Za-zА-Яа-яЁё.,!?;:''\"()\\- ]+', ' ', 'g')")
_FOLD = """
WITH RECURSIVE s AS (SELECT video_id, seg_no, start_ms, end_ms, text, row_number() OVER (PARTITION BY video_id ORDER BY seg_no) AS k
  FROM {fx_segs})"""
ORACLES = {k: oracle(v) for k, v in {
    "c1_time_windows": """
WITH d AS (SELECT video_id, arg_max(end_ms, seg_no) AS dur FROM {fx_segs} GROUP BY video_id),
g AS (SELECT video_id, dur, z AS size, unnest(range(0, greatest((dur - z * 1000) // 1000, 0) + 1, z)) * 1000 AS a
  FROM d, (SELECT unnest([30, 45, 60])::BIGINT AS z) q),
t AS (SELECT video_id, dur, size, a FROM g UNION ALL SELECT video_id, dur, size, greatest(dur - size * 1000, 0) FROM g GROUP BY ALL
  HAVING max(a) + size * 1000 < dur),
t2 AS (SELECT video_id, dur, size, a FROM g UNION ALL SELECT video_id, dur, size, greatest(dur - size * 1000, 0) AS a
  FROM (SELECT video_id, dur, size, max(a) AS m FROM g GROUP BY ALL) x WHERE m + size * 1000 < dur),
w AS (SELECT t2.video_id, size, a AS start_ms, least(a + size * 1000, dur) AS end_ms FROM t2),
x AS (SELECT w.*, string_agg(s.text, ' ' ORDER BY s.seg_no) AS text
  FROM w JOIN {fx_segs} s ON s.video_id = w.video_id AND s.start_ms < w.end_ms AND s.end_ms > w.start_ms GROUP BY ALL)
  SELECT video_id, CAST(size AS INTEGER) AS size, start_ms, end_ms, text FROM (SELECT *, row_number() OVER (PARTITION BY video_id, text
  ORDER BY size, start_ms) AS n FROM x) y WHERE n = 1""",
    "c2_large_chunks": _FOLD + ", r AS (SELECT video_id, 0 AS n, start_ms AS a, k FROM s WHERE k = 1 UNION ALL SELECT r.video_id, r.n + 1, t.start_ms, t.k FROM r JOIN s t ON t.video_id = r.video_id AND t.k = (SELECT min(u.k) FROM s u WHERE u.video_id = r.video_id AND u.k > r.k AND u.start_ms >= r.a + 48000)), e AS (SELECT r.video_id, r.n, r.a, r.k, coalesce(max(t.k) FILTER (t.end_ms <= r.a + 60000), r.k) AS j FROM r JOIN s t ON t.video_id = r.video_id AND t.k >= r.k GROUP BY r.video_id, r.n, r.a, r.k) SELECT e.video_id, CAST(e.n AS BIGINT) AS chunk_no, e.a AS start_ms, t.end_ms, u.seg_no AS first_seg, t.seg_no AS last_seg FROM e JOIN s t ON t.video_id = e.video_id AND t.k = e.j JOIN s u ON u.video_id = e.video_id AND u.k = e.k",
    "c4_thin_boundaries": """
WITH RECURSIVE b AS (SELECT DISTINCT video_id, end_ms AS t FROM {fx_segs}),
e AS (SELECT video_id, max(t) AS z FROM b GROUP BY ALL),
r AS (SELECT video_id, 0 AS n, min(t) AS t FROM b GROUP BY video_id UNION ALL SELECT r.video_id, r.n + 1, (SELECT min(b.t) FROM b
  WHERE b.video_id = r.video_id AND b.t >= r.t + 30000) FROM r WHERE EXISTS (SELECT 1 FROM b
  WHERE b.video_id = r.video_id AND b.t >= r.t + 30000)),
l AS (SELECT r.video_id, max(n) AS m, max(t) AS lt FROM r GROUP BY ALL)
  SELECT r.video_id, CAST(r.n AS BIGINT) AS n, CASE WHEN r.n = m AND m > 0 AND z <> lt THEN z ELSE t END AS at_ms
  FROM r JOIN l USING (video_id) JOIN e USING (video_id) UNION ALL SELECT video_id, 1, z FROM l JOIN e USING (video_id)
  WHERE m = 0 AND z <> lt""",
    "c5_split_by_span": _FOLD + ", r AS (SELECT video_id, k, seg_no, 0 AS c, start_ms AS a, end_ms - start_ms >= 40000 AS cut FROM s WHERE k = 1 UNION ALL SELECT s.video_id, s.k, s.seg_no, r.c + r.cut::INT, CASE WHEN r.cut THEN s.start_ms ELSE r.a END, s.end_ms - CASE WHEN r.cut THEN s.start_ms ELSE r.a END >= 40000 FROM r JOIN s ON s.video_id = r.video_id AND s.k = r.k + 1) SELECT video_id, seg_no, CAST(c AS BIGINT) AS chunk_no FROM r",
    "c6_dedup_chunks": """
WITH RECURSIVE o AS (SELECT video_id, cand_no AS chunk_no, start_ms + cand_no * 137 AS a, end_ms AS b FROM {fx_over}),
s AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY a, chunk_no) AS k FROM o),
r AS (SELECT video_id, k, 0 AS slot, chunk_no, a, b FROM s WHERE k = 1 UNION ALL
  SELECT s.video_id, s.k, CASE WHEN s.a < r.b - 1000 THEN r.slot ELSE r.slot + 1 END,
    CASE WHEN s.a < r.b - 1000 AND s.b - s.a <= r.b - r.a THEN r.chunk_no ELSE s.chunk_no END,
    CASE WHEN s.a < r.b - 1000 AND s.b - s.a <= r.b - r.a THEN r.a ELSE s.a END,
    CASE WHEN s.a < r.b - 1000 AND s.b - s.a <= r.b - r.a THEN r.b ELSE s.b END
  FROM r JOIN s ON s.video_id = r.video_id AND s.k = r.k + 1)
  SELECT video_id, arg_max(chunk_no, k) AS chunk_no, arg_max(a, k) AS start_ms, arg_max(b, k) AS end_ms FROM r GROUP BY video_id, slot""",
    "c7_merge_short": """
WITH a AS (
  SELECT *, CASE WHEN end_ms - start_ms >= 6000 OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c
  FROM {fx_segs} WINDOW w AS (PARTITION BY video_id ORDER BY seg_no)),
b AS (SELECT *, sum(c) OVER (PARTITION BY video_id ORDER BY seg_no) AS k FROM a),
l AS (SELECT video_id, k, seg_no * 2 AS o, 'SPEAKER_07' AS sp FROM b WHERE seg_no % 4 = 1 UNION ALL SELECT video_id, k, seg_no * 2 + 1, speaker FROM b),
m AS (SELECT video_id, k, sp, min(o) AS o FROM l GROUP BY ALL),
n AS (SELECT video_id, k, string_agg(sp, ',' ORDER BY o) AS speakers FROM m GROUP BY ALL),
c AS (
  SELECT video_id, k, min(seg_no) AS chunk_no, arg_min(start_ms, seg_no) AS start_ms, arg_max(end_ms, seg_no) AS end_ms,
    string_agg(text, ' ' ORDER BY seg_no) AS text, count(*) AS n_chunks
  FROM b GROUP BY video_id, k)
SELECT video_id, chunk_no, start_ms, end_ms, text, speakers, n_chunks FROM c JOIN n USING (video_id, k)""",
    "c7_merged_turns": """
WITH a AS (
  SELECT *, CASE WHEN end_ms - start_ms >= 6000 OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c
  FROM {fx_segs} WINDOW w AS (PARTITION BY video_id ORDER BY seg_no)),
b AS (SELECT *, sum(c) OVER (PARTITION BY video_id ORDER BY seg_no) AS k FROM a),
d AS (
  SELECT *, min(seg_no) OVER (PARTITION BY video_id, k) AS dest,
    CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s
  FROM b WINDOW w AS (PARTITION BY video_id, k ORDER BY seg_no)),
e AS (SELECT *, CAST(sum(s) OVER (PARTITION BY video_id, dest ORDER BY seg_no) AS BIGINT) AS t FROM d)
SELECT video_id, dest AS chunk_no, t AS turn_no, min(speaker) AS speaker, string_agg(text, ' ' ORDER BY seg_no) AS text,
  arg_min(start_ms, seg_no) AS start_ms, arg_max(end_ms, seg_no) AS end_ms
FROM e GROUP BY video_id, dest, t""",
    "c3_boundary_times": f"""
WITH t AS (
  SELECT video_id, cand_no, start_ms, row_number() OVER w AS k, count(*) OVER (PARTITION BY video_id, cand_no) AS timed
  FROM {{fx_cand_words}} WHERE word_no % 10 <> 3 WINDOW w AS (PARTITION BY video_id, cand_no ORDER BY word_no)),
l AS (SELECT video_id, cand_no, {_SENTENCES} AS ss FROM {{fx_cands}}),
s AS (SELECT video_id, cand_no, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM l),
n AS (SELECT *, len({_WORDS.format("s")}) AS n FROM s),
b AS (
  SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY video_id, cand_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before,
    CAST(sum(n) OVER (PARTITION BY video_id, cand_no) AS DOUBLE) AS total
  FROM n)
SELECT b.video_id, b.cand_no AS chunk_no, CAST(i + 1 AS INTEGER) AS n, t.start_ms
FROM b JOIN t ON t.video_id = b.video_id AND t.cand_no = b.cand_no AND t.k = least(CAST(floor(before / total * timed) AS BIGINT), timed - 1) + 1
WHERE i IN (0, 2, 4)""",
    "c10_chunk_text": f"""
WITH RECURSIVE l AS (SELECT video_id, turn_no, {_SENTENCES} AS ss FROM {{fx_turns}} WHERE length(text) > 120),
s AS (SELECT video_id, turn_no, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM l),
c AS (SELECT *, unnest(range((length(s) - 1) // 120 + 1)) AS j FROM s),
p AS (
  SELECT video_id, turn_no, length(s) > 120 AS hard, CASE WHEN length(s) > 120 THEN substr(s, j * 120 + 1, 120) ELSE s END AS x,
    row_number() OVER (PARTITION BY video_id, turn_no ORDER BY i, j) AS k
  FROM c),
r(video_id, turn_no, k, n, cur, hard) AS (
  SELECT video_id, turn_no, k, 0, x, hard FROM p WHERE k = 1
  UNION ALL
  SELECT p.video_id, p.turn_no, p.k, CASE WHEN ok THEN r.n ELSE r.n + 1 END, CASE WHEN ok THEN r.cur || ' ' || p.x ELSE p.x END, p.hard
  FROM r JOIN p ON p.video_id = r.video_id AND p.turn_no = r.turn_no AND p.k = r.k + 1,
    LATERAL (SELECT NOT r.hard AND NOT p.hard AND length(r.cur) + 1 + length(p.x) <= 120 AS ok) y)
SELECT video_id, turn_no, n, arg_max(cur, k) AS piece FROM r GROUP BY video_id, turn_no, n
UNION ALL SELECT video_id, turn_no, 0, text FROM {{fx_turns}} WHERE length(text) <= 120""",
    "c12_turn_chunks": f"""
WITH RECURSIVE l AS (SELECT video_id, turn_no, {_SENTENCES} AS ss FROM {{fx_turns}}),
s AS (SELECT video_id, turn_no, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM l),
p AS (
  SELECT video_id, turn_no, x, row_number() OVER (PARTITION BY video_id, turn_no ORDER BY i) AS k
  FROM (SELECT *, {_CLEAN} AS x FROM s) q WHERE x <> ''),
r(video_id, turn_no, k, n, cur) AS (
  SELECT video_id, turn_no, k, 0, x FROM p WHERE k = 1
  UNION ALL
  SELECT p.video_id, p.turn_no, p.k, CASE WHEN ok THEN r.n ELSE r.n + 1 END, CASE WHEN ok THEN r.cur || ' ' || p.x ELSE p.x END
  FROM r JOIN p ON p.video_id = r.video_id AND p.turn_no = r.turn_no AND p.k = r.k + 1,
    LATERAL (SELECT length(r.cur) < 45 AND length(r.cur) + 1 + length(p.x) <= 220 AS ok) y)
SELECT video_id, turn_no, n, arg_max(cur, k) AS piece FROM r GROUP BY video_id, turn_no, n""",
    "c8_plan_parts": """
WITH d AS (SELECT video_id, max(end_ms) AS t, CAST(greatest(1, ceil(max(end_ms) / 50000)) AS INTEGER) AS n FROM {fx_words} GROUP BY ALL),
p AS (SELECT *, CAST(unnest(range(0, n)) AS INTEGER) AS part FROM d)
  SELECT video_id, part, n AS n_parts, t * part // n AS start_ms, t * (part + 1) // n AS end_ms FROM p""",
    "c8_merge_parts": """
SELECT video_id, iv_no % 3 AS part, start_ms + iv_no % 3 * 50000 AS start_ms, end_ms + iv_no % 3 * 50000 AS end_ms,
    CASE WHEN iv_no % 5 = 4 THEN 'guest_chunk' || (iv_no % 3) ELSE 'SPEAKER_' || lpad((iv_no % 3 * 10 + speaker[9:]::INT)::VARCHAR, 2,
    '0') END AS speaker
  FROM {fx_diar}""",
    "c9_batch_rows": _FOLD + ", r AS (SELECT video_id, k, seg_no, 0 AS b, 1 AS c, length(text) AS h FROM s WHERE k = 1 UNION ALL SELECT s.video_id, s.k, s.seg_no, CASE WHEN r.c = 5 OR r.h + length(s.text) > 300 THEN r.b + 1 ELSE r.b END, CASE WHEN r.c = 5 OR r.h + length(s.text) > 300 THEN 1 ELSE r.c + 1 END, CASE WHEN r.c = 5 OR r.h + length(s.text) > 300 THEN length(s.text) ELSE r.h + length(s.text) END FROM r JOIN s ON s.video_id = r.video_id AND s.k = r.k + 1) SELECT video_id, seg_no, CAST(b AS BIGINT) AS batch_no FROM r",
    "c11_force_split": """
WITH RECURSIVE w AS (SELECT video_id, turn_no, word, row_number() OVER (PARTITION BY video_id, turn_no ORDER BY pos) AS k FROM {fx_words}),
r AS (SELECT video_id, turn_no, k, 0 AS n, word AS cur FROM w WHERE k = 1 UNION ALL
  SELECT w.video_id, w.turn_no, w.k, CASE WHEN length(r.cur) + 1 + length(w.word) <= 80 THEN r.n ELSE r.n + 1 END,
    CASE WHEN length(r.cur) + 1 + length(w.word) <= 80 THEN r.cur || ' ' || w.word ELSE w.word END
  FROM r JOIN w ON w.video_id = r.video_id AND w.turn_no = r.turn_no AND w.k = r.k + 1)
  SELECT video_id, turn_no, CAST(n AS INTEGER) AS n, arg_max(cur, k) AS piece FROM r GROUP BY ALL""",
}.items()}
ORACLES["c11_force_split"] = ORACLES["c11_force_split"].replace("GROUP BY ALL", "GROUP BY video_id, turn_no, n")
