"""Queries of timing repair, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.operators import timing as M
from talkloom.plans.fixtures import oracle, view


def _q(fn):
    return lambda spark, d: fn(lambda name: view(spark, d, name))


def _edged(v):
    t = v("fx_turns").select("video_id", "turn_no", F.col("start_ms").alias("turn_start"), F.col("end_ms").alias("turn_end"))
    return v("fx_words").select("video_id", "turn_no", "pos", "word", "start_ms", "end_ms").join(t, ["video_id", "turn_no"])


def _tight(v, by=8):
    """Words squeezed to an eighth of their place in every other turn."""
    f = lambda c: F.when(F.col("turn_no") % 2 == 1, F.col("turn_start") + F.floor((F.col(c) - F.col("turn_start")) / by)).otherwise(F.col(c))
    return _edged(v).withColumn("s", f("start_ms")).withColumn("e", f("end_ms")).withColumn("start_ms", F.col("s")).withColumn("end_ms", F.col("e")).drop("s", "e")


def _lapped(v):
    return _edged(v).withColumn("end_ms", F.col("end_ms") + F.when(F.col("pos") % 3 == 0, 151).otherwise(0))


def _holes(v):
    gone = (F.col("pos") % 9 == 0) | (F.col("pos") % 9 == 1)
    return _edged(v).withColumn("start_ms", F.when(~gone, F.col("start_ms"))).withColumn("end_ms", F.when(~gone, F.col("end_ms")))


def _tiny(v):
    return _edged(v).withColumn("end_ms", F.when(F.col("pos") % 12 < 4, F.col("start_ms") + 30).otherwise(F.col("end_ms")))


def _long(v):
    return _edged(v).withColumn("end_ms", F.col("end_ms") + F.when(F.col("pos") % 5 == 0, 2000).otherwise(0))


def _shifted(v):
    """Every third turn's words come late, every fourth turn's early by half a second."""
    by = F.when(F.col("turn_no") % 3 == 1, 900).when(F.col("turn_no") % 4 == 2, -500).otherwise(0)
    return _edged(v).withColumn("start_ms", F.col("start_ms") + by).withColumn("end_ms", F.col("end_ms") + by)


def _audio(v):
    return v("fx_turns").select("video_id", "turn_no", "speaker", "start_ms", (F.col("end_ms") - F.col("start_ms") + (F.col("video_id") * 7 + F.col("turn_no") * 911) % 1500 - 300).alias("audio_ms"), "end_ms")


def _lines(v):
    edges = v("fx_turns").select("video_id", "turn_no", F.col("start_ms").alias("turn_start"), F.col("end_ms").alias("turn_end"))
    return v("fx_segs").select("video_id", "turn_no", F.col("seg").alias("line_no"), "text").join(edges, ["video_id", "turn_no"])


def _chunks(v):
    return v("fx_segs").select("video_id", "turn_no", F.col("seg").alias("chunk_no"), (F.col("end_ms") - F.col("start_ms")).alias("audio_ms"), F.lit(70).alias("pause_ms"), F.col("start_ms").alias("c0"))


def _chunk_words(v):
    """Words timed from the start of their chunk."""
    rows = v("fx_sent").withColumnRenamed("seg", "chunk_no").join(_chunks(v).select("video_id", "turn_no", "chunk_no", "c0"), ["video_id", "turn_no", "chunk_no"])
    return rows.withColumn("start_ms", F.col("start_ms") - F.col("c0")).withColumn("end_ms", F.col("end_ms") - F.col("c0"))


W = ("video_id", "turn_no", "pos", "start_ms", "end_ms")
QUERIES = {
    "t1_redistribute_turn": _q(lambda v: M.redistribute_turn(_tight(v)).select(*W)),
    "t3_fix_overlaps": _q(lambda v: M.fix_overlaps_mid(_lapped(v)).select(*W)),
    "t5_interpolate_words": _q(lambda v: M.interpolate_words(_holes(v)).select(*W, "interpolated")),
    "t6_spread_micro_runs": _q(lambda v: M.spread_micro_runs(_tiny(v)).select(*W)),
    "t7_cap_long_words": _q(lambda v: M.cap_long_words(_long(v)).select(*W)),
    "t8_bound_words": _q(lambda v: M.bound_words(_long(v)).select(*W)),
    "t10_extend_subtitles": _q(lambda v: M.extend_subtitles(v("fx_segs")).select("video_id", "seg_no", "start_ms", "end_ms")),
    "t12_rescale_words": _q(lambda v: M.rescale_words(_shifted(v)).select(*W)),
    "t13_proportional_timing": _q(lambda v: M.proportional_timing(v("fx_turns"))),
    "t13_proportional_lines": _q(lambda v: M.proportional_lines(_lines(v)).select("video_id", "turn_no", "line_no", "start_ms", "end_ms")),
    "t13_proportional_turns": _q(
        lambda v: M.proportional_turns(v("fx_turns").withColumn("duration_ms", F.lit(77_777))).select("video_id", "turn_no", "tts_start", "tts_end")
    ),
    "t18_fit_audio": _q(
        lambda v: M.fit_audio(_audio(v).withColumn("original_ms", F.col("end_ms") - F.col("start_ms"))).select(
            "video_id", "turn_no", "tempo", F.array_join(F.transform("factors", lambda x: x.cast("string")), ",").alias("factors"), "fitted_ms", "padded_ms"
        )
    ),
    "t20_clip_turn_words": _q(lambda v: M.clip_turn_words(v("fx_words"), M.clip_turns(_audio(v))).select(*W)),
    "t21_timeline_words": _q(lambda v: M.timeline_words(M.chunk_words(_chunk_words(v), _chunks(v)), M.linear_timeline(_audio(v))).select(*W)),
    "t18_tempo_plan": _q(lambda v: _audio(v).select("video_id", "turn_no", M.tempo_plan(F.col("audio_ms"), F.col("end_ms") - F.col("start_ms")).alias("tempo"))),
    "t19_scale_offsets": _q(lambda v: M.scale_offsets(v("fx_segs").withColumn("f", F.lit(1.0) + (F.col("seg_no") % 4) / 8), F.col("f"), ["start_ms", "end_ms"]).select("video_id", "seg_no", "start_ms", "end_ms")),
    "t20_clip_turns": _q(lambda v: M.clip_turns(_audio(v)).select("video_id", "turn_no", "audio_ms")),
    "t21_linear_timeline": _q(lambda v: M.linear_timeline(_audio(v)).select("video_id", "turn_no", "tts_start", "tts_end")),
    "t22_tail_trim": _q(lambda v: M.tail_trim(v("fx_cands").select("video_id", "cand_no", (F.col("end_ms") - F.col("start_ms")).alias("audio_ms"), (F.col("end_ms") - F.col("start_ms") - F.col("cand_no") % 5 * 700).alias("last_word_ms")))),
    "a19_translation_fit": _q(lambda v: M.translation_fit(v("fx_segs")).select("video_id", "seg_no", "n_words", "target", "status", "tempo")),
    "c14_speaking_plan": _q(lambda v: M.speaking_plan(v("fx_segs").select("video_id", "turn_no", F.col("seg").alias("chunk_no"), F.size(F.split("text", " ")).alias("n_words")).join(v("fx_turns").select("video_id", "turn_no", (F.col("end_ms") - F.col("start_ms")).alias("turn_ms")), ["video_id", "turn_no"]))),
}

_E = """
e AS (SELECT w.video_id, w.turn_no, w.pos, w.word, w.start_ms AS s, w.end_ms AS e, t.start_ms AS ts, t.end_ms AS te
  FROM {fx_words} w JOIN {fx_turns} t ON t.video_id = w.video_id AND t.turn_no = w.turn_no)"""
_AU = """
au AS (SELECT video_id, turn_no, speaker, start_ms, end_ms, end_ms - start_ms + (video_id * 7 + turn_no * 911) % 1500 - 300 AS audio_ms
  FROM {fx_turns})"""
_PT = "PARTITION BY video_id, turn_no"
_PT2 = "PARTITION BY t.video_id, t.turn_no"
_LONG = f"{_E}, l AS (SELECT *, e + CASE WHEN pos % 5 = 0 THEN 2000 ELSE 0 END AS e2 FROM e)"
ORACLES = {k: oracle(v) for k, v in {
    "t1_redistribute_turn": f"""
WITH {_E}, q AS (SELECT video_id, turn_no, pos, ts, te, CASE WHEN turn_no % 2 = 1 THEN ts + (s - ts) // 8 ELSE s END AS s,
    CASE WHEN turn_no % 2 = 1 THEN ts + (e - ts) // 8 ELSE e END AS e
  FROM e),
r AS (SELECT *, count(*) OVER w AS n, max(e) OVER w - min(s) OVER w AS sp, row_number() OVER ({_PT} ORDER BY pos) AS k FROM q
  WINDOW w AS ({_PT}))
  SELECT video_id, turn_no, pos, CASE WHEN n >= 8 AND sp / n < 100 AND (te - ts) / n >= 150 THEN ts + (te - ts) * (k - 1) // n ELSE s END
    AS start_ms, CASE WHEN n >= 8 AND sp / n < 100 AND (te - ts) / n >= 150 THEN ts + (te - ts) * k // n ELSE e END AS end_ms
  FROM r""",
    "t3_fix_overlaps": f"""
WITH {_E}, q AS (SELECT *, e + CASE WHEN pos % 3 = 0 THEN 151 ELSE 0 END AS e2 FROM e),
r AS (SELECT *, lead(s) OVER w AS ns, lag(e2) OVER w AS pe FROM q WINDOW w AS ({_PT} ORDER BY pos))
  SELECT video_id, turn_no, pos, CASE WHEN pe > s THEN (pe + s) // 2 + 10 ELSE s END AS start_ms,
    CASE WHEN e2 > ns THEN (e2 + ns) // 2 - 10 WHEN ns IS NULL THEN least(e2, te) ELSE e2 END AS end_ms
  FROM r""",
    "t5_interpolate_words": f"""
WITH {_E}, q AS (SELECT *, pos % 9 IN (0, 1) AS g FROM e),
a AS (SELECT *, coalesce(last_value(CASE WHEN NOT g THEN e END IGNORE NULLS) OVER ({_PT}
  ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ts) AS b, coalesce(first_value(CASE WHEN NOT g THEN s END IGNORE NULLS) OVER ({_PT}
  ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), te) AS f, count(*) FILTER (NOT g) OVER ({_PT} ORDER BY pos) AS run
  FROM q),
c AS (SELECT *, count(*) OVER ({_PT}, run, g) AS n, row_number() OVER ({_PT}, run, g ORDER BY pos) - 1 AS k FROM a),
d AS (SELECT *, greatest(250.0::DOUBLE, greatest(0, f - b) / n) AS d FROM c)
  SELECT video_id, turn_no, pos, CASE WHEN g THEN CAST(round_even(b + k * d, 0) AS BIGINT) ELSE s END AS start_ms,
    CASE WHEN g THEN CAST(round_even(b + (k + 1) * d, 0) AS BIGINT) ELSE e END AS end_ms, g AS interpolated
  FROM d""",
    "t6_spread_micro_runs": f"""
WITH {_E},
q AS (SELECT *, CASE WHEN pos % 12 < 4 THEN s + 30 ELSE e END AS e2 FROM e),
t AS (SELECT *, e2 - s < 50 AS g FROM q),
-- The first word of the next turn.
nt AS (SELECT video_id, turn_no, lead(f) OVER (PARTITION BY video_id ORDER BY turn_no) AS nx
  FROM (SELECT video_id, turn_no, arg_min(s, pos) AS f FROM e GROUP BY ALL) y),
a AS (
  SELECT t.*, nx, first_value(CASE WHEN NOT g THEN s END IGNORE NULLS) OVER ({_PT2} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f,
    count(*) FILTER (NOT g) OVER ({_PT2} ORDER BY pos) AS run
  FROM t JOIN nt ON nt.video_id = t.video_id AND nt.turn_no = t.turn_no),
c AS (
  SELECT *, count(*) OVER x AS n, min(s) OVER x AS m, row_number() OVER ({_PT}, run, g ORDER BY pos) - 1 AS k
  FROM a WINDOW x AS ({_PT}, run, g)),
d AS (SELECT *, greatest(120, (coalesce(f, CASE WHEN nx > m THEN m + (nx - m) * 4 // 5 ELSE te END) - m) // n) AS u FROM c)
SELECT video_id, turn_no, pos, CASE WHEN g AND n >= 3 THEN m + k * u ELSE s END AS start_ms, CASE WHEN g AND n >= 3 THEN m + (k + 1) * u ELSE e2 END AS end_ms
FROM d""",
    "t7_cap_long_words": f"""
WITH {_LONG} SELECT video_id, turn_no, pos, s AS start_ms, least(e2, s + least(3000, length(word) * 100 + 200)) AS end_ms FROM l""",
    "t8_bound_words": f"""
WITH {_LONG}, n AS (SELECT *, length(regexp_replace(word, '[.,!?;:—–\\-…\"''«»()]', '', 'g')) AS n FROM l),
c AS (SELECT *, greatest(ts, least(s, te)) AS s2, greatest(greatest(ts, least(s, te)), least(e2, te)) AS e3 FROM n WHERE n > 0)
  SELECT video_id, turn_no, pos, s2 AS start_ms, CASE WHEN e3 - s2 < greatest(250, n * 60) THEN least(te, s2 + greatest(250,
    n * 60)) WHEN e3 - s2 > least(3000, n * 150 + 300) THEN s2 + least(3000, n * 150 + 300) ELSE e3 END AS end_ms
  FROM c""",
    "t10_extend_subtitles": """
WITH a AS (SELECT *, lead(start_ms) OVER (PARTITION BY video_id ORDER BY seg_no) - end_ms AS gap FROM {fx_segs})
  SELECT video_id, seg_no, start_ms, end_ms + CASE WHEN gap > 50 AND least(gap - 50, 500) > 20 THEN least(gap - 50, 500) ELSE 0 END AS end_ms
  FROM a""",
    "t12_rescale_words": f"""
WITH {_E}, q AS (SELECT video_id, turn_no, pos, ts, te, s + b AS s, e + b AS e
  FROM (SELECT *, CASE WHEN turn_no % 3 = 1 THEN 900 WHEN turn_no % 4 = 2 THEN -500 ELSE 0 END AS b FROM e) x),
r AS (SELECT *, first_value(s) OVER w AS f, last_value(e) OVER w AS l, count(*) OVER w AS n, row_number() OVER ({_PT} ORDER BY pos) - 1 AS k
  FROM q WINDOW w AS ({_PT} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, f < ts OR l > te AS o FROM r)
  SELECT video_id, turn_no, pos, greatest(ts, least(te,
    CASE WHEN o AND l - f > 10 THEN ts + (s - f) * (te - ts) // (l - f) WHEN o THEN ts + (te - ts) * k // n ELSE s END)) AS start_ms,
    greatest(ts, least(te, CASE WHEN o AND l - f > 10 THEN ts + (e - f) * (te - ts) // (l - f) WHEN o THEN ts + (te - ts) * (k + 1) // n
    ELSE e END)) AS end_ms
  FROM c""",
    "t13_proportional_timing": f"""
WITH {_E}, c AS (SELECT *, length(word) AS c FROM e),
r AS (SELECT *, CAST(sum(c) OVER ({_PT}
  ORDER BY pos) AS BIGINT) AS run, CAST(sum(c) OVER ({_PT}) AS BIGINT) AS al, CAST(row_number() OVER ({_PT}
  ORDER BY pos) - 1 AS INTEGER) AS k FROM c)
  SELECT video_id, turn_no, k, word, ts + (te - ts) * (run - c) // al AS start_ms, ts + (te - ts) * run // al AS end_ms FROM r""",
    "t18_tempo_plan": f"""
WITH {_AU}, t AS (SELECT video_id, turn_no, audio_ms, end_ms - start_ms AS g, audio_ms / (end_ms - start_ms) AS t FROM au)
  SELECT video_id, turn_no, CASE WHEN audio_ms > 0 AND g > 0 THEN round(CASE WHEN t BETWEEN 0.98 AND 1.02 THEN 1.0 ELSE greatest(0.9, least(1.25,
    t)) END::DOUBLE, 6) END AS tempo
  FROM t""",
    "t19_scale_offsets": """
SELECT video_id, seg_no, CAST(round_even(start_ms * (1 + seg_no % 4 / 8), 0) AS BIGINT) AS start_ms,
    CAST(round_even(end_ms * (1 + seg_no % 4 / 8), 0) AS BIGINT) AS end_ms
  FROM {fx_segs}""",
    "t20_clip_turns": f"""
WITH {_AU}, s AS (SELECT *, min(speaker) OVER w <> max(speaker) OVER w AS several, lead(start_ms) OVER (PARTITION BY video_id
  ORDER BY turn_no) - start_ms AS slot FROM au WINDOW w AS (PARTITION BY video_id))
  SELECT video_id, turn_no, CASE WHEN several AND audio_ms > slot + 120 THEN slot + 120 ELSE audio_ms END AS audio_ms FROM s""",
    "t21_linear_timeline": f"""
WITH {_AU}, s AS (SELECT *, CAST(coalesce(sum(audio_ms + 250) OVER (PARTITION BY video_id
  ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM au)
  SELECT video_id, turn_no, a AS tts_start, a + audio_ms AS tts_end FROM s""",
    "t22_tail_trim": """
WITH c AS (SELECT video_id, cand_no, end_ms - start_ms AS a, end_ms - start_ms - cand_no % 5 * 700 AS l FROM {fx_cands})
  SELECT video_id, cand_no, CASE WHEN l > 0 AND a > l + 2000 THEN l + 1500 ELSE a END AS audio_ms, l AS last_word_ms FROM c""",
    "a19_translation_fit": """
WITH n AS (SELECT *, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_words, (end_ms - start_ms) / 1000 AS d FROM {fx_segs}),
t AS (SELECT *, greatest(3, CAST(trunc(d * 2.3::DOUBLE) AS INTEGER)) AS target FROM n)
  SELECT video_id, seg_no, n_words, target,
    CASE WHEN n_words < trunc(target * 0.85::DOUBLE) THEN 'SHORT' WHEN n_words > trunc(target * 1.15::DOUBLE) THEN 'LONG' ELSE 'OK' END
    AS status, round(n_words / 2.3::DOUBLE / d, 6) AS tempo
  FROM t""",
    "c14_speaking_plan": f"""
WITH c AS (
  SELECT s.video_id, s.turn_no, s.seg AS chunk_no, CAST(len(string_split(s.text, ' ')) AS INTEGER) AS n_words, t.end_ms - t.start_ms AS turn_ms
  FROM {{fx_segs}} s JOIN {{fx_turns}} t ON t.video_id = s.video_id AND t.turn_no = s.turn_no),
p AS (
  SELECT *, lead(chunk_no) OVER ({_PT} ORDER BY chunk_no) IS NULL AS last,
    CASE WHEN n_words >= 18 THEN 180 WHEN n_words >= 12 THEN 140 WHEN n_words >= 7 THEN 100 WHEN n_words >= 4 THEN 70 ELSE 50 END AS w
  FROM c),
b AS (
  SELECT *, CASE WHEN last THEN 0 ELSE w END AS p, CAST(sum(CASE WHEN last THEN 0 ELSE w END) OVER ({_PT}) AS BIGINT) AS ap,
    turn_ms // 4 AS bu, CAST(sum(n_words) OVER ({_PT}) AS BIGINT) AS an
  FROM p),
d AS (SELECT *, CASE WHEN ap > bu THEN p * bu // ap ELSE p END AS q FROM b),
e AS (SELECT *, turn_ms - CAST(sum(q) OVER ({_PT}) AS BIGINT) AS speech FROM d),
f AS (SELECT *, greatest(120, speech * n_words // an) AS own FROM e),
g AS (SELECT *, coalesce(sum(own) OVER ({_PT} ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT video_id, turn_no, chunk_no, n_words, turn_ms, CAST(q AS BIGINT) AS pause_ms,
  CAST(CASE WHEN last THEN greatest(120, speech - before) ELSE own END AS BIGINT) AS speech_ms
FROM g""",
    "t13_proportional_lines": f"""
WITH l AS (
  SELECT s.video_id, s.turn_no, s.seg AS line_no, len(string_split(s.text, ' ')) AS c, t.start_ms AS a, t.end_ms - t.start_ms AS d
  FROM {{fx_segs}} s JOIN {{fx_turns}} t ON t.video_id = s.video_id AND t.turn_no = s.turn_no),
r AS (SELECT *, CAST(sum(c) OVER ({_PT} ORDER BY line_no) AS BIGINT) AS run, CAST(sum(c) OVER ({_PT}) AS BIGINT) AS al FROM l)
SELECT video_id, turn_no, line_no, a + d * (run - c) // al AS start_ms, a + d * run // al AS end_ms FROM r""",
    "t13_proportional_turns": """
WITH r AS (
  SELECT video_id, turn_no, length(text) AS c, CAST(sum(length(text)) OVER (PARTITION BY video_id ORDER BY turn_no) AS BIGINT) AS run,
    CAST(sum(length(text)) OVER (PARTITION BY video_id) AS BIGINT) AS al
  FROM {fx_turns})
SELECT video_id, turn_no, 77777 * (run - c) // al AS tts_start, 77777 * run // al AS tts_end FROM r""",
    "t18_fit_audio": f"""
WITH {_AU},
t AS (SELECT video_id, turn_no, audio_ms, end_ms - start_ms AS g, audio_ms / (end_ms - start_ms) AS t FROM au),
u AS (
  SELECT *, CASE WHEN abs(audio_ms - g) > 200 AND audio_ms > 0 AND g > 0 AND NOT t BETWEEN 0.98 AND 1.02
    THEN round(greatest(0.9::DOUBLE, least(1.25::DOUBLE, t)), 6) ELSE 1.0::DOUBLE END AS tempo
  FROM t),
f AS (SELECT *, CAST(round_even(audio_ms / tempo, 0) AS BIGINT) AS fitted_ms FROM u)
SELECT video_id, turn_no, tempo, CASE WHEN tempo = 1 THEN '' ELSE CAST(tempo AS VARCHAR) END AS factors, fitted_ms, greatest(fitted_ms, g) AS padded_ms FROM f""",
    "t20_clip_turn_words": f"""
WITH {_AU},
s AS (SELECT *, min(speaker) OVER w <> max(speaker) OVER w AS several, lead(start_ms) OVER (PARTITION BY video_id ORDER BY turn_no) - start_ms AS slot
  FROM au WINDOW w AS (PARTITION BY video_id)),
c AS (SELECT video_id, turn_no, start_ms + CASE WHEN several AND audio_ms > slot + 120 THEN slot + 120 ELSE audio_ms END AS stop FROM s)
SELECT w.video_id, w.turn_no, w.pos, least(w.start_ms, stop) AS start_ms, least(w.end_ms, stop) AS end_ms
FROM {{fx_words}} w JOIN c ON c.video_id = w.video_id AND c.turn_no = w.turn_no""",
    "t21_timeline_words": f"""
WITH {_AU},
s AS (SELECT *, CAST(coalesce(sum(audio_ms + 250) OVER (PARTITION BY video_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM au),
c AS (
  SELECT video_id, turn_no, seg, CAST(coalesce(sum(end_ms - start_ms + 70) OVER ({_PT} ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b,
    start_ms AS c0
  FROM {{fx_segs}})
SELECT w.video_id, w.turn_no, w.pos, w.start_ms - c0 + b + a AS start_ms, w.end_ms - c0 + b + a AS end_ms
FROM {{fx_sent}} w JOIN c ON c.video_id = w.video_id AND c.turn_no = w.turn_no AND c.seg = w.seg JOIN s ON s.video_id = w.video_id AND s.turn_no = w.turn_no""",
}.items()}
