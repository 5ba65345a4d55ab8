"""Queries of turns, windows and speaker statistics, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkloom.operators import selection as L
from talkloom.operators import turns as T
from talkloom.operators.intervals import candidate_pairs
from talkloom.plans.fixtures import oracle, view


def _q(fn):
    return lambda spark, d: fn(lambda name: view(spark, d, name))


def _cand_turns(v):
    """Segments as turns of the candidate they begin in."""
    c = v("fx_cands").select("video_id", "cand_no", F.floor(F.col("start_ms") / 30000).alias("b"))
    s = v("fx_segs").select("video_id", F.col("seg_no").alias("turn_no"), "speaker", "text", "start_ms", "end_ms", F.floor(F.col("start_ms") / 30000).alias("b"))
    return s.join(c, ["video_id", "b"]).drop("b")


def _durations(v):
    return v("fx_words").groupBy("video_id").agg(F.max("end_ms").alias("duration_ms"))


def _timing(v):
    """Turn timings as speech synthesis would leave them: every fifth is missing, every seventh begins early."""
    early = F.when(F.col("turn_no") % 7 == 4, 900).otherwise(0)
    gone = (F.col("video_id") + F.col("turn_no")) % 5 == 0
    return v("fx_turns").select("video_id", "turn_no", F.when(~gone, F.col("start_ms") - early).alias("tts_start"), F.when(~gone, F.col("end_ms")).alias("tts_end"), F.when(gone, "none").when(F.col("turn_no") % 2 == 0, "words").otherwise("turn").alias("source"))


def _share(v):
    c = v("fx_over").select("video_id", "cand_no", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    pairs = candidate_pairs(v("fx_turns").drop("text"), c, (F.col("start_ms"), F.col("end_ms")), (F.col("r_start"), F.col("r_end")))
    return T.talk_share(c, v("fx_turns"), pairs)


def _tight(v):
    """Words squeezed in every fifth turn."""
    first = F.min("start_ms").over(Window.partitionBy("video_id", "turn_no"))
    squeezed = lambda c: F.when(F.col("turn_no") % 2 == 1, first + F.floor((F.col(c) - first) / 4)).otherwise(F.col(c))
    return v("fx_words").select("video_id", "turn_no", "pos", "word", squeezed("start_ms").alias("start_ms"), squeezed("end_ms").alias("end_ms"))


def _six(v):
    """Segments in chunks of six."""
    return v("fx_segs").withColumn("chunk", F.floor(F.col("seg_no") / 6))


def _said(words: str):
    return F.array_join(F.transform(words, lambda w: w["word"]), " ")


def _part_timed(v):
    """Words, those of every fourth turn without times."""
    timed = lambda c: F.when(F.col("turn_no") % 4 != 1, F.col(c))
    return v("fx_words").select("video_id", "turn_no", timed("start_ms").alias("start_ms"), timed("end_ms").alias("end_ms"))


def _paused(v):
    """Segments, every third of which lasts next to nothing, so that a silence follows it."""
    return v("fx_segs").withColumn("end_ms", F.when(F.col("seg_no") % 3 == 1, F.col("start_ms") + 100).otherwise(F.col("end_ms")))


QUERIES = {
    "a1_build_chunks": _q(
        lambda v: T.build_chunks(_six(v), "chunk", v("fx_seg_words")).select(
            "video_id", "chunk", "start_ms", "end_ms", "text", F.array_join("speakers", ",").alias("speakers"), _said("words").alias("words"), F.size("words").alias("n_words")
        )
    ),
    "a1_chunk_turns": _q(lambda v: T.chunk_turns(_six(v), "chunk", v("fx_seg_words").withColumn("end_ms", F.col("end_ms") + F.col("pos") % 3 * 50))),
    "a2_speaker_stats": _q(lambda v: T.speaker_stats(v("fx_segs"))),
    "a3_diar_quality": _q(lambda v: T.diar_quality(v("fx_diar"), _durations(v))),
    "a4_talk_share": _q(_share),
    "a6_speakers_in_order": _q(lambda v: T.speakers_in_order(v("fx_turns"))),
    "a7_speech_rate": _q(lambda v: T.speech_rate(v("fx_words"))),
    "a8_voice_rate": _q(lambda v: T.voice_rate(v("fx_turns"))),
    "a10_min_highlights": _q(lambda v: T.min_highlights(v("fx_segs"))),
    "a11_timing_coverage": _q(lambda v: T.timing_coverage(_timing(v))),
    "a12_timing_quality": _q(lambda v: T.timing_quality(_tight(v))),
    "a16_sync_report": _q(lambda v: T.sync_report(_timing(v))),
    "a17_timing_sources": _q(lambda v: L.timing_sources(_timing(v)).withColumnRenamed("n", "n_turns")),
    "a18_allocate_samples": _q(lambda v: T.allocate_samples(T.speaker_stats(v("fx_segs")).select("video_id", "speaker", "total_ms"), 12)),
    "a22_dub_summary": _q(lambda v: T.dub_summary(_cand_turns(v))),
    "w1_attach_context": _q(lambda v: T.attach_context(v("fx_cands"), _durations(v))),
    "w3_merge_turns": _q(lambda v: T.merge_turns(v("fx_segs").withColumn("turn_no", F.col("seg_no")))),
    "w3_merged_words": _q(
        lambda v: T.merged_words(v("fx_seg_words").withColumn("turn_no", F.col("seg_no")), v("fx_segs").withColumn("turn_no", F.col("seg_no"))).select(
            "video_id", "turn_no", "pos", "word", "start_ms"
        )
    ),
    "w4_split_turns": _q(lambda v: T.split_turns_by_word_speaker(v("fx_words").withColumn("ws", F.when(F.col("word_no") % 9 < 6, F.concat(F.lit("SPEAKER_0"), (F.floor(F.col("word_no") / 3) % 3).cast("string")))).withColumnRenamed("ws", "heard"), "heard")),
    "w5_refine_turn_edges": _q(
        lambda v: T.refine_turn_edges(v("fx_diar").select("video_id", F.col("iv_no").alias("turn_no"), "start_ms", "end_ms"), _part_timed(v))
    ),
    "w6_phrases_sentence": _q(lambda v: T.phrases(v("fx_words"))),
    "w7_phrases_pause": _q(lambda v: T.phrases(v("fx_words"), 300, False)),
    "w8_transcript_gaps": _q(lambda v: T.transcript_gaps(_paused(v))),
    "w9_turn_gaps": _q(lambda v: T.turn_gaps(v("fx_diar").withColumnRenamed("iv_no", "turn_no")).select("video_id", "turn_no", "gap_ms")),
    "w18_trim_dead_start": _q(lambda v: T.trim_dead_start(v("fx_cands").withColumn("start_ms", F.greatest(F.lit(0), F.col("start_ms") - (F.col("cand_no") % 3) * 1400)), _cand_turns(v)).select("video_id", "cand_no", "start_ms", "duration_ms")),
}

_CT = """
ct AS (SELECT s.video_id, s.seg_no AS turn_no, s.speaker, s.text, s.start_ms, s.end_ms, c.cand_no
  FROM {fx_segs} s JOIN {fx_cands} c ON s.video_id = c.video_id AND s.start_ms // 30000 = c.start_ms // 30000)"""
_NW = "len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))"
_DUR = "dur AS (SELECT video_id, max(end_ms) AS duration_ms FROM {fx_words} GROUP BY video_id)"
_TIM = """
tim AS (SELECT video_id, turn_no, CASE WHEN (video_id + turn_no) % 5 <> 0 THEN start_ms - CASE WHEN turn_no % 7 = 4 THEN 900 ELSE 0 END END
    AS tts_start, CASE WHEN (video_id + turn_no) % 5 <> 0 THEN end_ms END AS tts_end,
    CASE WHEN (video_id + turn_no) % 5 = 0 THEN 'none' WHEN turn_no % 2 = 0 THEN 'words' ELSE 'turn' END AS source
  FROM {fx_turns})"""
_ST = f"""
st AS (SELECT video_id, speaker, count(*) AS n_segments, CAST(sum({_NW}) AS BIGINT) AS n_words,
    CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, min(end_ms - start_ms) AS min_ms, max(end_ms - start_ms) AS max_ms,
    round(avg(end_ms - start_ms), 3) AS avg_ms
  FROM {{fx_segs}} GROUP BY ALL)"""


def _phrases(cut: str) -> str:
    return f"WITH a AS (SELECT *, CASE WHEN {cut} THEN 1 ELSE 0 END AS c FROM (SELECT *, lag(word) OVER w AS pw, start_ms - lag(end_ms) OVER w AS gap FROM {{fx_words}} WINDOW w AS (PARTITION BY video_id, turn_no ORDER BY pos)) x), b AS (SELECT *, sum(c) OVER (PARTITION BY video_id, turn_no ORDER BY pos) + 1 AS k FROM a), g AS (SELECT video_id, turn_no, k, string_agg(word, ' ' ORDER BY pos) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words FROM b GROUP BY ALL) SELECT video_id, turn_no, CAST(k AS BIGINT) AS phrase_no, text, start_ms, end_ms, n_words, greatest(100, end_ms - start_ms) AS duration_ms, coalesce(greatest(0, lead(start_ms) OVER (PARTITION BY video_id, turn_no ORDER BY k) - end_ms), 0) AS pause_after FROM g"


ORACLES = {k: oracle(v) for k, v in {
    "a1_build_chunks": """
WITH s AS (SELECT *, seg_no // 6 AS chunk FROM {fx_segs}),
f AS (SELECT video_id, chunk, speaker, min(seg_no) AS m FROM s GROUP BY ALL),
sp AS (SELECT video_id, chunk, string_agg(speaker, ',' ORDER BY m) AS speakers FROM f GROUP BY ALL),
w AS (
  SELECT video_id, seg_no // 6 AS chunk, string_agg(word, ' ' ORDER BY seg_no, pos) AS words, CAST(count(*) AS INTEGER) AS n_words
  FROM {fx_seg_words} GROUP BY ALL),
c AS (
  SELECT video_id, chunk, arg_min(start_ms, seg_no) AS start_ms, arg_max(end_ms, seg_no) AS end_ms, string_agg(text, ' ' ORDER BY seg_no) AS text
  FROM s GROUP BY ALL)
SELECT * FROM c JOIN sp USING (video_id, chunk) JOIN w USING (video_id, chunk)""",
    "a1_chunk_turns": """
WITH s AS (SELECT *, seg_no // 6 AS chunk FROM {fx_segs}),
a AS (
  SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c
  FROM s WINDOW w AS (PARTITION BY video_id, chunk ORDER BY seg_no)),
b AS (SELECT *, sum(c) OVER (PARTITION BY video_id, chunk ORDER BY seg_no) AS k FROM a),
e AS (SELECT video_id, seg_no, min(start_ms) AS a, max(end_ms + pos % 3 * 50) AS z FROM {fx_seg_words} GROUP BY ALL)
SELECT b.video_id, chunk, min(b.seg_no) AS turn_no, min(speaker) AS speaker, string_agg(text, ' ' ORDER BY b.seg_no) AS text, min(e.a) AS start_ms, max(e.z) AS end_ms
FROM b JOIN e ON e.video_id = b.video_id AND e.seg_no = b.seg_no GROUP BY b.video_id, chunk, k""",
    "a2_speaker_stats": f"WITH {_ST} SELECT *, round(total_ms * 100 / sum(total_ms) OVER (PARTITION BY video_id), 4) AS share_pct FROM st",
    "a3_diar_quality": f"""
WITH {_DUR}, b AS (SELECT video_id, speaker, sum(end_ms - start_ms) AS t, count(*) FILTER (end_ms - start_ms < 300) AS s FROM {{fx_diar}}
  GROUP BY ALL)
  SELECT b.video_id, CAST(sum(s) AS BIGINT) AS n_short, count(*) AS n_speakers, count(*) > 1 AND max(t) > 0.9 * sum(t) AS dominated,
    count(*) > 5 AS too_many, count(*) = 1 AS single, round(sum(t) / any_value(duration_ms), 6) AS speech_ratio
  FROM b LEFT JOIN dur USING (video_id) GROUP BY b.video_id""",
    "a4_talk_share": """
WITH p AS (SELECT c.video_id, c.cand_no, t.speaker, t.turn_no, least(t.end_ms, c.end_ms) - greatest(t.start_ms, c.start_ms) AS o
  FROM {fx_over} c JOIN {fx_turns} t ON c.video_id = t.video_id AND t.start_ms < c.end_ms AND t.end_ms > c.start_ms),
b AS (SELECT video_id, cand_no, speaker, sum(o) AS t, min(turn_no) AS m FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, cand_no
  ORDER BY t DESC, m) AS n, sum(t) OVER (PARTITION BY video_id, cand_no) AS a FROM b)
  SELECT video_id, cand_no, speaker AS primary_speaker, round(t * 100 / a, 4) AS share_pct FROM r WHERE n = 1""",
    "a6_speakers_in_order": """
WITH m AS (SELECT video_id, speaker, min(turn_no) AS m FROM {fx_turns} GROUP BY ALL)
  SELECT video_id, speaker, CAST(row_number() OVER (PARTITION BY video_id ORDER BY m, speaker) - 1 AS INTEGER) AS rank FROM m""",
    "a7_speech_rate": """
SELECT video_id, turn_no, round(CASE WHEN count(*) < 2 OR (max(end_ms) - min(start_ms)) / 1000 <= 0.1 THEN 140::DOUBLE / 60 ELSE greatest(1.0,
    least(5.0, count(*) / ((max(end_ms) - min(start_ms)) / 1000)))::DOUBLE END, 6) AS words_per_s
  FROM {fx_words} GROUP BY ALL""",
    "a8_voice_rate": f"""
WITH t AS (SELECT video_id, speaker, end_ms - start_ms AS d, len(list_filter(string_split_regex(regexp_replace(text, '\\[[A-Za-z0-9_]+\\] ?', '',
    'g'), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS n
  FROM {{fx_turns}})
  SELECT video_id, speaker, round(coalesce(greatest(1.5, least(4.0,
    sum(n) FILTER (d >= 100 AND n > 0) * 1000 / sum(d) FILTER (d >= 100 AND n > 0)))::DOUBLE, 2.5), 6) AS words_per_s
  FROM t GROUP BY ALL""",
    "a10_min_highlights": """
SELECT video_id, arg_max(end_ms, seg_no) AS duration_ms, CAST(3 + arg_max(end_ms, seg_no) // 1200000 AS INTEGER) AS n_min FROM {fx_segs}
  GROUP BY ALL""",
    "a11_timing_coverage": f"""
WITH {_TIM}
  SELECT video_id, round(avg(CASE WHEN tts_end - tts_start >= 100 THEN 1 ELSE 0 END), 6) AS coverage,
    avg(CASE WHEN tts_end - tts_start >= 100 THEN 1 ELSE 0 END) >= 0.7 AS valid, coalesce(string_agg(turn_no::VARCHAR, ','
  ORDER BY turn_no) FILTER (NOT coalesce(tts_end - tts_start >= 100, false)), '') AS missing FROM tim GROUP BY ALL""",
    "a12_timing_quality": """
WITH q AS (SELECT video_id, turn_no, pos, CASE WHEN turn_no % 2 = 1 THEN f + (start_ms - f) // 4 ELSE start_ms END AS s,
    CASE WHEN turn_no % 2 = 1 THEN f + (end_ms - f) // 4 ELSE end_ms END AS e
  FROM (SELECT *, min(start_ms) OVER (PARTITION BY video_id, turn_no) AS f FROM {fx_words}) x),
g AS (SELECT *, e - s < 150 AS fast, lead(s) OVER w - e AS gap FROM q WINDOW w AS (PARTITION BY video_id, turn_no ORDER BY pos)),
b AS (SELECT *, fast AND gap < 50 AND coalesce(lag(gap) OVER (PARTITION BY video_id, turn_no ORDER BY pos), 50) >= 50 AS bunch FROM g),
t AS (SELECT video_id, turn_no, max(e) > min(s) AS ok, count(gap) AS n, count(*) FILTER (fast AND gap IS NOT NULL) AS f,
    count(*) FILTER (bunch AND gap IS NOT NULL) AS k
  FROM b GROUP BY ALL),
a AS (SELECT video_id, CAST(sum(n) FILTER (ok) AS BIGINT) AS n_words, CAST(sum(f) FILTER (ok) AS BIGINT) AS n_fast,
    CAST(sum(k) FILTER (ok) AS BIGINT) AS n_bunches, count(*) FILTER (ok AND (f > 0.3 * n OR k > 0)) AS n_bad, count(*) AS n_turns
  FROM t GROUP BY video_id)
  SELECT *, NOT (n_fast > 0.3 * n_words OR n_bunches > 0.5 * n_turns OR n_bad > 0.6 * n_turns OR n_words = 0) AS acceptable FROM a""",
    "a16_sync_report": f"""
WITH {_TIM}, o AS (SELECT *, greatest(0, lag(tts_end) OVER (PARTITION BY video_id ORDER BY turn_no) - tts_start) AS x FROM tim)
  SELECT video_id, count(*) AS n_turns, count(*) FILTER (tts_end - tts_start >= 100) AS n_timed, count(*) FILTER (x > 0) AS n_overlaps,
    CAST(coalesce(sum(x), 0) AS BIGINT) AS overlap_ms
  FROM o GROUP BY video_id""",
    "a17_timing_sources": f"WITH {_TIM} SELECT video_id, source, count(*) AS n_turns FROM tim GROUP BY ALL",
    "a18_allocate_samples": f"""
WITH {_ST}
  SELECT video_id, speaker, total_ms, CAST(1 + floor(total_ms / sum(total_ms) OVER w * greatest(0, 12 - count(*) OVER w)) AS INTEGER) AS n_samples
  FROM st WINDOW w AS (PARTITION BY video_id)""",
    "a22_dub_summary": f"""
WITH {_CT}, a AS (SELECT video_id, cand_no, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, CAST(sum({_NW}) AS BIGINT) AS n_words
  FROM ct GROUP BY ALL)
  SELECT *, round(n_words / 1.8::DOUBLE, 6) AS natural_s, round(n_words / 1.8::DOUBLE * 1000 / speech_ms, 6) AS tempo,
    n_words / 1.8::DOUBLE * 1000 / speech_ms > 1.25 AS overflow
  FROM a""",
    "w1_attach_context": f"""
WITH {_DUR}, x AS (SELECT c.*, duration_ms, lag(text) OVER w AS p, lead(text) OVER w AS n, lag(cand_no) OVER w IS NULL AS f,
    lead(cand_no) OVER w IS NULL AS l
  FROM {{fx_cands}} c JOIN dur USING (video_id) WINDOW w AS (PARTITION BY video_id ORDER BY cand_no))
  SELECT video_id, cand_no, CASE WHEN coalesce(p, '') = '' THEN 'Unknown' WHEN len(string_split(p,
    ' ')) > 100 THEN array_to_string(string_split(p, ' ')[1:100], ' ') || '...' ELSE p END AS previous_text, CASE WHEN coalesce(n,
    '') = '' THEN 'Unknown' WHEN len(string_split(n, ' ')) > 80 THEN array_to_string(string_split(n, ' ')[1:80],
    ' ') || '...' ELSE n END AS next_text, f AND start_ms < 5000 AS is_start, l AND duration_ms - end_ms < 5000 AS is_end, coalesce(speaker,
    'Unknown') AS primary_speaker
  FROM x""",
    "w3_merge_turns": """
WITH a AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM {fx_segs}
  WINDOW w AS (PARTITION BY video_id ORDER BY seg_no)),
b AS (SELECT *, sum(c) OVER (PARTITION BY video_id ORDER BY seg_no) AS k FROM a)
  SELECT video_id, min(seg_no) AS turn_no, min(speaker) AS speaker, string_agg(text, ' '
  ORDER BY seg_no) AS text, arg_min(start_ms, seg_no) AS start_ms, arg_max(end_ms, seg_no) AS end_ms, count(*) AS n_turns FROM b
  GROUP BY video_id, k""",
    "w3_merged_words": """
WITH a AS (
  SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c
  FROM {fx_segs} WINDOW w AS (PARTITION BY video_id ORDER BY seg_no)),
b AS (SELECT *, sum(c) OVER (PARTITION BY video_id ORDER BY seg_no) AS k FROM a),
m AS (SELECT video_id, seg_no, min(seg_no) OVER (PARTITION BY video_id, k) AS turn_no FROM b)
SELECT w.video_id, m.turn_no, row_number() OVER (PARTITION BY w.video_id, m.turn_no ORDER BY w.seg_no, w.pos) AS pos, word, w.start_ms
FROM {fx_seg_words} w JOIN m ON m.video_id = w.video_id AND m.seg_no = w.seg_no""",
    "w4_split_turns": """
WITH a AS (SELECT *, coalesce(CASE WHEN word_no % 9 < 6 THEN 'SPEAKER_0' || (word_no // 3 % 3)::VARCHAR END, speaker, 'SPEAKER_00') AS ws
  FROM {fx_words}),
b AS (SELECT *, CASE WHEN ws <> lag(ws) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM a
  WINDOW w AS (PARTITION BY video_id, turn_no ORDER BY pos)),
k AS (SELECT *, sum(c) OVER (PARTITION BY video_id, turn_no ORDER BY pos) AS part FROM b)
  SELECT video_id, turn_no, CAST(part AS BIGINT) AS part, min(ws) AS speaker, string_agg(word, ' '
  ORDER BY pos) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words FROM k GROUP BY video_id, turn_no, part""",
    "w5_refine_turn_edges": """
WITH e AS (SELECT video_id, turn_no, min(start_ms) AS s, max(end_ms) AS e FROM {fx_words} WHERE turn_no % 4 <> 1 GROUP BY ALL)
  SELECT d.video_id, d.iv_no AS turn_no, coalesce(s, d.start_ms) AS start_ms, coalesce(e, d.end_ms) AS end_ms FROM {fx_diar} d
  LEFT JOIN e ON e.video_id = d.video_id AND e.turn_no = d.iv_no""",
    "w6_phrases_sentence": _phrases("gap >= 400 AND right(pw, 1) IN ('.', '!', '?', ';', ':')"),
    "w7_phrases_pause": _phrases("gap > 300"),
    "w8_transcript_gaps": """
WITH a AS (SELECT video_id, lag(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, seg_no) AS from_ms, start_ms AS to_ms
  FROM (SELECT * REPLACE (CASE WHEN seg_no % 3 = 1 THEN start_ms + 100 ELSE end_ms END AS end_ms) FROM {fx_segs}) x)
  SELECT *, round_even((to_ms - from_ms) / 1000, 1) AS gap_s FROM a WHERE to_ms - from_ms > 2000""",
    "w9_turn_gaps": """
SELECT video_id, iv_no AS turn_no, coalesce(greatest(0, start_ms - lag(end_ms) OVER (PARTITION BY video_id ORDER BY iv_no)), 0) AS gap_ms
  FROM {fx_diar}""",
    "w18_trim_dead_start": f"""
WITH {_CT}, f AS (SELECT video_id, cand_no, arg_min(start_ms, turn_no) AS f FROM ct GROUP BY ALL),
c AS (SELECT video_id, cand_no, greatest(0, start_ms - cand_no % 3 * 1400) AS s, end_ms FROM {{fx_cands}}),
r AS (SELECT video_id, cand_no, CASE WHEN f - s >= 1500 THEN greatest(s, f - 300) ELSE s END AS start_ms, end_ms FROM c
  LEFT JOIN f USING (video_id, cand_no)) SELECT video_id, cand_no, start_ms, end_ms - start_ms AS duration_ms FROM r""",
}.items()}
