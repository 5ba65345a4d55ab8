"""Queries of sources, sinks and live views, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkloom.operators.infer import infer, score_with_model
from talkloom.operators.selection import queue_stats
from talkloom.operators.subtitles import chars_to_words
from talkloom.plans.fixtures import oracle, view
from talkloom.sources import transcripts as S
from talkloom.sources.versions import delete, new_path
from talkloom.streaming import live as L


def _q(fn):
    return lambda spark, d: fn(lambda name: view(spark, d, name))


def _status(v):
    s = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type").isin("view", "click"), "processing").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    return v("events").select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("ts"), "event_id", s.alias("status"))


def _rttm_lines(v):
    line = F.format_string("SPEAKER rec 1 %.3f %.3f <NA> <NA> %s <NA>", F.col("start_ms") / 1000, (F.col("end_ms") - F.col("start_ms")) / 1000, F.col("speaker"))
    return v("fx_diar").select("video_id", F.when(F.col("iv_no") % 6 == 5, "; comment").otherwise(line).alias("value"))


def _exported(v):
    n = F.col("turn_no")
    turns = v("fx_cand_turns").withColumn("text_tr", F.concat(F.lit("[calm] "), F.translate("text", "aeiou", "AEIOU"))).withColumn("text", F.when(F.col("cand_no") % 3 > 0, F.col("text"))).withColumn("merged", n % 10 == 4)
    out = S.export_transcripts(v("fx_cands"), turns, v("fx_cand_words"))
    flat = F.array_join(F.transform("words", lambda w: F.concat_ws("/", w["word"], w["start"], w["end"])), " ")
    return out.withColumn("words", flat)


def _transcripts(spark, sf_dir):
    """Transcript files of all recordings, written to the shared folder and read back."""
    v, sec = lambda name: view(spark, sf_dir, name), lambda c: F.col(c) / 1000
    w = v("fx_seg_words").select("video_id", "seg_no", "pos", F.struct("word", F.when(F.col("pos") % 7 != 5, sec("start_ms")).alias("start"), sec("end_ms").alias("end"), F.when(F.col("pos") % 2 == 0, F.lit("S")).alias("speaker")).alias("w"))
    words = w.groupBy("video_id", "seg_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("words"))
    words = words.withColumn("words", F.when(F.col("seg_no") % 5 != 4, F.col("words")))
    segs = v("fx_segs").join(words, ["video_id", "seg_no"]).select("video_id", F.struct("seg_no", sec("start_ms").alias("start"), sec("end_ms").alias("end"), "text", "speaker", "words").alias("s"))
    files = segs.groupBy("video_id").agg(F.array_sort(F.collect_list("s")).alias("segments")).withColumn("language", F.lit("en"))
    path = new_path(spark, "transcripts")
    files.write.partitionBy("video_id").json(path)
    return S.read_transcripts(spark, f"{path}/*")


def _rttm_files(spark, sf_dir):
    path, v = new_path(spark, "rttm"), lambda name: view(spark, sf_dir, name)
    _rttm_lines(v).write.partitionBy("video_id").text(path)
    return S.read_rttm(spark, f"{path}/*")


def _saved(spark, sf_dir):
    """Results of all recordings saved, and those of the recordings with a strong candidate loaded."""
    path, scores = new_path(spark, "results"), view(spark, sf_dir, "fx_scores")
    S.save_analysis(scores.select("video_id", "cand_no", "c0"), path)
    return S.load_analysis(spark, path, scores.filter("c1 > 0.9").select("video_id"))


def _alignments(spark, sf_dir):
    """Character alignments of all turns of a recording as files, read back and made into words."""
    v = lambda name: view(spark, sf_dir, name)
    t = v("fx_turns").withColumn("ch", F.split("text", ""))
    n = F.sum(F.size("ch")).over(Window.partitionBy("video_id").orderBy("turn_no"))
    t = t.withColumn("stop", n).withColumn("first", F.col("stop") - F.size("ch"))
    segment = F.struct(F.col("turn_no").cast("int").alias("dialogue_input_index"), F.col("first").cast("int").alias("character_start_index"), F.col("stop").cast("int").alias("character_end_index"))
    chars = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "ch"))), lambda x: x["ch"]))
    files = t.groupBy("video_id").agg(chars.alias("c"), F.array_sort(F.collect_list(segment)).alias("voice_segments"))
    at = lambda more: F.transform(F.sequence(F.lit(0), F.size("c") - 1), lambda i: (i + more) / 100)
    alignment = F.struct(F.col("c").alias("characters"), at(0).alias("character_start_times_seconds"), at(1).alias("character_end_times_seconds"))
    path = new_path(spark, "alignment")
    # A folder for each recording: its tasks move their own there, not the driver all of them. Nobody reads a part of it.
    write = files.select("video_id", alignment.alias("alignment"), "voice_segments").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    write.partitionBy("video_id").json(path)
    chars = S.alignment_chars(S.read_alignment(spark, f"{path}/*"))
    return chars_to_words(chars)


def _catalog(spark, sf_dir):
    """The given tables' own files."""
    files = S.media_catalog(spark, sf_dir, ("parquet",))
    return files.select(F.regexp_extract("path", r"([^/]+)\.parquet", 1).alias("name"), (F.col("size_mb") >= 0).alias("known")).distinct()


def _assigned(spark, sf_dir):
    """Words as they arrive, from files, with the speaker each gets; the stream runs until it has read all of them."""
    v, path = lambda name: view(spark, sf_dir, name), new_path(spark, "live")
    v("fx_words").select("video_id", "word_no", "word", "start_ms", "end_ms").write.parquet(f"{path}/words")
    words = spark.readStream.schema("video_id long, word_no long, word string, start_ms long, end_ms long").parquet(f"{path}/words")
    sink = lambda df, i: df.write.mode("overwrite").parquet(f"{path}/out/batch={i}")
    L.run_once(L.live_assign(words, v("fx_diar"), sink), f"{path}/state")
    for done in ("words", "state"):
        delete(spark, f"{path}/{done}")
    return spark.read.parquet(f"{path}/out").select("video_id", "word_no", "assigned")


def _infer(v):
    def count(pdf):
        if (pdf.text.str.len() % 7 == 3).any():
            raise TimeoutError("refused")
        return pdf.assign(n=pdf.text.str.len().astype("int64"))[["video_id", "seg_no", "n"]]

    return infer(v("fx_segs").select("video_id", "seg_no", "text"), count, "video_id long, seg_no long, n long", text="text")


def _model(v):
    """Replies of a model that gives some criteria, refuses some texts and speaks around its JSON."""

    def ask(pdf):
        if (pdf.text.str.len() % 11 == 2).any():
            raise TimeoutError("refused")
        raw = ['{"completeness_arc": %.2f, "hook_quality": "0.5", "needs_next_context": "yes"}' % (len(t) % 100 / 100) for t in pdf.text]
        return pdf.assign(raw=raw)[["video_id", "cand_no", "raw"]]

    return score_with_model(v("fx_cands"), ask).select("video_id", "cand_no", "completeness_arc", "hook_quality", "specificity_score", "needs_next_context", "score", "tier")


def _talk(v):
    return L.live_talk_time(v("events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("S"), F.col("user_id") % 5).alias("speaker"), (F.col("event_id") % 1000).alias("duration_ms")))


QUERIES = {
    "s2_parse_rttm": _q(lambda v: S.parse_rttm(_rttm_lines(v))),
    "s1_read_transcripts": _transcripts,
    "s2_read_rttm": lambda spark, d: _rttm_files(spark, d).withColumn("video_id", F.col("video_id").cast("long")),
    "s3_saved_results": _saved,
    "s4_export_transcripts": _q(_exported),
    "s6_media_catalog": _catalog,
    "s7_read_alignment": _alignments,
    "st5_live_assign": _assigned,
    "m2_score_with_model": _q(_model),
    "s5_subtitle_lines": _q(lambda v: S.subtitle_lines(v("fx_texts"), F.when(F.col("seg_no") % 2 == 0, "00FFFF"))),
    "st1_live_status": _q(lambda v: L.live_status(_status(v)).select("worker", "status")),
    "st1_status_counts": _q(lambda v: L.status_counts(L.live_status(_status(v)))),
    "st2_restore_choice": _q(lambda v: L.restore_choice(L.live_status(_status(v)))),
    "st3_liveness": _q(lambda v: L.liveness(_status(v), "12 hours").groupBy("worker").agg(F.count("*").alias("spells"), F.sum("beats").alias("beats"), F.max("beats").alias("longest"))),
    "st4_live_talk_time": _q(lambda v: _talk(v).withColumn("window_start", F.unix_timestamp("window_start"))),
    "a21_queue_stats": _q(lambda v: queue_stats(_status(v))),
    "m1_infer": _q(_infer),
}
_S = """
s AS (SELECT user_id AS worker, ts, event_id,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed'
    ELSE 'failed' END AS status
  FROM events),
l AS (SELECT worker, status, ts AS last_ts FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY ts DESC, event_id DESC) AS n
  FROM s) x WHERE n = 1)"""
_ASS = "printf('%d:%02d:%02d.%02d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} // 10 % 100)"
ORACLES = {k: oracle(v) for k, v in {
    "s2_parse_rttm": """
SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id
  ORDER BY start_ms, end_ms - start_ms, speaker) - 1 AS BIGINT) AS iv_no, start_ms, end_ms, speaker FROM {fx_diar} WHERE iv_no % 6 <> 5""",
    "s1_read_transcripts": """
SELECT CAST(s.video_id AS VARCHAR) AS video_id, s.seg_no, CASE WHEN s.seg_no % 5 <> 4 THEN w.pos_no END AS word_no, s.text AS seg_text,
  CASE WHEN s.seg_no % 5 <> 4 THEN w.word END AS word, CASE WHEN s.seg_no % 5 = 4 OR w.pos % 7 = 5 THEN 0 ELSE w.start_ms END AS start_ms,
  CASE WHEN s.seg_no % 5 = 4 THEN 0 ELSE w.end_ms END AS end_ms, CASE WHEN s.seg_no % 5 <> 4 AND w.pos % 2 = 0 THEN 'S' ELSE s.speaker END AS speaker,
  s.start_ms AS seg_start_ms, s.end_ms AS seg_end_ms
FROM {fx_segs} s JOIN (SELECT *, row_number() OVER (PARTITION BY video_id, seg_no ORDER BY pos) - 1 AS pos_no FROM {fx_seg_words}) w
  ON w.video_id = s.video_id AND w.seg_no = s.seg_no AND (s.seg_no % 5 <> 4 OR w.pos_no = 0)""",
    "s2_read_rttm": """
SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms - start_ms, speaker) - 1 AS BIGINT) AS iv_no, start_ms, end_ms, speaker
FROM {fx_diar} WHERE iv_no % 6 <> 5""",
    "s3_saved_results": "SELECT video_id, cand_no, c0 FROM {fx_scores} WHERE video_id IN (SELECT video_id FROM {fx_scores} WHERE c1 > 0.9::DOUBLE)",
    "s4_export_transcripts": """
WITH w AS (
  SELECT video_id, cand_no, string_agg(word || '/' || start_ms || '/' || end_ms, ' ' ORDER BY turn_no, pos) AS words, arg_max(end_ms, (turn_no, pos)) AS z,
    arg_min(start_ms, (turn_no, pos)) AS a
  FROM {fx_cand_words} WHERE turn_no % 10 <> 4 GROUP BY ALL),
t AS (SELECT video_id, cand_no, string_agg(text, ' ' ORDER BY turn_no) AS text FROM {fx_cand_turns} WHERE turn_no % 10 <> 4 GROUP BY ALL),
x AS (
  SELECT c.*, w.words, z, a, translate(t.text, 'aeiou', 'AEIOU') AS tr, CASE WHEN c.cand_no % 3 > 0 THEN t.text ELSE c.text END AS en
  FROM {fx_cands} c JOIN w USING (video_id, cand_no) JOIN t USING (video_id, cand_no))
SELECT video_id, cand_no AS segment_id, tr AS text, en AS text_en, words, z - a AS duration_ms, end_ms - start_ms AS original_duration_ms, 'ru' AS language,
  start_ms, end_ms, CAST(len(string_split(tr, ' ')) AS INTEGER) AS n_words_tr, CAST(len(string_split(en, ' ')) AS INTEGER) AS n_words_en
FROM x""",
    "s6_media_catalog": """
SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages',
    'benchmark', 'labels', 'conversations']) AS name, true AS known""",
    "s7_read_alignment": """
WITH t AS (
  SELECT *, CAST(sum(length(text)) OVER (PARTITION BY video_id ORDER BY turn_no) - length(text) AS BIGINT) AS f FROM {fx_turns}),
w AS (
  SELECT w.video_id, w.turn_no, word, f + CAST(sum(length(word) + 1) OVER (PARTITION BY w.video_id, w.turn_no ORDER BY pos) - length(word) - 1 AS BIGINT) AS o
  FROM {fx_words} w JOIN t ON t.video_id = w.video_id AND t.turn_no = w.turn_no)
SELECT CAST(video_id AS VARCHAR) AS video_id, CAST(turn_no AS BIGINT) AS input_no, o AS i, word, o * 10 AS start_ms, (o + length(word)) * 10 AS end_ms FROM w""",
    "st5_live_assign": """
WITH p AS (
  SELECT s.video_id, s.word_no, d.speaker, d.iv_no, (s.start_ms + s.end_ms) / 2 AS t, d.start_ms AS a, d.end_ms AS b
  FROM {fx_words} s JOIN {fx_diar} d ON s.video_id = d.video_id),
q AS (SELECT *, CASE WHEN t BETWEEN a AND b THEN 0 ELSE 1 END AS o, CASE WHEN t BETWEEN a AND b THEN 0 ELSE least(abs(t - a), abs(t - b)) END AS g FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, word_no ORDER BY o, g, iv_no) AS n FROM q WHERE g <= 500)
SELECT w.video_id, w.word_no, r.speaker AS assigned FROM {fx_words} w LEFT JOIN r ON r.video_id = w.video_id AND r.word_no = w.word_no AND r.n = 1""",
    "m2_score_with_model": """
WITH c AS (
  SELECT video_id, cand_no, length(text) % 11 <> 2 AS ok, round(length(text) % 100 / 100, 2) AS a FROM {fx_cands}),
s AS (
  SELECT video_id, cand_no, CASE WHEN ok THEN a ELSE 0.5::DOUBLE END AS completeness_arc, 0.5::DOUBLE AS hook_quality, 0.5::DOUBLE AS specificity_score, ok AS needs_next_context
  FROM c),
r AS (
  SELECT *, round(least(completeness_arc * 0.3::DOUBLE + 0.5::DOUBLE * 0.15::DOUBLE + 0.5::DOUBLE * 0.15::DOUBLE + 0.5::DOUBLE * 0.1::DOUBLE + 0.5::DOUBLE * 0.1::DOUBLE
    + 0.5::DOUBLE * 0.1::DOUBLE + 0.5::DOUBLE * 0.1::DOUBLE, CASE WHEN needs_next_context THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END), 9) AS score
  FROM s)
SELECT *, CASE WHEN score >= 0.35 THEN 'strict' WHEN score >= 0.25 THEN 'extended' END AS tier FROM r""",
    "s5_subtitle_lines": f"SELECT video_id, seg_no, 'Dialogue: 0,' || {_ASS.format('start_ms')} || ',' || {_ASS.format('end_ms')} || ',Default,,105,105,0,,' || CASE WHEN seg_no % 2 = 0 THEN '{{\\1c&H00FFFF&}}' ELSE '' END || coalesce(text, '') AS line FROM {{fx_texts}}".replace("{0}", ""),
    "st1_live_status": f"WITH {_S} SELECT worker, status FROM l",
    "st1_status_counts": f"WITH {_S} SELECT status, count(*) AS n FROM l GROUP BY status",
    "st2_restore_choice": f"""
WITH {_S} SELECT worker, status FROM l WHERE status <> 'failed'
  ORDER BY CASE status WHEN 'completed' THEN 0 WHEN 'processing' THEN 1 ELSE 2 END, last_ts, worker LIMIT 1""",
    "st3_liveness": f"""
WITH {_S}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY worker
  ORDER BY ts, event_id) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS c FROM s),
k AS (SELECT *, sum(c) OVER (PARTITION BY worker ORDER BY ts, event_id) AS k FROM g),
b AS (SELECT worker, k, count(*) AS n FROM k GROUP BY ALL)
  SELECT worker, count(*) AS spells, CAST(sum(n) AS BIGINT) AS beats, max(n) AS longest FROM b GROUP BY worker""",
    "st4_live_talk_time": """
SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, 'S' || (user_id % 5) AS speaker,
    CAST(sum(event_id % 1000) AS BIGINT) AS talk_ms, count(*) AS n
  FROM events GROUP BY ALL""",
    "a21_queue_stats": f"WITH {_S} SELECT worker, status, count(*) AS n FROM s GROUP BY ALL",
    "m1_infer": "SELECT video_id, seg_no, length(text) AS n FROM {fx_segs} WHERE length(text) % 7 <> 3",
}.items()}
