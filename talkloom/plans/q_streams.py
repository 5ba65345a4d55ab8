"""Queries of live views that run as streams: input arrives in several parts, some of it late, and each part is a new
run that goes on from the last one's checkpoint. The SQL says which rows the watermark lets through."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.plans.fixtures import oracle, view
from talkloom.plans.q_io import _S, _status
from talkloom.sources import versions
from talkloom.streaming import live as L

PARTS = 4


def _part(of: F.Column, late: F.Column, span) -> F.Column:
    """The part in which a row arrives: by its time, and one or two parts later where it is late."""
    low, high = span
    return F.least(F.lit(PARTS - 1), F.floor((of - F.lit(low)) * PARTS / F.lit(high - low + 1)) + late).cast("int")


def _run(spark: SparkSession, path: str, inputs: dict[str, DataFrame], start: Callable[..., object]) -> None:
    """Writes each part of each input (its column `part`) and runs the stream after it, from its checkpoint. The inputs
    are computed once, into a folder for each part; they and the checkpoint are deleted at the end."""
    schemas = {name: df.drop("part").schema for name, df in inputs.items()}
    for name, df in inputs.items():
        df.write.partitionBy("part").parquet(f"{path}/all/{name}")
    for part in range(PARTS + 1):
        for name, df in inputs.items():
            arrived = spark.read.schema(df.schema).parquet(f"{path}/all/{name}").filter(F.col("part") == part)
            arrived.select(*schemas[name].names).write.mode("append").parquet(f"{path}/in/{name}")
        L.run_once(start(*[spark.readStream.schema(schemas[name]).parquet(f"{path}/in/{name}") for name in inputs]), f"{path}/state")
    for done in ("all", "in", "state"):
        versions.delete(spark, f"{path}/{done}")


def _events(v) -> DataFrame:
    """Events of whole seconds with their part: every tenth is late, by a part or two."""
    e = v("events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp"))).withColumn("s", F.unix_timestamp("ts"))
    span = e.agg(F.min("s"), F.max("s")).first()
    late = F.when(F.col("event_id") % 10 == 0, F.col("event_id") % 3).otherwise(0)
    return e.withColumn("part", _part(F.col("s"), late, span if span[0] is not None else (0, 0)))


def _beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda name: _events(lambda n: view(spark, sf_dir, n)) if name == "events" else view(spark, sf_dir, name)
    return _status(v).join(v("events").select("event_id", "part"), "event_id")


def _appended(df: DataFrame, path: str):
    return df.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append")


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = versions.new_path(spark, "talk")
    e = _events(lambda n: view(spark, sf_dir, n))
    segments = e.select("ts", F.concat(F.lit("S"), F.col("user_id") % 5).alias("speaker"), (F.col("event_id") % 1000).alias("duration_ms"), "part")
    _run(spark, path, {"segments": segments}, lambda s: _appended(L.live_talk_time(s, late="10 minutes"), path))
    return spark.read.parquet(f"{path}/out").withColumn("window_start", F.unix_timestamp("window_start"))


def _alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = versions.new_path(spark, "alive")
    _run(spark, path, {"beats": _beats(spark, sf_dir)}, lambda b: _appended(L.live_changes(b, 12 * 3600, 24 * 3600, late="2 days"), path))
    return spark.read.parquet(f"{path}/out").select("worker", F.unix_timestamp("at").alias("at"), "state")


def _kept(spark: SparkSession, sf_dir: str) -> str:
    """The status table kept by a stream; its last batch is delivered twice."""
    path = versions.new_path(spark, "status")
    keep, beats = L.keep_status(f"{path}/table"), _beats(spark, sf_dir)
    _run(spark, path, {"beats": beats}, lambda b: b.writeStream.foreachBatch(keep))
    keep(beats.drop("part"), versions.current(spark, f"{path}/table"))
    return f"{path}/table"


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and intervals as two streams; every third interval is late by a part. A closing row of each ends them."""
    path, v = versions.new_path(spark, "matches"), lambda name: view(spark, sf_dir, name)
    words, diar = (v(n).select(*c) for n, c in (("fx_words", ("video_id", "word_no", "start_ms", "end_ms")), ("fx_diar", ("video_id", "iv_no", "speaker", "start_ms", "end_ms"))))
    stop = words.agg(F.max("end_ms")).first()[0] or 0
    part = lambda late: _part(F.col("start_ms"), late, (0, max(0, stop)))
    close = spark.range(1).select(F.lit(-1).cast("long").alias("video_id"), F.lit(-1).cast("long").alias("no"), F.lit("").alias("speaker"), F.lit(stop + 7_200_000).cast("long").alias("start_ms"), F.lit(stop + 7_200_000).cast("long").alias("end_ms"), F.lit(PARTS).alias("part"))
    words_in = words.withColumn("part", part(F.lit(0))).unionByName(close.withColumnRenamed("no", "word_no").drop("speaker"))
    diar_in = diar.withColumn("part", part(F.when(F.col("iv_no") % 3 == 1, 1).otherwise(0))).unionByName(close.withColumnRenamed("no", "iv_no").withColumn("iv_no", F.col("iv_no").cast(diar.schema["iv_no"].dataType)))
    _run(spark, path, {"words": words_in, "diar": diar_in}, lambda w, d: _appended(L.live_matches(w, d, late="1 hour"), path))
    return L.settled_speakers(words, spark.read.parquet(f"{path}/out")).select("video_id", "word_no", "by_overlap", "nearest")


QUERIES = {
    "st1_streamed_counts": lambda spark, d: L.kept_counts(spark, _kept(spark, d)),
    "st2_streamed_restore": lambda spark, d: L.restore_choice(L.kept_status(spark, _kept(spark, d))),
    "st3_streamed_liveness": _alive,
    "st4_streamed_talk_time": _talk,
    "st5_streamed_assign": _assigned,
}
#: Events with their part, and the watermark (seconds) that each part meets: the latest time of the parts before it.
_PARTS = """
e AS (
  SELECT *, CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) AS s FROM events),
a AS (
  SELECT *, least(3, CAST(floor((s - lo) * 4 / (hi - lo + 1)) AS BIGINT) + CASE WHEN event_id % 10 = 0 THEN event_id % 3 ELSE 0 END) AS part
  FROM e, (SELECT min(s) AS lo, max(s) AS hi FROM e)),
m AS (
  SELECT a.*, (SELECT max(b.s) FROM a b WHERE b.part < a.part) AS seen FROM a)"""
ORACLES = {k: oracle(v) for k, v in {
    "st1_streamed_counts": f"WITH {_S} SELECT status, count(*) AS n FROM l GROUP BY status",
    "st2_streamed_restore": f"""
WITH {_S} SELECT worker, status FROM l WHERE status <> 'failed'
  ORDER BY CASE status WHEN 'completed' THEN 0 WHEN 'processing' THEN 1 ELSE 2 END, last_ts, worker LIMIT 1""",
    "st4_streamed_talk_time": f"""
WITH {_PARTS},
w AS (SELECT *, s // 3600 * 3600 AS window_start FROM m)
SELECT window_start, 'S' || (user_id % 5) AS speaker, CAST(sum(event_id % 1000) AS BIGINT) AS talk_ms, count(*) AS n
FROM w WHERE seen IS NULL OR window_start + 3600 > seen - 600
GROUP BY ALL HAVING window_start + 3600 <= (SELECT max(s) FROM e) - 600""",
    "st3_streamed_liveness": f"""
WITH {_PARTS},
k AS (
  SELECT user_id AS worker, s, event_id,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed'
    ELSE 'failed' END AS status
  FROM m WHERE seen IS NULL OR s > seen - 172800),
g AS (
  SELECT *, lag(status) OVER w AS said, s - lag(s) OVER w AS since, lead(s) OVER w - s AS until FROM k WINDOW w AS (PARTITION BY worker ORDER BY s, event_id)),
c AS (
  SELECT worker, s AS "at", status AS state FROM g WHERE since IS NULL OR since > 43200 OR said <> status
  UNION ALL SELECT worker, s + 43200, 'stale' FROM g WHERE until IS NULL OR until > 43200
  UNION ALL SELECT worker, s + 86400, 'gone' FROM g WHERE until IS NULL OR until > 86400)
SELECT * FROM c WHERE "at" < (SELECT max(s) FROM e) - 172800""",
    "st5_streamed_assign": """
WITH p AS (
  SELECT s.video_id, s.word_no, d.speaker, d.iv_no, (s.start_ms + s.end_ms) / 2 AS t, d.start_ms AS a, d.end_ms AS b,
    least(s.end_ms, d.end_ms) - greatest(s.start_ms, d.start_ms) AS o
  FROM {fx_words} s JOIN {fx_diar} d ON s.video_id = d.video_id),
q AS (SELECT *, CASE WHEN t BETWEEN a AND b THEN 0 ELSE 1 END AS away, CASE WHEN t BETWEEN a AND b THEN 0 ELSE least(abs(t - a), abs(t - b)) END AS g FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, word_no ORDER BY away, g, iv_no) AS n FROM q WHERE g <= 500),
x AS (SELECT *, row_number() OVER (PARTITION BY video_id, word_no ORDER BY o DESC, iv_no) AS n FROM q WHERE o > 0)
SELECT w.video_id, w.word_no, coalesce(x.speaker, 'UNKNOWN') AS by_overlap, r.speaker AS nearest
FROM {fx_words} w LEFT JOIN r ON r.video_id = w.video_id AND r.word_no = w.word_no AND r.n = 1
  LEFT JOIN x ON x.video_id = w.video_id AND x.word_no = w.word_no AND x.n = 1""",
}.items()}
