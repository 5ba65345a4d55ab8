"""Live views of status events and arriving segments.

Functions that take a DataFrame take a streaming or a batch one, unless they say otherwise. A stream gives the rows a
batch run over the same input would give, but for rows that arrive after the watermark, which are dropped, and for
what lies beyond the last watermark, which is still open.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talkloom.functions.spans import overlap_ms
from talkloom.operators.intervals import BUCKET_MS, _bucketed, assign_speaker_max, nearest_interval
from talkloom.sources import versions


def run_once(writer, checkpoint: str) -> None:
    """Runs a stream until it has read all that is there; the next run goes on from its checkpoint."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def live_status(events: DataFrame) -> DataFrame:
    """Latest status of each worker (ties: the larger event_id). Run it in update mode."""
    return events.groupBy("worker").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("last_ts"))


def status_counts(latest: DataFrame) -> DataFrame:
    return latest.groupBy("status").agg(F.count("*").alias("n"))


def keep_status(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps a versioned table at `path` with the latest status of each worker, `latest`, and how
    many workers have each, `counts`. A version is a batch: one that has been published already changes nothing, one
    that was interrupted is written anew. Events may come in any order and more than once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if versions.current(spark, path) >= batch_id:
            return
        order = F.max(F.struct("ts", "event_id", "status")).alias("e")
        seen = batch.groupBy("worker").agg(order).select("worker", "e.*")
        before = versions.read(spark, path, "latest")
        if before is not None:
            seen = before.unionByName(seen).groupBy("worker").agg(order).select("worker", "e.*")
        latest = versions.write(seen, path, batch_id, "latest")
        versions.write(status_counts(latest), path, batch_id, "counts")
        versions.publish(spark, path, batch_id)

    return run


def kept_counts(spark: SparkSession, path: str) -> DataFrame | None:
    """Workers by status, as keep_status() has published them last."""
    return versions.read(spark, path, "counts")


def kept_status(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest status of each worker, as published last."""
    found = versions.read(spark, path, "latest")
    return None if found is None else found.select("worker", "status", F.col("ts").alias("last_ts"))


def restore_choice(latest: DataFrame) -> DataFrame:
    """The worker to restore: completed before processing before pending; of equals the one seen first."""
    rank = F.when(F.col("status") == "completed", 0).when(F.col("status") == "processing", 1).when(F.col("status") == "pending", 2)
    return latest.filter(rank.isNotNull()).agg(F.min_by(F.struct("worker", "status"), F.struct(rank, "last_ts", "worker")).alias("w")).select("w.worker", "w.status")


def liveness(beats: DataFrame, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Spells of life of each worker: beats no further apart than `gap`. Append mode gives a spell once the
    watermark has passed its end."""
    timed = beats.withWatermark("ts", late) if beats.isStreaming else beats
    return timed.groupBy("worker", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("beats")).select("worker", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "beats")


def _beat_changes(stale_us: int, gone_us: int):
    """The fold of one worker's beats, for applyInPandasWithState.

    Beats wait in the state until the watermark has passed them, so they are folded in the order of (ts, event_id)
    whatever the order they arrive in; timers are the next waiting beat, going stale and being gone. A worker that is
    gone leaves no state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, said, level, waiting = state.get if state.exists else (None, None, 0, "[]")
        beats = json.loads(waiting)
        for pdf in frames:
            beats += [[int(t), int(e), s] for t, e, s in zip(pdf["t"], pdf["event_id"], pdf["status"], strict=True)]
        beats.sort(key=lambda b: (b[0], b[1], b[2] or ""))
        now, out = state.getCurrentWatermarkMs() * 1000, []
        while True:
            due = None if last is None else last + (gone_us if level else stale_us)
            beat = beats[0] if beats else None
            at = min(x for x in (due, beat and beat[0], 1 << 62) if x is not None)
            if at >= now:
                break
            if beat and (due is None or beat[0] <= due):
                beats.pop(0)
                if last is None or level or beat[2] != said:
                    out.append((at, beat[2]))
                last, said, level = beat[0], beat[2], 0
            elif level:
                out.append((at, "gone"))
                last, said, level = None, None, 0
            else:
                out.append((at, "stale"))
                level = 1
        if last is None and not beats:
            if state.exists:
                state.remove()
        else:
            state.update((last, said, level, json.dumps(beats)))
            state.setTimeoutTimestamp(at // 1000)
        yield pd.DataFrame({"worker": [key[0]] * len(out), "t": pd.Series([x[0] for x in out], dtype="int64"), "state": pd.Series([x[1] for x in out], dtype="object")})

    return run


def live_changes(beats: DataFrame, stale_s: int = 60, gone_s: int = 120, late: str = "10 minutes") -> DataFrame:
    """worker, at, state: each change of what is known of a worker from its beats (worker, ts, event_id, status). The
    state is its beats' status, `stale` once the last beat is stale_s old, `gone` once it is gone_s old; the next beat
    brings it back. A beat that comes just then is in time. Beats of null worker or ts are ignored.

    A stream keeps one row of state for each worker that is not gone, and gives changes before the watermark."""
    beats = beats.select("worker", "ts", F.unix_micros("ts").alias("t"), F.coalesce("event_id", F.lit(0)).cast("long").alias("event_id"), "status").filter("worker is not null and ts is not null")
    if beats.isStreaming:
        schema, kept = f"worker {beats.schema['worker'].dataType.simpleString()}, t long, state string", "last long, said string, level int, waiting string"
        made = beats.withWatermark("ts", late).groupBy("worker").applyInPandasWithState(_beat_changes(stale_s * 10**6, gone_s * 10**6), schema, kept, "append", GroupStateTimeout.EventTimeTimeout)
        return made.select("worker", F.timestamp_micros("t").alias("at"), "state")
    order = Window.partitionBy("worker").orderBy("ts", "event_id", "status")
    rows = beats.select("worker", "status", "t", F.lag("status").over(order).alias("said"), (F.col("t") - F.lag("t").over(order)).alias("since"), (F.lead("t").over(order) - F.col("t")).alias("until"))
    change = lambda ok, after, state: F.when(ok, F.struct((F.col("t") + after * 10**6).alias("t"), state.alias("state")))
    own = change(F.col("since").isNull() | (F.col("since") > stale_s * 10**6) | ~F.col("said").eqNullSafe(F.col("status")), 0, F.col("status"))
    ends = lambda s: F.col("until").isNull() | (F.col("until") > s * 10**6)
    made = F.array(own, change(ends(stale_s), stale_s, F.lit("stale")), change(ends(gone_s), gone_s, F.lit("gone")))
    return rows.select("worker", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("c")).select("worker", F.timestamp_micros("c.t").alias("at"), "c.state")


def alive_at(changes: DataFrame, now, ready: str = "ready") -> DataFrame:
    """worker, state, available: what is known of each worker at a time, as it may change there."""
    last = changes.filter(F.col("at") <= now).groupBy("worker").agg(F.max_by("state", F.struct("at", F.col("state") != "gone", F.col("state") != "stale", "state")).alias("state"))
    return last.filter("state <> 'gone'").withColumn("available", F.col("state") == ready)


def live_talk_time(segments: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Talk time per speaker and window. In append mode a window comes once the watermark has passed its end, and rows
    of windows that the watermark has passed before are dropped."""
    timed = segments.withWatermark("ts", late) if segments.isStreaming else segments
    return timed.groupBy(F.window("ts", window).alias("w"), "speaker").agg(F.sum("duration_ms").alias("talk_ms"), F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "speaker", "talk_ms", "n")


def live_assign(words: DataFrame, diar: DataFrame, sink, by: str = "nearest") -> object:
    """Assigns speakers to arriving words against a fixed table of intervals, a micro-batch at a time, by the nearest
    interval or, with by="overlap", by the largest overlap; sink(df, id) stores each result. Returns the writer, to be
    started by the caller."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if by == "overlap":
            sink(assign_speaker_max(batch, diar, ["word_no"]), batch_id)
        else:
            sink(nearest_interval(batch, diar, ["word_no"], (F.col("start_ms") + F.col("end_ms")) / 2), batch_id)

    return words.writeStream.foreachBatch(run)


def live_matches(words: DataFrame, diar: DataFrame, late: str = "10 minutes", max_gap_ms: int = 500, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Words and intervals as two streams: the best match of each word in each time bucket that it shares with an
    interval, for settled_speakers().

    Both sides are laid on buckets of the recording's clock, which is the event time, and wait as the arrays of one row of
    state for each (video_id, bucket), which goes, matched, once both streams' watermarks have passed it. An interval
    that arrives later than the watermark counts only in the buckets that are still open."""
    # Watermarks begin at zero, so the clock begins a day after it.
    at = lambda bucket: F.timestamp_millis(bucket * bucket_ms + 86_400_000)
    clock = at(F.col("bucket"))
    side = words.select("video_id", "word_no", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")).filter("s is not null and e is not null")
    side = _bucketed(side, F.col("s"), F.col("e"), bucket_ms, "a").withColumn("bucket_ts", clock).drop("bucket").withWatermark("bucket_ts", late)
    ivs = diar.select("video_id", "iv_no", F.col("speaker").alias("iv_speaker"), F.col("start_ms").alias("iv_start"), F.col("end_ms").alias("iv_end")).filter("iv_start is not null and iv_end is not null")
    ivs = _bucketed(ivs, F.col("iv_start") - max_gap_ms, F.col("iv_end") + max_gap_ms, bucket_ms, "b").withColumn("bucket_ts", clock).drop("bucket").withWatermark("bucket_ts", late)
    kinds = {"w": F.struct("word_no", "s", "e", "a_first"), "i": F.struct("iv_no", "iv_speaker", "iv_start", "iv_end", "b_first")}
    none = {k: F.lit(None).cast(df.select(kinds[k].alias("x")).schema["x"].dataType) for k, df in (("w", side), ("i", ivs))}
    both = side.select("video_id", "bucket_ts", kinds["w"].alias("w"), none["i"].alias("i")).union(ivs.select("video_id", "bucket_ts", none["w"].alias("w"), kinds["i"].alias("i")))
    held = both.groupBy("video_id", "bucket_ts").agg(F.collect_list("w").alias("words"), F.collect_list("i").alias("ivs"))

    def match(w: Column) -> Column:
        s, e, point = w["s"], w["e"], (w["s"] + w["e"]) / 2
        ours = F.filter("ivs", lambda i: at(F.greatest(w["a_first"], i["b_first"])) == F.col("bucket_ts"))
        overlap = lambda i: overlap_ms(s, e, i["iv_start"], i["iv_end"])
        inside = lambda i: point.between(i["iv_start"], i["iv_end"])
        gap = lambda i: F.when(inside(i), 0.0).otherwise(F.least(F.abs(point - i["iv_start"]), F.abs(point - i["iv_end"])).cast("double"))
        most = F.transform(ours, lambda i: F.when(overlap(i) > 0, F.struct(overlap(i).alias("overlap"), (-i["iv_no"]).alias("no"), i["iv_speaker"].alias("iv_speaker"))))
        near = F.transform(ours, lambda i: F.when(gap(i) <= max_gap_ms, F.struct((~inside(i)).alias("out"), gap(i).alias("gap"), i["iv_no"].alias("iv_no"), i["iv_speaker"].alias("iv_speaker"))))
        return F.struct(w["word_no"].alias("word_no"), F.array_max(most).alias("most"), F.array_min(near).alias("near"))

    found = held.filter("size(words) > 0 and size(ivs) > 0").select("video_id", "bucket_ts", F.explode(F.transform("words", match)).alias("m"))
    return found.select("video_id", "m.word_no", "bucket_ts", "m.most", "m.near").filter("most is not null or near is not null")


def settled_speakers(words: DataFrame, matches: DataFrame, default: str = "UNKNOWN") -> DataFrame:
    """Adds `by_overlap` and `nearest`, as assign_speaker_max() and nearest_interval() give them, from the matches
    that live_matches() has written."""
    best = matches.groupBy("video_id", "word_no").agg(F.max("most").alias("most"), F.min("near").alias("near"))
    joined = words.join(best, ["video_id", "word_no"], "left")
    return joined.select(*words.columns, F.coalesce("most.iv_speaker", F.lit(default)).alias("by_overlap"), F.col("near.iv_speaker").alias("nearest"))
