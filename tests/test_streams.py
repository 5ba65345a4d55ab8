"""Streams with late rows, replayed batches, interrupted writes, expiry and restarts, against batch runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talkloom.sources import versions as V
from talkloom.streaming import live as L

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def seconds(t):
    return int((t - T0).total_seconds())


class Fed:
    """A stream whose input is written part by part; each part is a run from the last checkpoint."""

    def __init__(self, spark, path, schema, build):
        self.spark, self.path, self.schema, self.build = spark, str(path), schema, build

    def part(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        self.run()

    def run(self):
        made = self.build(self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in"))
        L.run_once(made.writeStream.format("parquet").option("path", f"{self.path}/out").outputMode("append"), f"{self.path}/state")

    def rows(self):
        return self.spark.read.parquet(f"{self.path}/out")


def test_talk_time_drops_rows_of_windows_that_are_over(spark, tmp_path):
    fed = Fed(spark, tmp_path, "ts timestamp, speaker string, duration_ms long", lambda s: L.live_talk_time(s, "1 hour", "10 minutes"))
    got = lambda: sorted((seconds(r.window_start), r.speaker, r.talk_ms, r.n) for r in fed.rows().collect())
    fed.part([(at(10), "A", 5, ), (at(3590), "B", 7)])
    assert got() == []  # the watermark has not passed the first hour
    fed.part([(at(4300), "A", 1)])  # now it has, at 3700
    assert got() == [(0, "A", 5, 1), (0, "B", 7, 1)]
    fed.part([(at(20), "A", 100), (at(3650), "B", 2)])  # the first is late; the second's window is still open
    fed.part([(at(9000), "C", 1)])
    assert got() == [(0, "A", 5, 1), (0, "B", 7, 1), (3600, "A", 1, 1), (3600, "B", 2, 1)]
    fed.run()  # a run without new input changes nothing
    assert len(got()) == 4


BEATS = [("w", 0, "ready"), ("w", 50, "ready"), ("w", 110, "ready"), ("w", 171, "busy"), ("w", 400, "ready"), ("v", 30, "ready"), ("v", 150, "ready"), ("v", 271, "ready"), ("u", 5, "busy")]


def beats(spark, rows):
    return spark.createDataFrame([(w, at(s), i, x) for i, (w, s, x) in enumerate(rows)], "worker string, ts timestamp, event_id long, status string")


def changes(df):
    return sorted((r.worker, seconds(r["at"]), r.state) for r in df.collect())


def test_liveness_goes_stale_expires_and_comes_back(spark):
    got = changes(L.live_changes(beats(spark, BEATS)))
    assert got == sorted([
        ("w", 0, "ready"), ("w", 170, "stale"), ("w", 171, "busy"), ("w", 231, "stale"), ("w", 291, "gone"), ("w", 400, "ready"), ("w", 460, "stale"), ("w", 520, "gone"),
        ("v", 30, "ready"), ("v", 90, "stale"), ("v", 150, "ready"), ("v", 210, "stale"), ("v", 270, "gone"), ("v", 271, "ready"), ("v", 331, "stale"), ("v", 391, "gone"),
        ("u", 5, "busy"), ("u", 65, "stale"), ("u", 125, "gone"),
    ])
    made = L.live_changes(beats(spark, BEATS))
    asked = {s: {(r.worker, r.state, r.available) for r in L.alive_at(made, F.lit(at(s))).collect()} for s in (60, 169, 170, 300)}
    assert asked[60] == {("w", "ready", True), ("v", "ready", True), ("u", "busy", False)}
    assert asked[169] == {("w", "ready", True), ("v", "ready", True)}
    assert asked[170] == {("w", "stale", False), ("v", "ready", True)}
    assert asked[300] == {("v", "ready", True)}


@pytest.mark.parametrize("cut", [3, 5])
def test_streamed_liveness_is_the_batch_one_whatever_the_order(spark, tmp_path, cut):
    """Beats out of order inside the watermark, in two parts; a beat behind the watermark is dropped."""
    rows = sorted([(w, at(s), i, x) for i, (w, s, x) in enumerate(BEATS)], key=lambda r: r[2] * 7 % 5)
    fed = Fed(spark, tmp_path, "worker string, ts timestamp, event_id long, status string", lambda s: L.live_changes(s, late="10 minutes"))
    fed.part(rows[:cut])
    fed.part(rows[cut:])
    fed.part([("z", at(2000), 99, "ready")])  # the watermark: 1400
    fed.part([("w", at(1000), 100, "late"), ("w", at(1500), 101, "ready")])
    fed.part([("z", at(9000), 102, "ready")])
    want = changes(L.live_changes(beats(spark, [*BEATS, ("z", 2000, "ready"), ("w", 1500, "ready"), ("z", 9000, "ready")])))
    assert changes(fed.rows()) == [x for x in want if x[1] < 9000 - 600]


def status(spark, rows):
    return spark.createDataFrame([(w, at(s), i, x) for w, s, i, x in rows], "worker string, ts timestamp, event_id long, status string")


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path, keep = str(tmp_path / "table"), L.keep_status(str(tmp_path / "table"))
    got = lambda: {r.status: r.n for r in L.kept_counts(spark, path).collect()}
    assert L.kept_counts(spark, path) is None and V.current(spark, path) == -1
    keep(status(spark, [("a", 1, 1, "pending"), ("b", 2, 2, "pending")]), 0)
    keep(status(spark, [("a", 5, 3, "completed"), ("c", 3, 4, "processing")]), 1)
    assert got() == {"completed": 1, "pending": 1, "processing": 1}
    for batch in (0, 1):
        keep(status(spark, [("a", 9, 9, "failed"), ("d", 9, 9, "failed")]), batch)
    assert got() == {"completed": 1, "pending": 1, "processing": 1} and V.current(spark, path) == 1
    # An event that comes late, and the same event twice, change nothing either.
    keep(status(spark, [("a", 4, 2, "processing"), ("b", 2, 2, "pending")]), 2)
    assert got() == {"completed": 1, "pending": 1, "processing": 1}
    assert L.restore_choice(L.kept_status(spark, path)).first().worker == "a"


def test_readers_never_see_half_a_batch(spark, tmp_path, monkeypatch):
    path, keep = str(tmp_path / "table"), L.keep_status(str(tmp_path / "table"))
    keep(status(spark, [("a", 1, 1, "pending")]), 0)
    seen = []
    publish = V.publish

    def broken(*args, **more):
        """Between the data and the pointer: readers see the old version, then the write is lost."""
        seen.append([tuple(r) for r in L.kept_counts(spark, path).collect()])
        raise RuntimeError("lost")

    monkeypatch.setattr(V, "publish", broken)
    with pytest.raises(RuntimeError):
        keep(status(spark, [("a", 2, 2, "completed"), ("b", 2, 3, "failed")]), 1)
    assert seen == [[("pending", 1)]] and V.current(spark, path) == 0
    monkeypatch.setattr(V, "publish", publish)
    keep(status(spark, [("a", 2, 2, "completed"), ("b", 2, 3, "failed")]), 1)
    assert sorted(tuple(r) for r in L.kept_counts(spark, path).collect()) == [("completed", 1), ("failed", 1)]


def test_old_versions_are_deleted_but_the_last_ones(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (0, 1, 2, 5, 9):
        V.write(spark.range(n + 1), path, n, "x")
        V.publish(spark, path, n, keep=2)
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")) == ["2", "5", "9", "CURRENT"]
    assert V.read(spark, path, "x").count() == 10 and V.read(spark, path, "x", 5).count() == 6


WORDS = [(1, 1, 100, 300), (1, 2, 9_900, 10_200), (1, 3, 20_000, 20_300), (1, 4, 31_000, 31_200), (2, 1, 100, 300)]
IVS = [(1, 0, "A", 0, 10_000), (1, 1, "B", 10_000, 20_100), (1, 2, "C", 20_100, 25_000), (1, 3, "D", 31_400, 40_000)]


def test_two_streams_give_the_batch_joins(spark, tmp_path):
    """Intervals that come a part after their words match them; one behind the watermark of both streams does not."""
    words, ivs = "video_id long, word_no long, start_ms long, end_ms long", "video_id long, iv_no long, speaker string, start_ms long, end_ms long"
    path = str(tmp_path)

    def part(w, i):
        spark.createDataFrame(w, words).write.mode("append").parquet(f"{path}/w")
        spark.createDataFrame(i, ivs).write.mode("append").parquet(f"{path}/i")
        made = L.live_matches(spark.readStream.schema(words).parquet(f"{path}/w"), spark.readStream.schema(ivs).parquet(f"{path}/i"), late="1 minute")
        L.run_once(made.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), f"{path}/state")

    part(WORDS[:3], IVS[:1])
    part(WORDS[3:], IVS[2:] + IVS[1:2])
    part([(3, 1, 200_000, 200_100)], [(3, 0, "Z", 200_000, 200_100)])
    part([], [(2, 0, "late", 0, 1000)])
    part([(4, 1, 900_000, 900_100)], [(4, 0, "Z", 900_000, 900_100)])
    all_words = spark.createDataFrame(WORDS, words)
    got = {(r.video_id, r.word_no): (r.by_overlap, r.nearest) for r in L.settled_speakers(all_words, spark.read.parquet(f"{path}/out")).collect()}
    from talkloom.operators.intervals import assign_speaker_max, nearest_interval

    diar = spark.createDataFrame(IVS, ivs)
    most = {(r.video_id, r.word_no): r.assigned for r in assign_speaker_max(all_words, diar, ["word_no"]).collect()}
    near = {(r.video_id, r.word_no): r.assigned for r in nearest_interval(all_words, diar, ["word_no"], (F.col("start_ms") + F.col("end_ms")) / 2).collect()}
    assert got == {k: (most[k], near[k]) for k in most}
    assert got[(1, 2)] == ("B", "B") and got[(1, 4)] == ("UNKNOWN", "D") and got[(2, 1)] == ("UNKNOWN", None)


def test_words_against_a_fixed_table_by_overlap(spark, tmp_path):
    words, ivs = "video_id long, word_no long, start_ms long, end_ms long", "video_id long, iv_no long, speaker string, start_ms long, end_ms long"
    path = str(tmp_path)
    spark.createDataFrame(WORDS, words).write.parquet(f"{path}/w")
    sink = lambda df, i: df.write.mode("overwrite").parquet(f"{path}/out/{i}")
    L.run_once(L.live_assign(spark.readStream.schema(words).parquet(f"{path}/w"), spark.createDataFrame(IVS, ivs), sink, by="overlap"), f"{path}/state")
    got = {(r.video_id, r.word_no): r.assigned for r in spark.read.parquet(f"{path}/out/*").collect()}
    assert got == {(1, 1): "A", (1, 2): "B", (1, 3): "C", (1, 4): "UNKNOWN", (2, 1): "UNKNOWN"}
