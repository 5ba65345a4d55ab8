"""Hand-made edge cases of operators whose rules are easy to get wrong, and those without SQL."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.operators import chunking as C
from talkloom.operators import infer as I
from talkloom.operators import intervals as J
from talkloom.operators import ranking as R
from talkloom.operators import timing as T
from talkloom.sources import transcripts as S
from talkloom.streaming import live as L


def diar(spark, *ivs):
    return spark.createDataFrame([(1, i, a, b, s) for i, (a, b, s) in enumerate(ivs)], "video_id long, iv_no long, start_ms long, end_ms long, speaker string")


def spans(spark, *rows):
    return spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(rows)], "video_id long, seg_no long, start_ms long, end_ms long")


def test_max_overlap_ties_take_the_first_interval_and_touching_is_no_overlap(spark):
    d = diar(spark, (0, 1000, "A"), (1000, 2000, "B"))
    got = {r.seg_no: r.assigned for r in J.assign_speaker_max(spans(spark, (500, 1500), (2000, 2500), (None, 3000)), d, ["seg_no"]).collect()}
    assert got == {0: "A", 1: "UNKNOWN", 2: "UNKNOWN"}


def test_dominant_speaker_sums_overlaps(spark):
    d = diar(spark, (0, 400, "A"), (400, 900, "B"), (900, 1300, "A"))
    assert J.assign_speaker_dominant(spans(spark, (0, 1300)), d, ["seg_no"]).first().assigned == "A"


def test_nearest_interval_tolerance_is_closed(spark):
    d = diar(spark, (1000, 2000, "A"), (3001, 4000, "B"))
    pts = spark.createDataFrame([(1, 0, 500), (1, 1, 499), (1, 2, 2500), (1, 3, 2501), (1, 4, 1000)], "video_id long, seg_no long, t_ms long")
    got = {r.seg_no: r.assigned for r in J.nearest_interval(pts, d, ["seg_no"], F.col("t_ms")).collect()}
    assert got == {0: "A", 1: None, 2: "A", 3: "B", 4: "A"}


def test_interval_spanning_many_buckets_pairs_once(spark):
    d = diar(spark, (0, 100_000, "A"))
    assert J.assign_speaker_max(spans(spark, (0, 95_000)), d, ["seg_no"]).count() == 1


def brute_suppress(rows, iou, gap, desired):
    kept, dropped = [], []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        keep = True
        for k in list(kept):
            if r[1] >= k[1] and r[2] <= k[2]:
                keep = False
                break
            if k[1] >= r[1] and k[2] <= r[2]:
                kept.remove(k)
                break
            lo, hi = max(r[1], k[1]), min(r[2], k[2])
            union = max(r[2], k[2]) - min(r[1], k[1])
            if (hi >= lo and (hi - lo) / union >= iou) or abs(r[1] - k[1]) < gap:
                keep = False
                break
        (kept if keep else dropped).append(r)
    return sorted(x[0] for x in kept + dropped[: max(0, (desired or 0) - len(kept))])


def test_suppression_keeps_the_swap_rule(spark):
    rows = [(0, 10_000, 40_000, 0.9), (1, 0, 60_000, 0.8), (2, 15_000, 30_000, 0.7), (3, 55_000, 90_000, 0.6), (4, 61_000, 95_000, 0.5), (5, 200_000, 230_000, 0.5), (6, 209_000, 240_000, 0.4)]
    df = spark.createDataFrame([(1, *r) for r in rows], "video_id long, cand_no long, start_ms long, end_ms long, score double")
    for desired in (None, 5):
        got = sorted(r.cand_no for r in R.suppress_overlaps(df, desired=desired).collect())
        assert got == brute_suppress(rows, 0.5, 10_000, desired)


def test_fallback_and_empty_tables(spark):
    df = spark.createDataFrame([], "video_id long, cand_no long, start_ms long, end_ms long, score double")
    assert R.suppress_overlaps(df).count() == 0 and R.top_k(df).count() == 0


def test_long_sentences_are_cut_hard_and_stand_alone(spark):
    got = spark.createDataFrame([("aaaa. " + "b" * 25 + ". cc.",)], "t string").select(C.chunk_text(F.col("t"), 10)).first()[0]
    assert got == ["aaaa.", "b" * 10, "b" * 10, "b" * 5 + ".", "cc."]


def test_words_do_not_change_when_timing_is_repaired(spark):
    rows = [(1, 0, i, "w", None if i in (0, 3) else i * 100, None if i in (0, 3) else i * 100 + 80, 0, 1000) for i in range(6)]
    df = spark.createDataFrame(rows, "video_id long, turn_no long, pos long, word string, start_ms long, end_ms long, turn_start long, turn_end long")
    out = T.interpolate_words(df).orderBy("pos").collect()
    assert len(out) == 6 and [r.start_ms for r in out][:4] == [0, 100, 200, 280] and all(r.end_ms > r.start_ms for r in out)


def test_inference_halves_failing_batches(spark):
    df = spark.createDataFrame([(i,) for i in range(20)], "i long")

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf.i == 7).any():
            raise TimeoutError
        return pdf

    assert sorted(r.i for r in I.infer(df, fn, "i long").collect()) == [i for i in range(20) if i != 7]

    def broken(pdf: pd.DataFrame) -> pd.DataFrame:
        raise KeyError("a programming error")

    with pytest.raises(Exception, match="programming error"):
        I.infer(df, broken, "i long").collect()


def test_inference_batches_by_characters_and_tries_single_rows_again(spark):
    df = spark.createDataFrame([(i, "x" * (i * 10)) for i in range(8)], "i long, t string").coalesce(1)

    def sizes(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(pdf)], "chars": [pdf.t.str.len().sum()]})

    got = [(r.n, r.chars) for r in I.infer(df, sizes, "n long, chars long", rows=4, text="t", chars=100).collect()]
    assert got == [(4, 60), (2, 90), (1, 60), (1, 70)]


def test_text_edges(spark):
    row = spark.createDataFrame([("Ann Lee_ x.mp4", None, "")], "a string, b string, c string").select(X.guest_name(F.col("a")), X.clean_text(F.col("b")), X.emotion_tag(F.col("c")), F.size(X.words(F.col("b")))).first()
    assert tuple(row) == ("Ann Lee", None, "", 0)


def test_transcripts_and_rttm_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"segments": [{"start": 0.5, "end": 2, "text": "hi you", "speaker": "S1", "words": [{"word": "hi", "start": 0.5}, {"word": "you", "start": 1, "end": 2, "speaker": "S2"}]}, {"text": "none"}], "language": "en"}))
    rows = S.read_transcripts(spark, str(tmp_path / "a.json")).orderBy("seg_no", "word_no").collect()
    assert [(r.video_id, r.word, r.start_ms, r.end_ms, r.speaker) for r in rows] == [("a", "hi", 500, 0, "S1"), ("a", "you", 1000, 2000, "S2"), ("a", None, 0, 0, None)]
    (tmp_path / "b.rttm").write_text("SPEAKER b 1 3.0 1.5 <NA> <NA> X <NA>\nJUNK\nSPEAKER b 1 1.0 0.5 <NA> <NA> Y <NA>\n")
    assert [(r.iv_no, r.start_ms, r.end_ms, r.speaker) for r in S.read_rttm(spark, str(tmp_path / "b.rttm")).orderBy("iv_no").collect()] == [(0, 1000, 1500, "Y"), (1, 3000, 4500, "X")]


def test_saved_results_load_by_id(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("video_id"), (F.col("id") * 2).alias("x"))
    S.save_analysis(df, str(tmp_path / "r"))
    assert sorted(r.x for r in S.load_analysis(spark, str(tmp_path / "r"), [3, 9]).collect()) == [6, 18]


def test_media_catalog_skips_other_files(spark, tmp_path):
    for name in ("a.mp4", "b.tmp.mp4", "c.txt", "D.MKV"):
        (tmp_path / name).write_bytes(b"x" * 10)
    assert sorted(r.path.rsplit("/", 1)[1] for r in S.media_catalog(spark, str(tmp_path)).collect()) == ["D.MKV", "a.mp4"]


def test_streamed_status_equals_the_batch(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "pending"), (1, "2024-01-01 00:05:00", 2, "completed"), (2, "2024-01-01 00:01:00", 3, "processing")]
    df = spark.createDataFrame(rows, "worker long, ts string, event_id long, status string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = L.live_status(stream).writeStream.format("memory").queryName("live_status_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("live_status_test").collect())) == sorted(map(tuple, L.live_status(df).collect()))


def test_streamed_words_are_assigned_by_micro_batch(spark, tmp_path):
    words = spark.createDataFrame([(1, 0, 100, 300), (1, 1, 1200, 1400)], "video_id long, word_no long, start_ms long, end_ms long")
    words.write.parquet(str(tmp_path / "w"))
    seen = []
    d = diar(spark, (0, 1000, "A"), (1000, 2000, "B"))
    q = L.live_assign(spark.readStream.schema(words.schema).parquet(str(tmp_path / "w")), d, lambda df, _: seen.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.word_no: r.assigned for r in seen} == {0: "A", 1: "B"}


def test_repeated_words_keep_the_longer_one(spark):
    from talkloom.operators import subtitles as U

    rows = [(1, 0, "Hi", 0, 100), (1, 1, "you", 120, 200), (1, 2, "hi ", 300, 600), (1, 3, "hi", 900, 1000), (1, 4, "you", 950, 960)]
    got = [r.word_no for r in U.dedup_words(spark.createDataFrame(rows, "video_id long, word_no long, word string, start_ms long, end_ms long")).orderBy("start_ms").collect()]
    assert got == [1, 2, 3, 4]


def test_short_turns_join_leftwards_in_a_chain(spark):
    from talkloom.operators import subtitles as U

    rows = [(1, 0, "a", 0, 2000), (1, 1, "b", 2000, 2300), (1, 2, "c", 2300, 2500), (1, 3, "d", 3000, 3000)]
    got = [(r.turn_no, r.text, r.end_ms) for r in U.merge_short_turns(spark.createDataFrame(rows, "video_id long, turn_no long, text string, start_ms long, end_ms long")).orderBy("turn_no").collect()]
    assert got == [(0, "a", 2000), (1, "b c", 2500), (3, "d", 3000)]


def test_scores_of_the_corpus(spark):
    rows = [(1, 0, "Common words here."), (1, 1, "common words zebra quagga"), (1, 2, None), (2, 0, "common"), (2, 1, " ")]
    df = spark.createDataFrame(rows, "video_id long, cand_no long, text string").withColumns({c: F.lit("x") for c in ("n", "df", "r", "letters", "w", "long")})
    got = {(r.video_id, r.cand_no): r for r in I.score_candidates(df).collect()}
    assert len(got) == 5 and all(0 <= got[k][c] <= 1 for k in got for c in I.CRITERIA)
    # Rare words count more than common ones; words that the recording has had are not new.
    assert got[1, 1].specificity_score > got[2, 0].specificity_score > 0
    assert got[1, 0].surprise_novelty == 1 and 0 < got[1, 1].surprise_novelty < 1 and got[1, 1].personal_connection + got[1, 1].surprise_novelty == pytest.approx(1)
    assert got[1, 2].specificity_score == got[2, 1].completeness_arc == 0
    assert I.score_candidates(df.limit(0)).count() == 0 and I.score_candidates(df.filter("video_id = 2 and cand_no = 0")).first().specificity_score == 0
