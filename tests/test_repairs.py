"""Hand-made edge cases of relabelling, rebuilding, aligning, focusing and repairing."""

import pytest

from talkloom.operators import alignment as A
from talkloom.operators import focus as C
from talkloom.operators.tracks import track_boxes
from talkloom.operators import relabel as R
from talkloom.operators import repair as P
from talkloom.operators import selection as L
from talkloom.operators import turns as T

WORDS = "video_id long, turn_no long, pos long, word string, start_ms long, end_ms long"
CANDS = "video_id long, cand_no long, start_ms long, end_ms long"
TURNS = "video_id long, cand_no long, turn_no long, speaker string, text string, start_ms long, end_ms long"
CAND_WORDS = "video_id long, cand_no long, turn_no long, pos long, word string, start_ms long, end_ms long"
DIAR = "video_id long, iv_no long, start_ms long, end_ms long, speaker string"


def words(spark, *rows):
    return spark.createDataFrame([(1, 0, i, w, a, b) for i, (w, a, b) in enumerate(rows)], WORDS)


def times(df):
    return [(r.start_ms, r.end_ms) for r in df.orderBy("pos").collect()]


def test_relabelled_turns_come_from_words_and_keep_what_nobody_spoke(spark):
    cands = spark.createDataFrame([(1, 0, 0, 4000), (1, 1, 50_000, 60_000)], CANDS)
    turns = spark.createDataFrame([(1, 0, 0, "X", "old text", 0, 2000), (1, 0, 1, "Y", "no words", 2000, 3000), (1, 0, 2, None, "tail", 3000, 4000), (1, 1, 0, "Z", "far", 50_000, 51_000), (1, 1, 1, "Z", "away", 51_000, 52_000)], TURNS)
    w = spark.createDataFrame([(1, 0, 0, 0, "a", 0, 400), (1, 0, 0, 1, "b", 1000, None), (1, 0, 0, 2, "c", 1600, 1700)], CAND_WORDS)
    d = spark.createDataFrame([(1, 0, 0, 900, "A"), (1, 1, 900, 1500, "B"), (1, 2, 2100, 2900, "B")], DIAR)
    got = {(r.cand_no, r.turn_no): (r.speaker, r.text, r.start_ms, r.end_ms, r.n_words) for r in R.apply_diarization(cands, turns, w, d).collect()}
    # b has no end and takes its start; c and the silent turn are nearest to B; the last one keeps its own, none.
    assert got == {(0, 1): ("A", "a", 0, 400, 1), (0, 2): ("B", "b c", 1000, 1700, 2), (0, 3): (None, "tail", 3000, 4000, 0), (1, 1): ("Z", "far", 50_000, 51_000, 0), (1, 2): ("Z", "away", 51_000, 52_000, 0)}
    assert {r.cand_no: list(r.speakers) for r in R.candidate_speakers(R.apply_diarization(cands, turns, w, d)).collect()} == {0: ["A", "B"], 1: ["Z"]}
    assert R.apply_diarization(cands.limit(0), turns, w, d).count() == 0


def test_voices_go_round_their_pools_in_the_order_of_speakers(spark):
    met = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (2, "speaker_0", 0)], "video_id long, speaker string, rank int")
    pools = {"male": ["m1", "m2"], "female": ["f1"]}
    got = {(r.video_id, r.speaker): r.voice for r in R.voice_plan(met, "mixed_duo", pools, n_speakers=2).collect()}
    assert got == {(1, "b"): "m1", (1, "a"): "f1", (1, "SPEAKER_00"): "m2", (1, "SPEAKER_01"): "m1", (1, "__default__"): "m1", (2, "speaker_0"): "m1", (2, "SPEAKER_00"): "f1", (2, "SPEAKER_01"): "m2", (2, "__default__"): "m1"}
    genders = spark.createDataFrame([(1, "b", "female"), (1, "a", "unknown")], "video_id long, speaker string, gender string")
    assert {r.speaker: r.voice for r in R.voice_plan(met.filter("video_id = 1"), "mixed_duo", pools, genders).collect()} == {"b": "f1", "a": "f1", "__default__": "f1"}


def test_recordings_without_speakers_have_the_default(spark):
    cands = spark.createDataFrame([(1, 0, []), (2, 0, None), (3, 0, ["", "B"])], "video_id long, cand_no long, speakers array<string>")
    turns = spark.createDataFrame([(3, 0, 0, "A", "x", 0, 1), (1, 0, 0, None, "x", 0, 1)], TURNS)
    got = sorted((r.video_id, r.speaker, r["rank"]) for r in R.speakers_met(cands, turns).collect())
    assert got == [(1, "speaker_0", 0), (2, "speaker_0", 0), (3, "A", 1), (3, "B", 0)]


def test_rebuilt_sentences_share_their_text_among_speakers(spark):
    edits = spark.createDataFrame([(1, 0, 0, 5000)], CANDS)
    sents = spark.createDataFrame([(1, 0, 0, "one two three four", 0, 2000, "S"), (1, 0, 1, " ", 2000, 2100, "S"), (1, 0, 2, "alone", 3000, 4000, None)], "video_id long, cand_no long, sent_no long, text string, start_ms long, end_ms long, speaker string")
    segs = spark.createDataFrame([(1, 0, 0, 2000, "said here", "P"), (1, 1, 3004, 4000, "original", "P")], "video_id long, seg_no long, start_ms long, end_ms long, text string, speaker string")
    w = spark.createDataFrame([(1, 0, 0, "said", 0, 300, "P"), (1, 0, 1, "here", 400, 1300, "Q"), (1, 0, 9, "late", 9000, 9100, "Q")], "video_id long, seg_no long, word_no long, word string, start_ms long, end_ms long, speaker string")
    got = [tuple(r)[3:] for r in R.rebuild_from_sentences(edits, sents, segs, w).orderBy("turn_no").collect()]
    assert got == [("P", "said", "one", 0, 300), ("Q", "here", "two three four", 400, 1300), ("SPEAKER_00", "original", "alone", 3000, 4000)]
    cut = R.rebuild_from_segments(edits.selectExpr("video_id", "cand_no", "1000L AS start_ms", "3500L AS end_ms"), segs.selectExpr("*", "'t' AS text_tr")).collect()
    assert [tuple(r)[3:] for r in cut] == [("P", "t t", "t t", 1000, 3500)]


def test_boundaries_match_by_text_then_time_then_nearest(spark):
    sents = spark.createDataFrame([(1, 0, "Yes.", 0), (1, 1, "A longer one.", 3000), (1, 2, "Yes.", 6000)], "video_id long, sent_no long, text string, start_ms long")
    cands = spark.createDataFrame([(1, 0, "Yes.  A longer one.", 0, 5000), (1, 1, "unknown", 2800, 5000), (1, 2, None, 90_000, 91_000)], "video_id long, cand_no long, text string, start_ms long, end_ms long")
    assert {r.cand_no: (r.start_idx, r.end_idx) for r in R.match_boundaries(cands, sents).collect()} == {0: (0, 1), 1: (1, 1), 2: (2, 2)}


def test_words_are_aligned_by_sequence_and_likeness():
    assert A.matches(["The", "quick", "fox!"], ["the", "quick", "fox"]) == {0: 0, 1: 1, 2: 2}
    assert A.matches(["a", "b", "c"], ["a", "x", "c"]) == {0: 0, 1: 1, 2: 2}
    assert A.matches(["alpha", "beta"], []) == {} and A.matches([], ["a"]) == {}
    assert A.matches(["one", "words", "two"], ["one", "two", "word"]) == {0: 0, 2: 1, 1: 2}


def test_alignment_keeps_every_expected_word(spark):
    expected = words(spark, ("Hello,", 0, 0), ("big", 0, 0), ("world", 0, 0)).drop("start_ms", "end_ms")
    heard = spark.createDataFrame([(1, 0, "hello", 10, 20), (1, 1, "world!", 30, 40), (2, 0, "other", 1, 2)], "video_id long, word_no long, word string, start_ms long, end_ms long")
    got = [(r.word, r.start_ms, r.heard) for r in A.align_words(expected, heard).orderBy("pos").collect()]
    assert got == [("Hello,", 10, "hello"), ("big", None, None), ("world", 30, "world!")]


def test_a_candidate_never_gives_all_its_sentences(spark):
    cands = spark.createDataFrame([(1, 0, "One a. Two b.", 0, 10, 0, 1), (1, 1, "Three c.", 10, 20, 1, 1), (1, 2, "Four d. Five e. Six f.", 20, 30, 2, 0)], CANDS.replace("start_ms", "text string, start_ms") + ", trim_first int, trim_last int")
    w = spark.createDataFrame([(1, 0, i, "w", i, i + 1) for i in range(4)] + [(1, 2, i, "w", 20 + i, 21 + i) for i in range(6)], "video_id long, cand_no long, pos long, word string, start_ms long, end_ms long")
    got = [(r.text, r.start_ms, r.end_ms, r.n_words, r.moved) for r in A.move_sentences(cands, w).orderBy("cand_no").collect()]
    assert got == [("One a.", 0, 2, 2, True), ("Two b. Three c. Four d. Five e.", 2, 24, 6, True), ("Six f.", 24, 26, 2, True)]


def test_short_words_grow_forward_then_backward(spark):
    got = times(P.expand_short_words(words(spark, ("...", 0, 10), ("word", 100, 120), ("next", 180, 500), ("x", 400, 450))))
    # 150 ms for "word": 60 ahead, then 70 back; "x" is pushed behind "next" and grows at the end.
    assert got == [(0, 10), (30, 180), (180, 500), (500, 650)]


def test_overlaps_gaps_and_slack_of_words(spark):
    assert times(P.share_overlaps(words(spark, ("a", 0, 300), ("b", 200, 300), ("c", 300, 300)))) == [(0, 275), (275, 300), (300, 300)]
    assert times(P.close_gaps(words(spark, ("a", 0, 100), ("b", 350, 400), ("c", 651, 700)))) == [(0, 350), (350, 400), (651, 700)]
    assert times(P.borrow_slack(words(spark, ("a", 0, 450), ("b", 450, 500), (".", 500, 510)))) == [(0, 350), (350, 500), (500, 510)]
    assert P.share_overlaps(words(spark, ("a", 0, 1)).limit(0)).count() == 0


def test_bunched_words_are_spread_in_their_window_or_over_the_turn(spark):
    edged = lambda df, end: df.selectExpr("*", "0L AS turn_start", f"{end}L AS turn_end")
    few = edged(words(spark, ("a", 0, 50), ("b", 60, 100), ("c", 1000, 1200)), 1500)
    assert times(P.redistribute_bunches(few)) == [(0, 275), (275, 550), (1000, 1200)]
    many = edged(words(spark, *[("w", i * 10, i * 10 + 10) for i in range(5)], ("z", 400, 500)), 1200)
    assert times(P.redistribute_bunches(many)) == [(i * 200, i * 200 + 200) for i in range(6)]


def test_untimed_turns_take_segments_or_share_the_gap(spark):
    rows = [(1, 0, 3, None, None, 0, 500), (1, 1, 1, 1000, 2000, None, None), (1, 2, 1, None, None, None, None), (1, 3, 3, None, None, 100, 900), (1, 4, 1, 4000, 5000, None, None), (2, 0, 0, None, None, None, None)]
    df = spark.createDataFrame([(*r, 100, 6000) for r in rows], "video_id long, turn_no long, n_words int, tts_start long, tts_end long, seg_start long, seg_end long, leading_ms long, duration_ms long")
    got = [(r.tts_start, r.tts_end, r.source) for r in P.interpolate_turns(df).orderBy("video_id", "turn_no").collect()]
    assert got == [(100, 600, "segment"), (1000, 2000, "timed"), (2050, 2512, "interpolated"), (2562, 3949, "interpolated"), (4000, 5000, "timed"), (100, 6000, "interpolated")]


def test_bunched_turns_are_spread_and_later_ones_pushed(spark):
    df = spark.createDataFrame([(1, 0, 0, 500, 9000), (1, 1, 400, 600, 9000), (1, 2, 700, 1500, 9000), (1, 3, 1600, 1700, 9000)], "video_id long, turn_no long, tts_start long, tts_end long, duration_ms long")
    spread = P.spread_turns(df)
    assert [tuple(r)[2:] for r in spread.orderBy("turn_no").collect()] == [(0, 400, True, 0), (450, 850, True, 0), (900, 1700, False, 200), (1750, 1850, False, 150)]
    w = spark.createDataFrame([(1, 0, 0, "a", 0, 1), (1, 0, 1, "b", 1, 2), (1, 2, 0, "c", 700, 800)], WORDS)
    assert sorted(times(P.words_of_spread_turns(w, spread))) == [(0, 200), (200, 400), (900, 1000)]


def test_pauses_only_where_the_speaker_changes_over_real_silence(spark):
    rows = [(1, 0, "A", 0, 0, 900), (1, 1, "A", 3000, 1000, 1900), (1, 2, "B", 6000, 2000, 2900), (1, 3, "A", 9000, 2910, 3800), (1, 4, "B", 9100, 5000, 5100), (1, 5, None, 99_000, 6000, 6100)]
    got = [tuple(r)[2:] for r in P.drift_plan(spark.createDataFrame(rows, "video_id long, turn_no long, speaker string, start_ms long, tts_start long, tts_end long")).orderBy("turn_no").collect()]
    assert got == [(0, None, None, 0), (0, None, None, 0), (2000, 1900, 2000, 1900), (0, None, None, 1900), (2000, 3800, 5000, 2700), (0, None, None, 2700)]


BOXES = "video_id long, ts_ms long, box_no long, x double, y double, w double, h double, center_x double, area double, score double"


def test_tracks_survive_missed_frames_and_are_predicted(spark):
    at = lambda ts, x: (1, ts, 0, float(x), 0.0, 100.0, 100.0, x + 50.0, 1e4, 0.9)
    boxes = spark.createDataFrame([at(0, 0), at(1, 10), at(2, 20), at(4, 20), at(5, 900)], BOXES)
    frames = spark.createDataFrame([(1, t) for t in range(12)], "video_id long, ts_ms long")
    got = {(r.ts_ms, r.track_id): (round(r.center_x, 3), r.predicted) for r in track_boxes(frames, boxes).collect()}
    assert got[0, 1] == (50.0, False) and got[1, 1] == (57.0, False) and got[2, 1] == (66.1, False)
    assert got[3, 1] == (66.1, True) and got[4, 1] == (68.83, False) and got[5, 1] == (68.83, True) and got[5, 2] == (950.0, False)
    assert (9, 1) in got and (10, 1) not in got and (6, 2) not in got


def test_focus_of_scenes_and_clips(spark):
    box = lambda ts, n, x, size=100.0, score=0.9: (1, ts, n, x - size / 2, 0.0, size, size, float(x), size * size, score)
    rows = [box(0, 0, 480), box(100, 0, 480), box(1000, 0, 200, 300.0, 0.4), box(1000, 1, 1700), box(1100, 0, 200, 300.0, 0.4), box(1100, 1, 1700)]
    scenes = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 1000) for i in range(3)], "video_id long, scene_no long, start_ms long, end_ms long")
    boxes = spark.createDataFrame(rows, BOXES)
    got = [round(r.focus, 3) for r in C.scene_focus(scenes, C.scene_stats(boxes, scenes)).orderBy("scene_no").collect()]
    # One face; the small face is better seen than the dominant one; no face: the last focus.
    assert got == [0.25, 0.8, 0.8]
    assert C.scene_focus(scenes.limit(1), C.scene_stats(boxes.limit(0), scenes)).first().focus == 0.5
    clip = spark.createDataFrame([box(t, n, x) for t in (0, 1) for n, x in ((0, 400), (1, 1600))] + [box(2, 0, 420), box(3, 0, 430)], BOXES).selectExpr("*", "0L AS clip_no")
    turns = spark.createDataFrame([(1, 0, 2, 9)], "video_id long, clip_no long, start_ms long, end_ms long")
    r = C.clip_focus(clip, turns).first()
    assert (round(r.left_at, 4), round(r.right_at, 4)) == (0.2083, 0.8333) and abs(r.focus - (0.8 * 400 / 1920 + 0.2 * 425 / 1920)) < 1e-6


def test_results_replace_what_they_answer_alone(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, None)], "video_id long, seg_no long, text string")
    results = spark.createDataFrame([(1, 0, "A"), (1, 1, None)], "video_id long, seg_no long, reply string")
    keys = ["video_id", "seg_no"]
    assert sorted(str(r.text) for r in L.attach_results(rows, results, keys, {"text": "reply"}).collect()) == ["A", "None", "b"]
    assert [r.seg_no for r in L.missing_ids(rows, results, keys).collect()] == [2]


def test_joined_turns_of_merged_candidates(spark):
    turns = spark.createDataFrame([(1, 0, 0, "A", "a", 0, 10), (1, 0, 1, "B", "b", 10, 20), (1, 1, 0, "B", "c", 20, 30), (1, 2, 0, "B", "d", 30, 40)], TURNS)
    into = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 2)], "video_id long, cand_no long, into long")
    got = sorted((r.cand_no, r.turn_no, r.speaker, r.text, r.end_ms) for r in T.join_turns(turns, into, "cand_no").collect())
    assert got == [(0, 1, "A", "a", 10), (0, 2, "B", "b c", 30), (2, 1, "B", "d", 40)]


@pytest.mark.parametrize("tempo,factors", [(1.0, []), (1.25, [1.25]), (5.0, [2.0, 2.0, 1.25]), (0.2, [0.5, 0.5, 0.8])])
def test_tempo_as_a_chain_of_factors(spark, tempo, factors):
    from pyspark.sql import functions as F

    from talkloom.operators.timing import tempo_chain

    assert spark.range(1).select(tempo_chain(F.lit(tempo)).alias("f")).first().f == factors
