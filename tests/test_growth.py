"""Steps whose work grew faster than the input, by their plans and their results."""

from pyspark.sql import functions as F

from talkloom.operators.phrases import phrase_places
from talkloom.streaming import live as L


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_waiting_words_are_one_row_of_state_for_each_bucket(spark, tmp_path):
    words, ivs = "video_id long, word_no long, start_ms long, end_ms long", "video_id long, iv_no long, speaker string, start_ms long, end_ms long"
    spark.createDataFrame([(1, n, n * 10, n * 10 + 9) for n in range(100)], words).write.parquet(f"{tmp_path}/w")
    spark.createDataFrame([(1, 0, "A", 0, 400), (1, 1, "B", 300, 900)], ivs).write.parquet(f"{tmp_path}/i")
    made = L.live_matches(spark.readStream.schema(words).parquet(f"{tmp_path}/w"), spark.readStream.schema(ivs).parquet(f"{tmp_path}/i"))
    query = made.writeStream.format("noop").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p.numRowsTotal for p in query.lastProgress.stateOperators]
    assert len(kept) == 1 and kept[0] <= 2


def test_phrases_of_the_same_words_are_looked_for_once(spark):
    words = spark.createDataFrame([(1, n, "abcab"[n], n * 10, n * 10 + 9) for n in range(5)], "video_id long, word_no long, word string, start_ms long, end_ms long")
    phrases = spark.createDataFrame([(n, "A b" if n % 2 else "b, C!") for n in range(200)], "phrase_no long, phrase string")
    made = phrase_places(words, phrases).groupBy("phrase_no").count()
    assert {(r[0] % 2, r[1]) for r in made.collect()} == {(1, 2), (0, 1)} and made.count() == 200
    assert "keys=[ws#" in plan(made)


def exchanges(df) -> int:
    """Shuffles of the plan, with no table small enough to be broadcast."""
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        df.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


CANDS, TURNS = "video_id long, cand_no long, start_ms long, end_ms long", "video_id long, cand_no long, turn_no long, speaker string, text string, start_ms long, end_ms long"
WORDS, DIAR = "video_id long, cand_no long, turn_no long, pos long, word string, start_ms long, end_ms long", "video_id long, iv_no long, speaker string, start_ms long, end_ms long"


def frames(spark):
    cands, turns = spark.createDataFrame([(1, 0, 0, 1000)], CANDS), spark.createDataFrame([(1, 0, 1, "A", "a b", 0, 500), (1, 0, 2, "A", "c", 500, 900)], TURNS)
    words = spark.createDataFrame([(1, 0, 1, 0, "a", 0, 200), (1, 0, 1, 1, "b", 200, 500)], WORDS)
    return cands, turns, words, spark.createDataFrame([(1, 0, "X", 0, 250), (1, 1, "Y", 250, 950)], DIAR)


def test_words_are_shuffled_once_for_their_speaker(spark):
    from talkloom.operators.relabel import apply_diarization

    made = apply_diarization(*frames(spark))
    got = [tuple(r)[2:] for r in made.orderBy("turn_no").collect()]
    assert got == [(1, "X", "a", 0, 200, 1), (2, "Y", "b", 200, 500, 1)]
    assert "first(" not in plan(made)


def test_sentences_are_rebuilt_without_their_text_on_every_word(spark):
    from talkloom.operators.relabel import rebuild_from_sentences

    cands, turns, words, diar = frames(spark)
    sents, segs = turns.withColumnRenamed("turn_no", "sent_no"), turns.select("video_id", F.col("turn_no").alias("seg_no"), "text", "start_ms")
    own = words.select("video_id", F.col("pos").alias("word_no"), "word", "start_ms", "end_ms", F.lit("A").alias("speaker"))
    made = rebuild_from_sentences(cands, sents, segs, own, diar)
    assert [tuple(r)[2:6] for r in made.orderBy("turn_no").collect()] == [(1, "X", "a", "a"), (2, "Y", "b", "b"), (3, "A", "c", "c")]
    assert "first(tr#" not in plan(made)


def test_characters_are_shuffled_once_for_their_input(spark):
    from talkloom.operators.alignment import input_of_chars

    chars = spark.createDataFrame([(1, i) for i in range(0, 5000, 500)], "video_id long, i long")
    ranges = spark.createDataFrame([(1, 2, 1000, 3500), (1, 1, 900, 1600), (1, 0, 4000, 4000)], "video_id long, input_no long, first long, stop long")
    made = input_of_chars(chars, ranges)
    assert dict(r[1:] for r in made.collect()) == {i: 1 if 900 <= i < 1600 else 2 if 1000 <= i < 3500 else None for i in range(0, 5000, 500)}
    assert exchanges(made) <= 3


EDGED = "video_id long, turn_no long, pos long, word string, start_ms long, end_ms long, turn_start long, turn_end long"


def test_runs_of_words_take_one_sort_for_each_direction(spark):
    from talkloom.operators.repair import redistribute_bunches
    from talkloom.operators.timing import interpolate_words

    times = [(0, 100), (None, None), (None, 9), (800, 900), (None, 950)]
    rows = spark.createDataFrame([(1, 1, n, "w", s, e, 0, 1000) for n, (s, e) in enumerate(times)], EDGED)
    made = interpolate_words(rows)
    assert plan(made).count("Sort [") <= 2
    assert [(r.start_ms, r.end_ms, r.interpolated) for r in made.orderBy("pos").collect()] == [(0, 100, False), (100, 450, True), (450, 800, True), (800, 900, False), (900, 1150, True)]
    rows = spark.createDataFrame([(1, 1, n, "w", s, s + 20, 0, 2000) for n, s in enumerate([0, 10, 20, 900, 1500, 1510])], EDGED)
    made = redistribute_bunches(rows)
    assert plan(made).count("Sort [") <= 2
    assert [(r.start_ms, r.end_ms) for r in made.orderBy("pos").collect()] == [(0, 156), (156, 313), (313, 470), (900, 920), (1500, 1750), (1750, 2000)]


def test_a_phrase_is_found_in_one_pass_over_the_words(spark):
    from talkloom.operators.subtitles import find_phrase

    cands = spark.createDataFrame([(1, 0, 100, "-"), (1, 1, 0, "b c")], "video_id long, cand_no long, start_ms long, text string")
    turns = spark.createDataFrame([(1, 0, 1, "-", None, 100)], "video_id long, cand_no long, turn_no long, text string, text_tr string, start_ms long")
    words = spark.createDataFrame([(1, 0, n, w, 100 + n * 10) for n, w in enumerate(["A", None, "bc", "d"])], "video_id long, cand_no long, pos long, word string, start_ms long")
    phrases = spark.createDataFrame([(1, 0, "BC D"), (1, 1, " c ")], "video_id long, cand_no long, phrase string")
    made = find_phrase(cands, turns, words, phrases)
    assert "Window" not in plan(made)
    assert {r.cand_no: r.offset_ms for r in made.collect()} == {0: 30, 1: 0}


def test_micro_runs_are_spread_from_two_sorts(spark):
    from talkloom.operators.timing import spread_micro_runs

    words = [(1, 1, 0, 0, 10), (1, 1, 1, 8, 12), (1, 1, 2, 4, 20), (1, 1, 3, 900, 1000), (1, 2, 0, 2000, 2010), (1, 2, 1, 2010, 2020), (1, 2, 2, 2020, 2030), (1, 3, 0, 3000, 3010), (2, 1, 0, 5, 6), (2, 1, 1, 6, 7), (2, 1, 2, 7, 8)]
    rows = spark.createDataFrame([(*w, 1000 * w[1] + 500) for w in words], "video_id long, turn_no long, pos long, start_ms long, end_ms long, turn_end long")
    made = spread_micro_runs(rows)
    got = [(r.start_ms, r.end_ms) for r in made.orderBy("video_id", "turn_no", "pos").collect()]
    assert got == [(0, 300), (300, 600), (600, 900), (900, 1000), (2000, 2266), (2266, 2532), (2532, 2798), (3000, 3010), (5, 503), (503, 1001), (1001, 1499)]
    assert plan(made).count("Sort [") == 2


def test_words_to_be_doubled_are_timed_once(spark):
    from talkloom.plans import q_subtitles
    from talkloom.plans.fixtures import view

    made = q_subtitles._doubled(lambda name: view(spark, "/root/testdata/sf0.001", name))
    assert "Union" not in plan(made) and plan(made).count("Scan parquet") == 1


def test_words_of_candidates_stay_with_their_recording(spark):
    from talkloom.operators.infer import corpus_scores

    rows = [(v, c, t) for v in (1, 2) for c, t in enumerate(["a b a.", "b c", "d?"])]
    cands = spark.createDataFrame(rows, "video_id long, cand_no long, text string").repartition(4, "video_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = corpus_scores(cands)._jdf.queryExecution()
        text = made.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [x for x in text.split("\n\n") if ") Exchange" in x and "hashpartitioning(w#" in x]
    assert moved and not any("k_open" in x for x in moved)


def test_only_sequences_that_phrases_say_are_shuffled_and_once(spark):
    """Two hundred phrases that begin with the same three words: their common places are not multiplied by them."""
    rows = [(v, n, "abcx"[n % 4], n * 10, n * 10 + 9) for v in range(3) for n in range(40)]
    words = spark.createDataFrame(rows, "video_id long, word_no long, word string, start_ms long, end_ms long")
    phrases = spark.createDataFrame([(n, f"a b c y{n}" if n else "A b, c x!") for n in range(200)] + [(0, "x a")], "phrase_no long, phrase string")
    made = phrase_places(words, phrases)
    got = sorted(tuple(r) for r in made.collect())
    assert got == sorted([(0, v, n, n + 3, n * 10, n * 10 + 39) for v in range(3) for n in range(0, 40, 4)] + [(0, v, n, n + 1, n * 10, n * 10 + 19) for v in range(3) for n in range(3, 39, 4)])
    assert exchanges(made) <= 6 and "BroadcastHashJoin [ws#" not in plan(made)
    assert "hashpartitioning(phrase_no#" not in plan(made)
