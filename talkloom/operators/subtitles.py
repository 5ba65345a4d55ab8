"""Subtitle words and lines, translated turns, and lookups by start time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.text import words
from talkloom.operators.intervals import candidate_pairs
from talkloom.operators.turns import islands, joined, speakers_in_order


def chars_to_words(chars: DataFrame) -> DataFrame:
    """Words of timed characters (video_id, i, ch, start_ms, end_ms, input_no): a word ends at a space or line feed
    and where the input changes; from its first character's start to its last one's end."""
    order = Window.partitionBy("video_id").orderBy("i")
    gap = F.col("ch").isin(" ", "\n")
    rows = islands(chars.withColumn("gap", gap), ["video_id"], ["i"], F.col("gap") | F.lag("gap").over(order) | (F.col("input_no") != F.lag("input_no").over(order)), "w").filter(~F.col("gap"))
    return rows.groupBy("video_id", "w").agg(F.min("input_no").alias("input_no"), F.min("i").alias("i"), joined("i", "ch", "").alias("word"), F.min_by("start_ms", "i").alias("start_ms"), F.max_by("end_ms", "i").alias("end_ms")).drop("w")


def dedup_words(words_: DataFrame, back: int = 10, near_ms: int = 500) -> DataFrame:
    """Words of a recording in order; one with the same lower-cased, trimmed text as one of the last `back` kept
    words, starting less than near_ms apart, is dropped or, if it lasts longer, stays in that one's stead, as the last
    word kept. What is kept depends on earlier choices, so a recording is folded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for r in pdf.sort_values(["start_ms", "word_no"], kind="stable").to_dict("records"):
            text = (r["word"] or "").lower().strip()
            for k in range(max(0, len(kept) - back), len(kept)):
                other = kept[k]
                if (other["word"] or "").lower().strip() == text and abs(other["start_ms"] - r["start_ms"]) < near_ms:
                    if r["end_ms"] - r["start_ms"] > other["end_ms"] - other["start_ms"]:
                        del kept[k]
                        kept.append(r)
                    break
            else:
                kept.append(r)
        return pd.DataFrame(kept, columns=["video_id", "word_no", "word", "start_ms", "end_ms"])

    return words_.select("video_id", "word_no", "word", "start_ms", "end_ms").groupBy("video_id").applyInPandas(run, "video_id long, word_no long, word string, start_ms long, end_ms long")


def subtitle_rows(words_: DataFrame, max_chars: int = 40, gap_ms: int = 300) -> DataFrame:
    """Adds line_no: a new line where the words would pass max_chars (cut to 15..60), after a gap over gap_ms, and
    where the speaker changes. Lengths add up along a line, so a recording is folded."""
    limit = max(15, min(60, max_chars))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        line, size, last, out = -1, 0, None, []
        for r in pdf.sort_values("word_no").to_dict("records"):
            n = len(r["word"])
            if last is None or size + n + 1 > limit or r["start_ms"] - last["end_ms"] > gap_ms or r["speaker"] != last["speaker"]:
                line, size = line + 1, n
            else:
                size += n + 1
            last = r
            out.append((r["video_id"], r["word_no"], line))
        return pd.DataFrame(out, columns=["video_id", "word_no", "line_no"])

    return words_.select("video_id", "word_no", "word", "start_ms", "end_ms", "speaker").groupBy("video_id").applyInPandas(run, "video_id long, word_no long, line_no long")


def merge_short_turns(turns: DataFrame, short_ms: int = 500) -> DataFrame:
    """From the last turn back, a turn that lasts under short_ms (but not nothing) joins the one before, which may
    then be judged by its new length: a fold from the right over a recording's turns, in the JVM, that keeps how far
    each run reaches; texts are joined afterwards."""
    listed = turns.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "text", "start_ms", "end_ms"))).alias("rows"))
    # stops: the last place of each run, right to left; end: of what has been joined to the turn that is judged now.
    stops = f"""aggregate(sequence(size(rows) - 1, 1), named_struct('stops', array(size(rows)), 'end', rows[size(rows) - 1].end_ms), (a, i) ->
      IF(a.end - rows[i].start_ms > 0 AND a.end - rows[i].start_ms < {short_ms}, named_struct('stops', a.stops, 'end', greatest(rows[i - 1].end_ms, a.end)),
        named_struct('stops', array_append(a.stops, i), 'end', rows[i - 1].end_ms)), a -> array_sort(a.stops))"""
    runs = listed.withColumn("stops", F.expr(f"IF(size(rows) < 2, array(size(rows)), {stops})"))
    runs = runs.select("video_id", "rows", F.col("stops"), F.posexplode("stops").alias("k", "stop")).withColumn("first", F.expr("IF(k = 0, 1, stops[k - 1] + 1)"))
    run = runs.select("video_id", F.expr("slice(rows, first, stop - first + 1)").alias("run"))
    said = "IF(size(run) = 1, run[0].text, array_join(filter(run.text, t -> t <> ''), ' '))"
    return run.selectExpr("video_id", "run[0].turn_no AS turn_no", f"{said} AS text", "run[0].start_ms AS start_ms", "array_max(run.end_ms) AS end_ms")


def expansion_candidates(turns: DataFrame) -> DataFrame:
    """Translated turns (source, text) that are too short: under 0.65, 0.70 or 0.75 of the source's words for under
    10, up to 25 and more of them; with the words to aim at."""
    n, cur = F.size(words(F.col("source"))), F.size(words(F.col("text")))
    least = F.when(F.col("n") < 10, 0.65).when(F.col("n") <= 25, 0.70).otherwise(0.75)
    rows = turns.withColumn("n", n).withColumn("cur", cur).withColumn("least", least)
    return rows.filter((F.col("n") > 0) & (F.col("cur") / F.col("n") < F.col("least"))).withColumn("target", F.greatest((F.col("n") * F.col("least")).cast("int"), F.col("cur") + 1)).drop("least")


def speaker_colors(turns: DataFrame, palette: tuple[str, ...] = ("white", "yellow")) -> DataFrame:
    """A colour for each speaker, by the order in which they first speak."""
    return speakers_in_order(turns).select("video_id", "speaker", F.get(F.array(*[F.lit(c) for c in palette]), F.col("rank") % len(palette)).alias("color"))


def match_by_start(sentences: DataFrame, segs: DataFrame, exact: bool = True) -> DataFrame:
    """For each sentence (sent_no, start_ms) the segment of equal start in 10 ms steps (the last such one; not
    without `exact`), else the segment of nearest start (the first of equals)."""
    key = lambda c: F.bround(F.col(c) / 10, 0)
    side = segs.select("video_id", "seg_no", F.col("start_ms").alias("at"))
    same = side.withColumn("k", key("at")).groupBy("video_id", "k").agg(F.max("seg_no").alias("hit"))
    rows = sentences.select("video_id", "sent_no", "start_ms").withColumn("k", key("start_ms"))
    rows = rows.join(same, ["video_id", "k"], "left") if exact else rows.withColumn("hit", F.lit(None).cast("long"))
    # The nearest start on either side of a sentence: both kinds of rows on one sorted line.
    asked = rows.filter("hit is null").select("video_id", F.col("start_ms").alias("t"), "sent_no", F.lit(None).cast("long").alias("seg_no"))
    starts = side.groupBy("video_id", F.col("at").alias("t")).agg(F.min("seg_no").alias("seg_no"))
    line = asked.unionByName(starts.select("video_id", "t", F.lit(None).cast("long").alias("sent_no"), "seg_no"))
    w, seg = Window.partitionBy("video_id").orderBy("t"), F.when(F.col("seg_no").isNotNull(), F.struct("t", "seg_no"))
    before = F.last(seg, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first(seg, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    line = line.withColumn("b", before).withColumn("a", after).filter("sent_no is not null")
    option = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("t") - F.col(c)["t"]).alias("d"), F.col(c)["seg_no"].alias("n")))
    best = F.array_min(F.filter(F.array(option("b"), option("a")), lambda x: x.isNotNull()))["n"]
    near = line.select("video_id", "sent_no", best.alias("near"))
    return rows.join(near, ["video_id", "sent_no"], "left").select("video_id", "sent_no", F.coalesce("hit", "near").alias("seg_no"))


def crop_plan(focus_x: DataFrame, focus_y: DataFrame, width: int, height: int, crop_w: int, crop_h: int) -> DataFrame:
    """Pixel offsets of the crop for each horizontal focus interval; the vertical focus is that of the first
    interval that holds its start, 0.5 where there is none."""
    ys = focus_y.select("video_id", F.col("iv_no").alias("y_no"), F.col("start_ms").alias("y0"), F.col("end_ms").alias("y1"), F.col("focus").alias("fy"))
    xs = focus_x.select("video_id", "iv_no", "start_ms", "focus")
    hits = candidate_pairs(xs, ys, (F.col("start_ms"), F.col("start_ms")), (F.col("y0"), F.col("y1"))).filter("start_ms >= y0 and start_ms < y1").groupBy("video_id", "iv_no").agg(F.min_by("fy", "y_no").alias("fy"))
    at = lambda f, full, crop: F.greatest(F.lit(0), F.least(F.lit(full - crop), F.bround(f * full - crop / 2, 0).cast("int")))
    return xs.join(hits, ["video_id", "iv_no"], "left").select("video_id", "iv_no", at(F.col("focus"), width, crop_w).alias("x"), at(F.coalesce("fy", F.lit(0.5)), height, crop_h).alias("y"))


def find_phrase(cands: DataFrame, turns: DataFrame, words_: DataFrame, phrases: DataFrame) -> DataFrame:
    """Where a phrase is said in a candidate, from the candidate's start_ms on (0 at the least): letter case aside, in
    the first turn whose text or text_tr holds it; else at the word that completes it in the candidate's words,
    joined by spaces; else 0 if the candidate's whole text holds it; else null.

    phrases: video_id, cand_no, phrase (one a candidate); cands: start_ms, text; turns: turn_no, text, text_tr,
    start_ms; words: pos, word, start_ms."""
    keys = ["video_id", "cand_no"]
    said = phrases.select(*keys, "phrase", F.lower(F.trim("phrase")).alias("p")).filter("p <> ''")
    holds = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.col("p"))
    in_turn = turns.join(said, keys).filter(holds("text") | holds("text_tr")).groupBy(*keys).agg(F.min_by("start_ms", "turn_no").alias("t_at"))
    # The words of a candidate as one row; the hit ends at the word with which the joined text first holds the phrase.
    spoken = words_.join(said, keys).withColumn("w", F.lower(F.coalesce("word", F.lit(""))))
    full = spoken.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "w", "start_ms"))).alias("line"), F.first("p").alias("p"))
    full = full.withColumn("at", F.instr(F.array_join(F.transform("line", lambda x: x["w"]), " "), F.col("p"))).filter("at > 0").withColumn("stop", F.col("at") + F.length("p") - 1)
    state = lambda upto, n: F.struct(upto.cast("long").alias("upto"), n.cast("int").alias("n"))
    step = lambda s, x: F.when(s["upto"] >= F.col("stop"), s).otherwise(state(s["upto"] + F.length(x["w"]) + 1, s["n"] + 1))
    in_words = full.select(*keys, F.get("line", F.aggregate("line", state(F.lit(0), F.lit(-1)), step)["n"])["start_ms"].alias("w_at"))
    rows = phrases.join(said.select(*keys, "p"), keys, "left").join(cands.select(*keys, F.col("start_ms").alias("c0"), F.lower("text").alias("c_text")), keys)
    rows = rows.join(in_turn, keys, "left").join(in_words, keys, "left")
    away = lambda c: F.greatest(F.lit(0), F.col(c) - F.col("c0"))
    whole = F.when(F.contains(F.coalesce("c_text", F.lit("")), F.col("p")), 0)
    at = F.when(F.col("t_at").isNotNull(), away("t_at")).when(F.col("w_at").isNotNull(), away("w_at")).otherwise(whole)
    return rows.select(*keys, "phrase", at.cast("long").alias("offset_ms"))
