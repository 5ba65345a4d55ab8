"""Cutting recordings and texts into chunks.

Rules in which each cut depends on the one before are folds over one recording (bounded: two hours): where the fold
keeps cuts alone, aggregate() over its sorted rows, in the JVM; else applyInPandas. The others are window functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.text import split_sentences, words
from talkloom.operators.intervals import candidate_pairs
from talkloom.operators.turns import islands, joined

SIZES = (30, 45, 60, 90, 120, 180)  # fixed values: window sizes in seconds


def _fold(df: DataFrame, order: list[str], fn, schema: str) -> DataFrame:
    """fn over the rows of each recording in order; fn gets and gives lists of dicts."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fn(pdf.sort_values(order, kind="stable").to_dict("records")), columns=names)

    return df.groupBy("video_id").applyInPandas(run, schema)


def time_windows(segs: DataFrame, min_s: int, max_s: int, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Windows of each size side by side and one more at the tail, with the text of the segments they touch; equal
    texts keep the first window (by size, then start)."""
    chosen = [s for s in sizes if min_s <= s <= max_s] or [s for s in [(min_s + max_s) // 2] if s > 0]
    stop = segs.groupBy("video_id").agg(F.max_by("end_ms", "seg_no").alias("dur"))
    grid = stop.withColumn("size", F.explode(F.array(*[F.lit(s) for s in chosen])))
    top = F.greatest(F.floor((F.col("dur") - F.col("size") * 1000) / 1000), F.lit(0))
    grid = grid.withColumn("starts", F.transform(F.sequence(F.lit(0).cast("long"), top, F.col("size").cast("long")), lambda x: x * 1000))
    tail = F.element_at("starts", -1) + F.col("size") * 1000 < F.col("dur")
    grid = grid.withColumn("w_start", F.explode(F.when(tail, F.concat("starts", F.array(F.greatest(F.col("dur") - F.col("size") * 1000, F.lit(0).cast("long"))))).otherwise(F.col("starts"))))
    grid = grid.select("video_id", "size", "w_start", F.least(F.col("w_start") + F.col("size") * 1000, F.col("dur")).alias("w_end"))
    hits = candidate_pairs(segs.select("video_id", "seg_no", "start_ms", "end_ms", "text"), grid, (F.col("start_ms"), F.col("end_ms")), (F.col("w_start"), F.col("w_end")), 30_000).filter("start_ms < w_end and end_ms > w_start")
    made = hits.groupBy("video_id", "size", "w_start", "w_end").agg(joined("seg_no", "text").alias("text"))
    first = F.row_number().over(Window.partitionBy("video_id", "text").orderBy("size", "w_start"))
    return made.withColumn("n", first).filter("n = 1").select("video_id", "size", F.col("w_start").alias("start_ms"), F.col("w_end").alias("end_ms"), "text")


def _rows_in_order(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """(video_id, rows): the rows of each recording in order, as an array for the folds below, which run in the JVM."""
    row = F.struct(*order, *[c for c in columns if c not in order])
    return df.groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def large_chunks(segs: DataFrame, size_ms: int = 600_000, overlap_ms: int = 60_000) -> DataFrame:
    """Chunks of size_ms from a segment's start, at least one segment each; the next one begins at the first
    segment that starts size_ms - overlap_ms after this one's start or later."""
    step = size_ms - overlap_ms
    cuts = f"""aggregate(sequence(2, size(rows)), named_struct('cuts', array(1), 'start', rows[0].start_ms),
      (a, i) -> IF(rows[i - 1].start_ms >= a.start + {step}, named_struct('cuts', array_append(a.cuts, i), 'start', rows[i - 1].start_ms), a), a -> a.cuts)"""
    listed = _rows_in_order(segs, ["seg_no"], ["start_ms", "end_ms"])
    chunks = listed.select("video_id", "rows", F.posexplode(F.expr(f"IF(size(rows) < 2, array(1), {cuts})")).alias("chunk_no", "at"))
    # The first segment from the chunk's own one on that ends too late for it; a chunk has one segment at least.
    late = f"array_position(transform(slice(rows, at, size(rows)), r -> r.end_ms > rows[at - 1].start_ms + {size_ms}), true)"
    chunks = chunks.withColumn("late", F.expr(late)).withColumn("to", F.expr("cast(IF(late = 0, size(rows), at + greatest(late, 2) - 2) AS int)"))
    return chunks.selectExpr("video_id", "cast(chunk_no AS long) AS chunk_no", "rows[at - 1].start_ms AS start_ms", "rows[to - 1].end_ms AS end_ms", "rows[at - 1].seg_no AS first_seg", "rows[to - 1].seg_no AS last_seg")


def boundary_times(chunks: DataFrame, words_: DataFrame, numbers: DataFrame) -> DataFrame:
    """Start time of sentence number n of a chunk: the share of the chunk's words before it, taken of its timed
    words, rounded down and kept inside. chunks: chunk_no, text; words_: chunk_no, word_no, start_ms (null: untimed);
    numbers: chunk_no, n (from 1). Numbers without a sentence, and chunks without a timed word, give no row."""
    sents = chunks.select("video_id", "chunk_no", F.posexplode(split_sentences(F.col("text"))).alias("i", "s")).withColumn("n_w", F.size(words(F.col("s"))))
    w = Window.partitionBy("video_id", "chunk_no")
    before = F.coalesce(F.sum("n_w").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sents = sents.withColumn("before", before).withColumn("all", F.sum("n_w").over(w))
    live = words_.filter("start_ms is not null").select("video_id", "chunk_no", "start_ms", F.row_number().over(w.orderBy("word_no")).alias("at"), F.count("*").over(w).alias("timed"))
    counts = live.filter("at = 1").select("video_id", "chunk_no", "timed")
    at = sents.join(numbers.withColumn("i", F.col("n") - 1), ["video_id", "chunk_no", "i"]).join(counts, ["video_id", "chunk_no"])
    at = at.withColumn("at", F.least(F.floor(F.col("before") / F.col("all") * F.col("timed")), F.col("timed") - 1) + 1)
    return at.join(live.drop("timed"), ["video_id", "chunk_no", "at"]).select("video_id", "chunk_no", "n", "start_ms")


def thin_boundaries(bounds: DataFrame, min_ms: int = 30_000) -> DataFrame:
    """Bounds of a recording (first and last are its edges) at least min_ms apart; the last edge always stays and
    takes the place of one that is too near."""
    listed = bounds.groupBy("video_id").agg(F.array_sort(F.collect_list("at_ms")).alias("ts")).withColumn("stop", F.element_at("ts", -1))
    kept = F.aggregate(F.slice("ts", 2, F.size("ts")), F.slice("ts", 1, 1), lambda k, t: F.when(t - F.element_at(k, -1) >= min_ms, F.array_append(k, t)).otherwise(k))
    end, stop = F.element_at("kept", -1), F.col("stop")
    replaced = F.concat(F.slice("kept", F.lit(1), F.size("kept") - 1), F.array(stop))
    whole = F.when(end == stop, F.col("kept")).when((F.size("kept") > 1) & (stop - end < min_ms), replaced).otherwise(F.array_append("kept", stop))
    made = listed.withColumn("kept", kept).select("video_id", F.posexplode(whole).alias("n", "at_ms"))
    return made.select("video_id", F.col("n").cast("long").alias("n"), "at_ms")


def split_by_span(segs: DataFrame, span_ms: int = 180_000) -> DataFrame:
    """Adds chunk_no: a chunk ends with the segment at which it spans span_ms or more."""
    # The places at which chunks begin; start is null until the next chunk's first segment is met.
    cuts = f"""aggregate(sequence(1, size(rows)), named_struct('cuts', array(1), 'start', cast(null AS bigint)), (a, i) ->
      IF(rows[i - 1].end_ms - coalesce(a.start, rows[i - 1].start_ms) >= {span_ms}, named_struct('cuts', array_append(a.cuts, i + 1), 'start', cast(null AS bigint)),
        named_struct('cuts', a.cuts, 'start', coalesce(a.start, rows[i - 1].start_ms))), a -> a.cuts)"""
    listed = _rows_in_order(segs, ["seg_no"], ["start_ms", "end_ms"]).withColumn("cuts", F.expr(cuts))
    at = listed.select("video_id", "cuts", F.posexplode("rows").alias("i", "r"))
    return at.selectExpr("video_id", "r.seg_no AS seg_no", "cast(size(filter(cuts, c -> c <= i + 1)) - 1 AS long) AS chunk_no")


def dedup_chunks(chunks: DataFrame, tolerance_ms: int = 1000) -> DataFrame:
    """In order of start (then chunk_no): a chunk that starts tolerance_ms or more before the last kept one ends
    competes with it, and the longer of the two stays (the earlier of equals)."""

    def run(rows: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for r in rows:
            if kept and r["start_ms"] < kept[-1]["end_ms"] - tolerance_ms:
                if r["end_ms"] - r["start_ms"] > kept[-1]["end_ms"] - kept[-1]["start_ms"]:
                    kept[-1] = r
            else:
                kept.append(r)
        return kept

    return _fold(chunks.select("video_id", "chunk_no", "start_ms", "end_ms"), ["start_ms", "chunk_no"], run, "video_id long, chunk_no long, start_ms long, end_ms long")


def short_runs(chunks: DataFrame, min_ms: int = 20_000) -> DataFrame:
    """Adds `into`: the chunk that a chunk is part of once those shorter than min_ms have joined the one before; the
    first one stays. A short chunk never begins a run, so runs are counted, not folded."""
    runs = islands(chunks, ["video_id"], ["chunk_no"], F.col("end_ms") - F.col("start_ms") >= min_ms)
    return runs.withColumn("into", F.min("chunk_no").over(Window.partitionBy("video_id", "island"))).drop("island")


def merge_short(chunks: DataFrame, min_ms: int = 20_000) -> DataFrame:
    """Chunks (chunk_no, start_ms, end_ms, text, speakers) shorter than min_ms join the one before: texts joined,
    speakers in the order they are first met. Their turns follow by join_turns() with short_runs()."""
    rows = short_runs(chunks, min_ms)
    met = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "speakers"))), lambda r: r["speakers"])))
    made = rows.groupBy("video_id", F.col("into").alias("chunk_no")).agg(
        F.min_by("start_ms", "chunk_no").alias("start_ms"), F.max_by("end_ms", "chunk_no").alias("end_ms"), joined("chunk_no", "text").alias("text"),
        met.alias("speakers"), F.count("*").alias("n_chunks"),
    )
    return made


def plan_parts(durations: DataFrame, part_ms: int = 5_400_000) -> DataFrame:
    """Equal parts of long recordings: as many as part_ms fits, rounded up."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration_ms") / part_ms)).cast("int")
    rows = durations.withColumn("n_parts", n).withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    edge = lambda k: F.floor(F.col("duration_ms") * k / F.col("n_parts"))
    return rows.select("video_id", "part", "n_parts", edge(F.col("part")).alias("start_ms"), edge(F.col("part") + 1).alias("end_ms"))


def merge_parts(results: DataFrame) -> DataFrame:
    """Results of parts on the recording's clock: times shifted by the part's start, SPEAKER_k renamed to
    SPEAKER_(10 * part + k), other names suffixed with the part."""
    k = F.regexp_extract("speaker", r"^SPEAKER_(\d+)$", 1)
    name = F.when(k != "", F.concat(F.lit("SPEAKER_"), F.lpad((F.col("part") * 10 + k.try_cast("int")).cast("string"), 2, "0"))).otherwise(F.concat("speaker", F.lit("_chunk"), F.col("part").cast("string")))
    return results.select("video_id", "part", (F.col("start_ms") + F.col("part_start")).alias("start_ms"), (F.col("end_ms") + F.col("part_start")).alias("end_ms"), name.alias("speaker"))


def batch_rows(rows: DataFrame, max_items: int = 12, max_chars: int = 4000) -> DataFrame:
    """Adds batch_no: rows of a recording in order, at most max_items and max_chars to a batch (a longer text alone
    exceeds it); empty texts count as items only."""

    def run(items: list[dict]) -> list[dict]:
        n, count, chars, out = 0, 0, 0, []
        for r in items:
            size = len(r["text"] or "")
            if count == max_items or (count and size and chars + size > max_chars):
                n, count, chars = n + 1, 0, 0
            count, chars = count + 1, chars + size
            out.append({"video_id": r["video_id"], "seg_no": r["seg_no"], "batch_no": n})
        return out

    return _fold(rows.select("video_id", "seg_no", "text"), ["seg_no"], run, "video_id long, seg_no long, batch_no long")


def _gather(parts: Column, joins) -> Column:
    """Joins neighbours of an array of texts with a space while joins(current, joined) holds."""
    start = F.struct(F.lit("").alias("cur"), F.expr("cast(array() as array<string>)").alias("done"))

    def step(a: Column, x: Column) -> Column:
        both = F.concat_ws(" ", a["cur"], x)
        return F.when(a["cur"] == "", F.struct(x.alias("cur"), a["done"].alias("done"))).when(joins(a["cur"], both), F.struct(both.alias("cur"), a["done"].alias("done"))).otherwise(F.struct(x.alias("cur"), F.concat(a["done"], F.array(a["cur"])).alias("done")))

    return F.aggregate(parts, start, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


def chunk_text(text: Column, size: int = 400) -> Column:
    """Chunks of at most `size` characters on sentence ends; longer sentences are cut hard."""
    # Hard-cut pieces carry a mark, which keeps them from being joined.
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(s) - 1) / size).cast("int")), lambda i: F.concat(F.lit("\u0001"), F.substring(s, i * size + 1, F.lit(size))))
    pieces = F.flatten(F.transform(split_sentences(text), lambda s: F.when(F.char_length(s) > size, cut(s)).otherwise(F.array(s))))
    made = _gather(pieces, lambda cur, both: (F.char_length(both) <= size) & ~F.contains(both, F.lit("\u0001")))
    return F.when(F.char_length(text) <= size, F.array(text)).otherwise(F.transform(made, lambda s: F.replace(s, F.lit("\u0001"), F.lit(""))))


def force_split(text: Column, size: int = 150) -> Column:
    """Pieces of whole words of at most `size` characters; a longer word stands alone."""
    return _gather(words(text), lambda cur, both: F.char_length(both) <= size)


def turn_chunks(text: Column, clean, short: int = 45, long: int = 220) -> Column:
    """Cleaned sentences, joined while the current chunk has under `short` and the joined one up to `long`."""
    parts = F.filter(F.transform(split_sentences(text), clean), lambda s: s != "")
    return _gather(parts, lambda cur, both: (F.char_length(cur) < short) & (F.char_length(both) <= long))
