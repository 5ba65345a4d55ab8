"""Readers and writers of transcript files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.functions.text import fmt_ass, strip_tags, words
from talkloom.operators.alignment import input_of_chars
from talkloom.operators.turns import joined

TRANSCRIPT = "segments array<struct<start:double,end:double,text:string,speaker:string,words:array<struct<word:string,start:double,end:double,speaker:string>>>>, language string, diarization_enabled boolean"
ALIGNMENT = "alignment struct<characters:array<string>,character_start_times_seconds:array<double>,character_end_times_seconds:array<double>>, voice_segments array<struct<dialogue_input_index:int,start_time_seconds:double,end_time_seconds:double,character_start_index:int,character_end_index:int>>"
#: Fixed values.
VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "webm", "flv", "wmv", "m4v")


def _video_id() -> F.Column:
    """The recording of a file: named by a folder video_id=..., else by the file."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/video_id=([^/]+)/", 1)
    return F.coalesce(F.nullif(folder, F.lit("")), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))


def _ms(seconds: F.Column) -> F.Column:
    return F.bround(F.coalesce(seconds, F.lit(0.0)) * 1000, 0).cast("long")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Words of transcript JSON files, a row each; segments without words give one row of null word. Missing times
    are 0, a word's missing speaker is its segment's."""
    raw = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path).select(_video_id().alias("video_id"), F.posexplode_outer("segments").alias("seg_no", "s"))
    rows = raw.select("video_id", F.col("seg_no").cast("long").alias("seg_no"), "s", F.posexplode_outer("s.words").alias("word_no", "w"))
    return rows.select("video_id", "seg_no", F.col("word_no").cast("long").alias("word_no"), F.col("s.text").alias("seg_text"), F.col("w.word").alias("word"), _ms(F.col("w.start")).alias("start_ms"), _ms(F.col("w.end")).alias("end_ms"), F.coalesce("w.speaker", "s.speaker").alias("speaker"), _ms(F.col("s.start")).alias("seg_start_ms"), _ms(F.col("s.end")).alias("seg_end_ms"))


def parse_rttm(lines: DataFrame) -> DataFrame:
    """Speaker intervals of RTTM lines (video_id, value): eight tokens or more, the first SPEAKER; in order of
    start within a recording."""
    t = F.split(F.trim("value"), r"\s+")
    rows = lines.filter((F.size(t) >= 8) & (F.get(t, F.lit(0)) == "SPEAKER")).select("video_id", F.get(t, F.lit(3)).try_cast("double").alias("s"), F.get(t, F.lit(4)).try_cast("double").alias("d"), F.get(t, F.lit(7)).alias("speaker"))
    order = Window.partitionBy("video_id").orderBy("s", "d", "speaker")
    return rows.filter("s is not null and d is not null").select("video_id", (F.row_number().over(order) - 1).cast("long").alias("iv_no"), _ms(F.col("s")).alias("start_ms"), _ms(F.col("s") + F.col("d")).alias("end_ms"), "speaker")


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    return parse_rttm(spark.read.text(path).select("value", _video_id().alias("video_id")))


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """Character alignments, a row per file."""
    return spark.read.schema(ALIGNMENT).option("multiLine", True).json(path).select(_video_id().alias("video_id"), "alignment", "voice_segments")


def alignment_chars(files: DataFrame) -> DataFrame:
    """Characters of read_alignment(), a row each (i, ch, start_ms, end_ms), with input_no, the first voice segment that
    holds them: the input of chars_to_words()."""
    a = F.col("alignment")
    chars = F.arrays_zip(a["characters"], a["character_start_times_seconds"], a["character_end_times_seconds"])
    at_ms = lambda edge: _ms(F.col(f"c.character_{edge}_times_seconds"))
    rows = files.select("video_id", F.posexplode(chars).alias("i", "c"))
    rows = rows.select("video_id", F.col("i").cast("long").alias("i"), F.col("c.characters").alias("ch"), at_ms("start").alias("start_ms"), at_ms("end").alias("end_ms"))
    s = files.select("video_id", F.explode("voice_segments").alias("s"))
    at = lambda name: F.col(f"s.{name}").cast("long")
    ranges = s.select("video_id", at("dialogue_input_index").alias("input_no"), at("character_start_index").alias("first"), at("character_end_index").alias("stop"))
    return input_of_chars(rows, ranges)


def save_analysis(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Results by recording, in folders by a hash of video_id, so that loading some ids reads few of them."""
    df.withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def load_analysis(spark: SparkSession, path: str, ids: DataFrame | list[int], buckets: int = 64) -> DataFrame:
    """Results of the recordings listed in ids (a table with video_id, or a list). The numbers of their folders, at most
    `buckets` of them, are settled first, so that no other folder is read, however the ids came about."""
    ids = ids if isinstance(ids, DataFrame) else spark.createDataFrame([(i,) for i in ids], "video_id long")
    wanted = ids.select("video_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int"))
    folders = [r[0] for r in wanted.select("bucket").distinct().collect()]
    return spark.read.parquet(path).filter(F.col("bucket").isin(folders)).join(wanted, ["bucket", "video_id"], "left_semi").drop("bucket")


def export_transcripts(cands: DataFrame, turns: DataFrame, words_: DataFrame, language: str = "ru") -> DataFrame:
    """One row per candidate with any word, to be written as JSON: segment_id, text (of text_tr) and text_en (of text;
    the candidate's own where no turn has any), without tags; words in order; duration_ms from the first word's
    start to the last one's end and original_duration_ms; the times of the candidate, and word counts. Turns marked
    merged are left out, with their words.

    cands: video_id, cand_no, start_ms, end_ms, text; turns: turn_no, text, text_tr, merged; words_: cand_no, turn_no,
    pos, word, start_ms, end_ms."""
    keys = ["video_id", "cand_no"]
    live = turns.filter(~F.coalesce("merged", F.lit(False)))
    clean = lambda c: strip_tags(F.coalesce(F.col(c), F.lit("")))
    texts = live.withColumn("tr", clean("text_tr")).withColumn("en", clean("text")).groupBy(*keys).agg(joined("turn_no", "tr").alias("tr"), joined("turn_no", "en").alias("en"))
    spoken = words_.join(live.select(*keys, "turn_no"), [*keys, "turn_no"])
    rows = F.array_sort(F.collect_list(F.struct("turn_no", "pos", "word", "start_ms", "end_ms")))
    listed = spoken.groupBy(*keys).agg(rows.alias("w"))
    own = F.transform("w", lambda x: F.struct(x["word"].alias("word"), x["start_ms"].alias("start"), x["end_ms"].alias("end")))
    out = cands.select(*keys, "start_ms", "end_ms", F.col("text").alias("own")).join(listed, keys).join(texts, keys, "left")
    out = out.withColumn("text_en", F.coalesce(F.nullif("en", F.lit("")), "own", F.lit(""))).withColumn("words", own)
    return out.select(
        "video_id", F.col("cand_no").alias("segment_id"), F.coalesce("tr", F.lit("")).alias("text"), "text_en", "words",
        (F.element_at("words", -1)["end"] - F.element_at("words", 1)["start"]).alias("duration_ms"), (F.col("end_ms") - F.col("start_ms")).alias("original_duration_ms"),
        F.lit(language).alias("language"), "start_ms", "end_ms", F.size(words(F.col("tr"))).alias("n_words_tr"), F.size(words(F.col("text_en"))).alias("n_words_en"),
    )


def subtitle_lines(subs: DataFrame, color: F.Column | None = None) -> DataFrame:
    """Event lines of subtitle files, with a colour tag where a colour (BGR hex digits) is given; write them with
    .partitionBy("video_id").text."""
    tag = F.lit("") if color is None else F.coalesce(F.concat(F.lit("{\\1c&H"), color, F.lit("&}")), F.lit(""))
    line = F.format_string("Dialogue: 0,%s,%s,Default,,105,105,0,,%s%s", fmt_ass(F.col("start_ms")), fmt_ass(F.col("end_ms")), tag, F.coalesce("text", F.lit("")))
    return subs.select("video_id", "seg_no", line.alias("line"))


def media_catalog(spark: SparkSession, path: str, extensions: tuple[str, ...] = VIDEO_EXTENSIONS) -> DataFrame:
    """Files of these extensions under a folder with size in MB and time of change; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(ext.isin(*extensions) & ~F.contains(F.col("path"), F.lit(".tmp."))).select("path", F.bround(F.col("length") / 1048576, 2).alias("size_mb"), "modificationTime")
