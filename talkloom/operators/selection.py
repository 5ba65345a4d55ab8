"""Filters, projections and small lookups over candidates, segments, detections and status rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.text import has_cyrillic
from talkloom.operators.intervals import assign_speaker_max, words_in_range

CAND = ["video_id", "cand_no"]


def select_ids(cands: DataFrame, ids: DataFrame, keys: list[str] = CAND) -> DataFrame:
    """The rows whose key is listed; repeated ids select a row once."""
    return cands.join(ids.select(*keys), keys, "left_semi")


def filter_tier(cands: DataFrame, tier: str) -> DataFrame:
    """Candidates of a tier; those without one count as extended. Order them by start_ms where they are shown."""
    return cands.filter(F.coalesce("tier", F.lit("extended")) == tier)


def auto_select(cands: DataFrame, ids: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """The candidates to render: the listed ones, or else all of at least that score."""
    return select_ids(cands, ids) if ids is not None else cands.filter(F.col("score") >= least)


def sentence_view(segs: DataFrame, diar: DataFrame, translated: str = "text_tr") -> DataFrame:
    """Sentences as an editor shows them: the translation if there is one, else the text, trimmed; the speaker of
    the interval that overlaps the most, if any does. Order them by start_ms where they are shown."""
    named = assign_speaker_max(segs, diar, ["seg_no"], "")
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    text, speaker = F.trim(F.coalesce(given(translated), given("text"))), F.coalesce(given("assigned"), "speaker")
    return named.select("video_id", "seg_no", "start_ms", "end_ms", text.alias("text"), speaker.alias("speaker"))


def translation_source(english: Column, text: Column) -> Column:
    """The text to translate: the English one, else the other one, the first that has no Cyrillic letter; null where
    neither is fit, and what there is stays."""
    fit = lambda c: c.isNotNull() & ~has_cyrillic(c)
    return F.when(fit(english), english).when(fit(text), text)


def filter_detections(boxes: DataFrame, width: int = 1920, height: int = 1080, least_w: int = 16, least_part: float = 0.0005, least_score: float = 0.5) -> DataFrame:
    """Boxes that are wide, large and sure enough."""
    return boxes.filter((F.col("w") >= least_w) & (F.col("area") >= least_part * width * height) & (F.col("score") >= least_score))


def clip_words(words: DataFrame, ranges: DataFrame) -> DataFrame:
    """The words of each edited range (video_id, cand_no, start_ms, end_ms): those that overlap it."""
    return words_in_range(words, ranges, "cand_no", ["word_no", "word"])


def strong_criteria(cands: DataFrame, names: list[str], above: float = 0.6) -> DataFrame:
    """Criteria above a limit, a row each: name, value."""
    return cands.unpivot(CAND, names, "name", "value").filter(F.col("value") > above)


def timing_sources(timing: DataFrame, source: str = "source") -> DataFrame:
    """How many turns have their timing from each source."""
    return timing.groupBy("video_id", source).agg(F.count("*").alias("n"))


def queue_stats(events: DataFrame) -> DataFrame:
    """Status rows of each worker's queue, counted."""
    return events.groupBy("worker", "status").agg(F.count("*").alias("n"))


def union_points(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct points of both tables. Sort them where they are shown."""
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


def attach_results(rows: DataFrame, results: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Puts results (one row per key) into columns {own column: result column}; rows without one keep what they had."""
    given = results.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns.values()])
    return rows.join(given, keys, "left").withColumns({own: F.coalesce(f"_{c}", own) for own, c in columns.items()}).select(*rows.columns)


def missing_ids(rows: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that have no result, to be asked for again."""
    return rows.select(*keys).join(results.select(*keys), keys, "left_anti")
