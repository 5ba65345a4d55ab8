"""Registered queries of the transcript operators."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_intervals", "q_turns", "q_text", "q_ranking", "q_chunking", "q_timing", "q_repair", "q_signals", "q_focus", "q_subtitles", "q_relabel", "q_io", "q_streams")


def _found(what: str) -> dict:
    out = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"talkloom.plans.{name}"), what)
    return out


def queries() -> dict:
    return _found("QUERIES")


def oracle_sql() -> dict:
    return _found("ORACLES")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Talk time and share of each speaker of each recording, speakers assigned by largest summed overlap."""
    from talkloom.operators import turns
    from talkloom.operators.intervals import assign_speaker_dominant
    from talkloom.plans.fixtures import view

    segs = assign_speaker_dominant(view(spark, sf_dir, "fx_segs"), view(spark, sf_dir, "fx_diar"), ["seg_no"])
    return turns.speaker_stats(segs.withColumn("speaker", segs["assigned"]))
