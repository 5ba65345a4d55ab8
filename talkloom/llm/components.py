"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.shared import drop_stored, stored


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours v."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node that can be reached.

    Alternates the large-star and small-star steps until the edges are stars; each step joins every node with
    the smallest of its neighbours, so no neighbour list is ever gathered. Each round is written to the shared
    folder. Loops, null ends and repeated edges are ignored.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and a <> b").distinct()
    now, before = stored(now, "edges"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mins = _least(large)
        small = large.join(mins, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()
        last, now = now, stored(small, "edges")
        drop_stored(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
