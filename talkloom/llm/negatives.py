"""Hard negatives of anchors, by bounds along spanning trees of the anchors.

Components are cut to whole numbers, floor(scale * x), and a score is the exact inner product of two such vectors. An
anchor's positives are its best rows of the same label; for each positive the best rows of other labels whose score
is low % to high % of the positive's are its negatives. Higher scores come first, ties by the smaller vec_id.

1. Anchors are dealt to groups of bounded size around a few seed anchors, and each group gets its minimum spanning
   tree by distance, rooted at its most central anchor. Rows are dealt to blocks of bounded size.
2. Each tree meets each block: the anchors are a stated set of queries against all rows. The root is scored in full.
   With p the parent of c, c.x = p.x + (c - p).x lies within |c - p| |x| of p.x, so the parent's bounds widened by
   edge length times norm bound the child's scores. Only rows whose bounds can reach the best ones are rescored: for
   positives, those not below the lower bounds of enough others; for negatives, those whose bounds overlap a
   window and are not below the lower bounds of enough rows that lie inside it for sure. Rescored rows have exact
   bounds for the next child.
3. The best of each block are merged: first all positives, then, with their windows, all negatives.

Bounds only spare work, so results are exact. Scores are sums of whole numbers below 2**53 in floating point; where
a block could exceed that, its scores are Python's whole numbers instead, cut to 64 bits.

Defined results: rows of null vec_id, null label, null vector, or with a null or non-finite component take no part,
nor do rows of another length than the most frequent one (ties: the smaller length); rows that repeat a vec_id are
one row, the least by label and vector; an anchor without rows of its label, or without rows inside a window, gives
no row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.llm.shared import drop_stored, map_batches, meet, stored

#: Anchors to a group, seeds to deal them by, rows and bytes to a block.
GROUP, SEEDS, BLOCK_ROWS, BLOCK_BYTES = 256, 64, 8192, 4 << 20
_ANCHOR = "struct<vec_id:long,label:long,v:array<double>,parent:int>"
_LIMIT = 1 << 53


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def whole_numbers(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles where that is exact and small, else as Python's whole numbers."""
    with np.errstate(over="ignore"):
        q = np.floor(v * scale)
    if not q.size or np.abs(q).max() < _LIMIT:
        return q
    exact = [int(x) * scale if abs(x) >= _LIMIT else int(np.floor(x * scale)) for x in v.ravel().tolist()]
    out = np.empty(len(exact), dtype=object)
    out[:] = exact
    return out.reshape(v.shape)


class Rows(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    norms: np.ndarray


def _rows(items: pa.StructArray, scale: int) -> Rows:
    """Rows in the order of their ids."""
    ids, labels = (items.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
    flat = items.field("v").flatten().to_numpy(zero_copy_only=False)
    by = np.argsort(ids)
    q = whole_numbers(flat.reshape(len(ids), len(flat) // max(1, len(ids)))[by], scale)
    return Rows(ids[by], labels[by], q, np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) if q.dtype != object else np.full(len(ids), np.inf))


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of points v: their order from the most central one, and each one's parent (its place in that order, -1 for the
    root)."""
    n = len(v)
    square = (v * v).sum(axis=1)
    far = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * (v @ v.T), 0))
    order, parent = [int(np.argmin(far.sum(axis=1)))], [-1]
    near, by, place = far[order[0]].copy(), np.zeros(n, dtype=np.int64), 0
    near[order[0]] = np.inf
    free = np.ones(n, dtype=bool)
    free[order[0]] = False
    while len(order) < n:
        nxt = int(np.flatnonzero(free)[np.argmin(near[free])])
        order.append(nxt)
        parent.append(int(by[nxt]))
        free[nxt] = False
        place += 1
        closer = free & (far[nxt] < near)
        near[closer], by[closer] = far[nxt][closer], place
    return np.array(order), np.array(parent)


class Bounds:
    """Lower and upper bounds of one anchor's scores with the rows of a block, made exact where rows are rescored."""

    def __init__(self, rows: Rows, own: np.ndarray, above: Bounds | None) -> None:
        self.rows, self.own = rows, own
        bound = max(1, abs(own).max(initial=0)) * max(1, abs(rows.q).max(initial=0)) * max(1, len(own))
        self.exact = rows.q.dtype != object and own.dtype != object and bound < _LIMIT
        if above is None or not (self.exact and above.exact):
            self.low, self.high = np.full(len(rows.ids), -np.inf), np.full(len(rows.ids), np.inf)
        else:
            # A little too far rather than too short: one more for the rounding of sums below 2**53.
            reach = np.sqrt(((own - above.own) ** 2).sum()) * (1 + 1e-9) * rows.norms + 1
            self.low, self.high = above.low - reach, above.high + reach
        self.rescored = 0
        if above is None and self.exact:
            self.scores(np.arange(len(rows.ids)))

    def scores(self, some: np.ndarray) -> np.ndarray:
        """Exact scores of some rows."""
        self.rescored += len(some)
        if self.exact:
            # A dense product is cheaper than picking most of the rows.
            got = self.rows.q[some] @ self.own if 2 * len(some) < len(self.rows.ids) else (self.rows.q @ self.own)[some]
            self.low[some] = self.high[some] = got
            return got.astype(np.int64)
        most = (1 << 63) - 1
        got = self.rows.q[some].astype(object) @ self.own.astype(object)
        return np.array([max(-most, min(most, int(x))) for x in got], dtype=np.int64)


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def positives(bounds: Bounds, anchor: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best other rows of the label."""
    same = np.flatnonzero((bounds.rows.labels == label) & (bounds.rows.ids != anchor))
    need = same[bounds.high[same] >= _kth(bounds.low[same], k)]
    got = bounds.scores(need)
    best = _best(bounds.rows.ids[need], got, k)
    return need[best], got[best]


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest score s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), high * score // 100


def negatives(bounds: Bounds, label: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, scores) of the k best rows of other labels inside each window."""
    other = bounds.rows.labels != label
    need = np.zeros(len(other), dtype=bool)
    for least, most in windows:
        inside = other & (bounds.low >= least) & (bounds.high <= most)
        need |= other & (bounds.high >= max(least, _kth(bounds.low[inside], k))) & (bounds.low <= most)
    need = np.flatnonzero(need)
    got, out = bounds.scores(need), []
    for least, most in windows:
        ok = np.flatnonzero((got >= least) & (got <= most))
        best = ok[_best(bounds.rows.ids[need[ok]], got[ok], k)]
        out.append((need[best], got[best]))
    return out


def _trees(anchors: DataFrame, n_anchors: int, width: int) -> DataFrame:
    """(tree, anchors): groups of anchors as spanning trees, parents before their children."""
    spark = anchors.sparkSession
    most = max(16, min(GROUP, (1 << 20) // (8 * max(1, width))))
    n_seeds = min(SEEDS, max(1, n_anchors // most))
    seeds = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_seeds).select("v").toArrow()["v"].to_pylist()
    at = spark.sparkContext.broadcast(np.array(seeds, dtype=np.float64).reshape(len(seeds), width))

    def near(batch: pa.RecordBatch):
        flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
        with np.errstate(over="ignore", invalid="ignore"):
            far = (at.value**2).sum(axis=1)[None, :] - 2 * (flat @ at.value.T)
        return pa.table({"vec_id": batch.column(0), "label": batch.column(1), "v": batch.column(2), "seed": np.argmin(np.nan_to_num(far, nan=np.inf), axis=1).astype(np.int32)})

    dealt = map_batches(anchors.select("vec_id", "label", "v"), near, "vec_id long, label long, v array<double>, seed int")
    dealt = stored(dealt, "dealt-anchors")
    parts = dealt.groupBy("seed").agg(F.ceil(F.count("*") / most).alias("parts"))  # at most SEEDS rows
    dealt = dealt.join(F.broadcast(parts), "seed").groupBy("seed", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"))

    def build(batch: pa.RecordBatch):
        made = []
        for group in batch.column(0):
            items = sorted(group.as_py(), key=lambda x: x["vec_id"])
            with np.errstate(over="ignore", invalid="ignore"):
                order, parent = spanning_tree(np.array([x["v"] for x in items], dtype=np.float64).reshape(len(items), width))
            made.append([items[i] | {"parent": int(p)} for i, p in zip(order, parent, strict=True)])
        return pa.table({"anchors": pa.array(made, pa.list_(pa.struct([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.float64())), ("parent", pa.int32())])))})

    trees = map_batches(dealt.agg(F.collect_list(F.struct("vec_id", "label", "v")).alias("group")).select("group"), build, f"anchors array<{_ANCHOR}>")
    # The number of a tree: its root, as a vec_id is of one tree.
    return trees.select(F.col("anchors")[0]["vec_id"].alias("tree"), "anchors")


def _each(tree: pa.StructArray, block: pa.StructArray, scale: int):
    """(place, vec_id, label, bounds) of each anchor of a tree over a block."""
    rows = _rows(block, scale)
    ids, labels, parents = (tree.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "parent"))
    flat = tree.field("v").flatten().to_numpy(zero_copy_only=False)
    own = whole_numbers(flat.reshape(len(ids), len(flat) // max(1, len(ids))), scale)
    made: list[Bounds] = []
    for i, p in enumerate(parents.tolist()):
        made.append(Bounds(rows, own[i], made[p] if p >= 0 else None))
        yield i, int(ids[i]), int(labels[i]), made[i]


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. `vectors` has vec_id and
    embedding; is_anchor and label are of its columns; low and high are percent of the positive's score."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    rows = rows.join(F.broadcast(lengths.select("d")), F.size("v") == F.col("d"), "left_semi")
    base = stored(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("vec_id", "r.*"), "rows")
    n, n_anchors, width = base.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("v"))).first()
    if not n_anchors:
        drop_stored(base)
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    n_blocks = max(1, -(-n // BLOCK_ROWS), -(-n * (8 * width + 32) // BLOCK_BYTES))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")
    blocks = stored(base.groupBy(place).agg(F.collect_list(F.struct("vec_id", "label", "v")).alias("rows")), "blocks")
    trees = stored(_trees(base.filter("anchor"), n_anchors, width), "trees")

    def find_positives(batch: pa.RecordBatch):
        out = [[], [], []]
        for tree, block in zip(batch.column(0), batch.column(1), strict=True):
            for _, anchor, own, bounds in _each(tree.values, block.values, scale):
                at, got = positives(bounds, anchor, own, n_positives)
                for column, values in zip(out, (np.full(len(at), anchor), bounds.rows.ids[at], got), strict=True):
                    column.append(values)
        return pa.table({c: np.concatenate([*x, np.zeros(0, dtype=np.int64)]).astype(np.int64) for c, x in zip(("anchor_id", "vec_id", "score"), out, strict=True)})

    hits = map_batches(meet(trees, blocks, n_blocks).select("anchors", "rows"), find_positives, "anchor_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    found = stored(hits.withColumn("n", best).filter(F.col("n") <= n_positives), "positives")
    windows = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("wanted"))
    of_tree = trees.select("tree", F.posexplode("anchors.vec_id").alias("place", "anchor_id")).join(windows, "anchor_id")
    asked = trees.join(of_tree.groupBy("tree").agg(F.collect_list(F.struct("place", "wanted")).alias("wanted")), "tree")

    def find_negatives(batch: pa.RecordBatch):
        out = [[], [], [], [], []]
        for tree, wanted, block in zip(*batch.columns, strict=True):
            of = {x["place"]: x["wanted"] for x in wanted.as_py()}
            for i, anchor, own, bounds in _each(tree.values, block.values, scale):
                asks = of.get(i, [])
                for ask, (at, got) in zip(asks, negatives(bounds, own, [window(x["score"], low, high) for x in asks], k), strict=True):
                    many = [np.full(len(at), x) for x in (anchor, ask["vec_id"], ask["score"])]
                    for column, values in zip(out, (*many, bounds.rows.ids[at], got), strict=True):
                        column.append(values)
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table({c: np.concatenate([*x, np.zeros(0, dtype=np.int64)]).astype(np.int64) for c, x in zip(names, out, strict=True)})

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    made = stored(map_batches(meet(asked, blocks, n_blocks).select("anchors", "wanted", "rows"), find_negatives, schema), "negatives")
    drop_stored(base, blocks, trees, found)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return made.withColumn("rank", rank).filter(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, label)


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n
  FROM s WHERE label = own),
n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE n <= 5 AND label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
