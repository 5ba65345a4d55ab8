"""Nearest neighbours by a permutation index.

A vector is represented by the order of its `prefix` nearest pivots, by cosine. Vectors are dealt to blocks of bounded
bytes. In a block, each vector is posted in the inverted files of its first `posted` pivots; a query reads the
files of its first `probed` pivots, ranks what it finds by the footrule distance of the orders (a pivot beyond a
prefix counts as the place after it) and reranks the `keep` share of it (at least `least`) by cosine in double
precision on the original vectors. Equal vectors are one entry with its smallest ids.

Pivots are distinct vectors of smallest hash, the bounded sample the index is fitted on: 64, then one for 80 vectors,
`most_pivots` at the most. Ordering the pivots costs a product with each of them for every vector, and reranking one
with a small part of the vectors for every query: less, from some thousand vectors on, than comparing every query with
every vector. While pivots grow with the vectors, a query finds a smaller part of them. Every vector is posted and
every probed file is read whole: nothing is dropped by size. Queries are sent, in groups, to every block; only the
nearest of each block come back.

Cosines are computed on vectors scaled by the power of two that brings their largest component to between a half and
one: that rounds nothing, and squares neither overflow nor vanish.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
do rows of null id or vectors of another length than the most frequent one (ties: the smaller length); rows
that repeat an id and vector count once, and an id with several vectors has the best of their scores; ties go to
the smaller id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.llm.shared import drop_stored, map_batches, meet, stored

#: Bytes of vectors and orders to a block, queries to a group, and bytes of pivots (single precision) to be broadcast.
BLOCK_BYTES, GROUP, PIVOT_BYTES = 4 << 20, 256, 16 << 20
LEAST_PIVOTS, VECTORS_A_PIVOT = 64, 80


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows, none of them zero, divided by a power of two each."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return _scaled(flat.reshape(len(column), -1)) if len(column) else flat.reshape(0, 1)


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each vector's `prefix` nearest pivots, nearest first (equals: the smaller number)."""
    out = np.empty((len(x), prefix), dtype=np.uint16)
    for lo in range(0, len(x), 1024):
        part = x[lo : lo + 1024]
        far = -((part / _norm(part)[:, None]).astype(np.float32) @ pivots.T)
        first = np.sort(np.argpartition(far, prefix - 1, axis=1)[:, :prefix], axis=1)
        rank = np.argsort(np.take_along_axis(far, first, axis=1), axis=1, kind="stable")
        out[lo : lo + 1024] = np.take_along_axis(first, rank, axis=1)
    return out


def _ordered(df: DataFrame, pivots, prefix: int) -> DataFrame:
    """Adds `order`, the bytes of orders()."""

    def rows(batch: pa.RecordBatch):
        made = orders(_rows(batch.column(1)), pivots.value, prefix)
        return pa.table({"ids": batch.column(0), "v": batch.column(1), "order": pa.array([r.tobytes() for r in made], pa.binary())})

    return map_batches(df.select("ids", "v"), rows, "ids array<long>, v array<double>, order binary")


class Block:
    """The inverted files of one block's entries."""

    def __init__(self, order: np.ndarray, posted: int, n_pivots: int) -> None:
        near = order[:, :posted].astype(np.int64)
        by_pivot = np.argsort(near.ravel(), kind="stable")
        self.order, self.entries = order, by_pivot // near.shape[1]
        self.files = np.searchsorted(near.ravel()[by_pivot], np.arange(n_pivots + 1))

    def found(self, probed: np.ndarray) -> np.ndarray:
        """The entries posted in any of the probed pivots' files."""
        return np.unique(np.concatenate([self.entries[self.files[p] : self.files[p + 1]] for p in probed.astype(np.int64)]))

    def footrule(self, asked: np.ndarray, some: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Distance of the asked order to those of some entries; place: scratch, `prefix` everywhere."""
        n = len(asked)
        place[asked] = np.arange(n, dtype=place.dtype)
        own = place[self.order[some]]
        # Pivots that both hold, or the entry alone; then those that the query alone holds.
        gap = np.abs(own - np.arange(n, dtype=place.dtype)).sum(axis=1, dtype=np.int32) + (n * (n + 1) // 2 - (n * n - own.sum(axis=1, dtype=np.int32)))
        place[asked] = n
        return gap


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, width)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, most_pivots: int = 1024, posted: int = 16, probed: int = 24, prefix: int = 64, keep: float = 0.15, least: int = 256
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query row, itself left out.

    `vectors` has vec_id and embedding; most_pivots is at most 65536, so that a pivot's number fits two bytes."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter(usable("v") & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    rows = rows.join(F.broadcast(lengths.select("d")), F.size("v") == F.col("d"), "left_semi").distinct()
    # k + 1 ids of each distinct vector are enough: a query leaves out one of them, its own.
    smallest = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    base = stored(smallest.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    n, width = base.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_pivots = min(n, max(16, min(max(LEAST_PIVOTS, n // VECTORS_A_PIVOT), most_pivots, PIVOT_BYTES // (4 * width))))
    sample = base.orderBy(F.xxhash64("v"), F.col("ids")[0]).limit(n_pivots).select("v").toArrow()
    p = _rows(sample["v"].combine_chunks())
    pivots = spark.sparkContext.broadcast((p / _norm(p)[:, None]).astype(np.float32))
    prefix, n_posted, n_probed = min(prefix, max(16, n_pivots // 2), n_pivots), min(posted, n_pivots), min(probed, n_pivots)
    n_blocks = max(1, -(-n * (8 * width + 2 * prefix + 64) // BLOCK_BYTES))
    entry = F.collect_list(F.struct("ids", "v", "order"))
    place = F.pmod(F.xxhash64("v"), F.lit(n_blocks)).alias("block")
    blocks = stored(_ordered(base, pivots, prefix).groupBy(place).agg(entry.alias("entries")), "blocks")
    asked = _ordered(rows.filter("q").select(F.array("vec_id").alias("ids"), "v"), pivots, prefix)
    groups = stored(asked.groupBy(F.pmod(F.xxhash64("ids"), F.lit(max(1, asked.count() // GROUP))).alias("group")).agg(entry.alias("asks")), "queries")

    def search(batch: pa.RecordBatch):
        out_q, out_ids, out_s = [], [], []
        for asks, entries in zip(batch.column(0), batch.column(1), strict=True):
            (qi, qv, qo), (xi, xv, xo) = ((y.values.field("ids"), _rows(y.values.field("v")), _matrix(y.values.field("order"), prefix)) for y in (asks, entries))
            block, qn, xn, ids = Block(xo, n_posted, n_pivots), _norm(qv), _norm(xv), xi.to_pylist()
            low, free = np.array([i[0] for i in ids]), np.full(n_pivots, prefix, dtype=np.int16)
            for a, query in enumerate(qi.to_pylist()):
                some = block.found(qo[a, :n_probed])
                if not len(some):
                    continue
                most = max(least, int(keep * len(some)))
                if most < len(some):
                    gap = block.footrule(qo[a], some, free)
                    some = some[gap <= np.partition(gap, most - 1)[most - 1]]
                score = (xv[some] * qv[a]).sum(axis=1) / (xn[some] * qn[a])
                best = np.lexsort((low[some], -score))[: k + 1]
                out_q += query * len(best)
                out_ids += [ids[i] for i in some[best]]
                out_s += score[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "ids": pa.array(out_ids, pa.list_(pa.int64())), "score": pa.array(out_s, pa.float64())})

    hits = stored(map_batches(meet(groups, blocks, n_blocks).select("asks", "entries"), search, "query_id long, ids array<long>, score double"), "hits")
    drop_stored(base, blocks, groups)
    hits = hits.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
