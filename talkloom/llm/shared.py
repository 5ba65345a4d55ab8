"""Folders that the whole cluster shares, tables written there to cut lineage, and joins that stand hot keys."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of the tables that stored() has written and nobody has deleted yet.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. It must be a folder that driver and executors share, so none
    is made up where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("set spark.checkpoint.dir, when the session is built, to a folder that the whole cluster shares")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/talkloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: later steps survive the loss of any executor."""
    path = new_path(df.sparkSession, name)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, through Spark's own access to it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables that stored() has written and that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            own = [p for p in _WRITTEN if p.rsplit("/", 1)[-1] == folder.rsplit("/", 1)[-1]]
            for path in own:
                delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, every table stored since its begin: those that an operator leaves because its result
    reads them. To be left only when the result has been written."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in _WRITTEN if p not in before]:
            delete(spark, path)


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, parts: int = 10_000) -> DataFrame:
    """rows joined (inner) with groups, which has one row per key and, in `count`, how many rows hold it.

    Keys of more than total / parts rows are at most `parts`: those are broadcast, so that their rows stay where
    they lie. No other key has more than that share of the rows, and those are joined by a shuffle."""
    limit = total // parts + 1
    hot = groups.filter(F.col(count) > limit)
    often = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.filter(F.col(count) <= limit), keys)
    return often.unionByName(rest)


def meet(asked: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Each row of asked beside each row of blocks, which has its number in `block`, from 0 to n_blocks - 1.

    Spark takes asked and its n_blocks copies for equally large, so it would send them through the driver to be broadcast
    where asked alone is small. They are dealt by a shuffle and merged instead: a task holds one block at a time."""
    sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    return sent.hint("merge").join(blocks, "block")


def bit_filter(keys: DataFrame, bits: int) -> DataFrame:
    """Rows (i, b): the words of a set of 2**bits bits with two places for each key (one column, long)."""
    k = F.col(keys.columns[0])
    low, high = k.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(k, 64 - bits)
    places = keys.select(F.explode(F.array(low, high)).alias("p"))
    return places.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))


def mark_possible(rows: DataFrame, hashed: F.Column, keys: DataFrame) -> DataFrame:
    """Adds `possible`: whether the row's hash may be one of keys (one column of hashes); false is sure. The keys' bit
    set has 64 bits a key, up to 2**24 bits, and is broadcast as 2**18 rows at most, whatever the number of keys."""
    bits = bits_for(4 * keys.count(), 16, 24)
    words = F.broadcast(bit_filter(keys, bits))
    place = F.col("_hash").bitwiseAND(F.lit((1 << bits) - 1))
    joined = rows.withColumn("_hash", hashed).join(words, F.shiftright(place, 6) == F.col("i"), "left")
    bit = F.expr("shiftrightunsigned(b, cast(_hash & 63 as int)) & 1")
    return joined.withColumn("possible", F.coalesce(bit == 1, F.lit(False))).drop("i", "b", "_hash")


def bit_table(keys: DataFrame, bits: int) -> np.ndarray:
    """The set of bit_filter() as an array of 2**bits bits, whatever the number of keys."""
    got = bit_filter(keys, bits).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    table[got["i"].to_numpy()] = got["b"].to_numpy()
    return table.view(np.uint64)


def bits_for(n: int, low: int, high: int) -> int:
    """Bits of a set for n keys: 16 a key, within the bounds."""
    return min(high, max(low, (16 * max(n, 1)).bit_length()))


def in_bits(table: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the set."""
    ok = np.ones(len(keys), dtype=bool)
    for p in (keys & np.uint64((1 << bits) - 1), keys >> np.uint64(64 - bits)):
        ok &= (table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Sets the session's limit on the bytes of an Arrow batch where nobody has set it, so that rows of long
    texts don't add up in a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, size)


def release_memory() -> None:
    """Gives freed memory back to the system: Python workers live on after a task and share the executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str | T.StructType) -> DataFrame:
    """fn over each Arrow batch; its columns are put in the order of the schema."""
    bound_batches(df.sparkSession)
    names = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield from out.select(names).to_batches() if isinstance(out, pa.Table) else [out.select(names)]
                del out
        release_memory()

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(rows: DataFrame, group: str, most_rows: int, most_bytes: int, groups: DataFrame | None = None) -> DataFrame:
    """A bounded part of rows (i, text, ...): of each group, the first ids in the order of their hashes, at most
    most_rows of them, and only while their texts add up to most_bytes at most. Texts of more than an eighth of that
    are passed over, but a group that has no other gives its shortest one.

    `group` is a column of rows or, where it is given, of groups (i, group). An id counts once in a group, with one
    of its texts, however many rows repeat it. Ids are cut by their hash before they are ranked, so that a ranking
    sees about four times most_rows of a group however large it is; only the texts of the chosen ids move."""
    rows = rows.withColumn("th", F.xxhash64("text"))
    keys = [group, "i", "th"] if groups is None else ["i", "th"]
    ids = rows.select(*keys, F.octet_length("text").cast("long").alias("size"))
    ids = ids if groups is None else ids.join(groups, "i")
    ids = ids.groupBy(group, "i").agg(F.min(F.struct("size", "th")).alias("s")).select(group, "i", "s.size", "s.th", F.xxhash64("i").alias("h"))
    short = ids.filter(F.col("size") <= most_bytes // 8)
    counts = short.groupBy(group).agg(F.count("*").alias("n"))  # a row for each group
    share = (4 * most_rows + 64) / F.col("n")
    first = short.join(F.broadcast(counts), group).filter((F.col("h").cast("double") + 2.0**63) / 2.0**64 <= share)
    order = Window.partitionBy(group).orderBy("h", "i")
    ranked = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_rows)
    ranked = ranked.withColumn("total", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    long = ids.filter(F.col("size") > most_bytes // 8).groupBy(group).agg(F.min(F.struct("size", "h", "i", "th")).alias("s"))
    long = long.join(F.broadcast(counts), group, "left_anti").select(group, "s.i", "s.th")
    chosen = ranked.filter(F.col("total") <= most_bytes).select(group, "i", "th").unionByName(long)
    # At most most_rows rows of two numbers and a name for each group.
    return rows.join(F.broadcast(chosen), keys).dropDuplicates([group, "i", "th"]).drop("th")
