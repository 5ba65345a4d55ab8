"""Token ids as files of grammar-compressed blocks (Re-Pair), and random access into them.

Documents are ranged by doc_id over shards and encoded in that order, `end_id` after each. A shard is written as
blocks of whole documents, of about BLOCK_IDS ids. Within a block the pairs of neighbouring symbols that occur
at least `MIN_COUNT` times are replaced by new symbols, the most frequent ones of a round together, round after
round until none is left; no pair crosses the end of a document.

File format: Parquet files, a row per block, so that any reader finds its columns: shard, block, n_ids,
doc_ids, `lengths` and `ends` (little-endian unsigned 32-bit: ids of each document, and the end of its symbols),
`rules` (32-bit pairs: rule i makes symbol base + i), `rule_lengths` (32-bit: ids a rule expands to), `symbols`
(unsigned, `width` bytes each: 2, or 4 where a block has more symbols than that), base. A document, or a part of it, is decoded from its own symbols: the running
sum of their expansion lengths leads to the symbols that hold the part.

Spark's writer commits the files, so a lost executor's blocks are written again by another task.

Defined results: null and empty texts are the end id alone; an empty table has no block; null doc_ids come
first; rows of one doc_id follow in the order of their texts; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.llm import words as W
from talkloom.llm.shared import bound_batches, map_batches, new_path, release_memory
from talkloom.llm.tokens import encoder as encoder_of

BLOCK_IDS, PAIRS, MIN_COUNT = 1 << 19, 2048, 8
SCHEMA = "shard int, block int, n_ids long, doc_ids array<long>, lengths binary, ends binary, base int, rules binary, rule_lengths binary, width int, symbols binary"


def _place(pair: np.ndarray) -> np.ndarray:
    return ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)


def compress(ids: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends of the documents' symbols, rules, ids each rule expands to). ends: of the documents' ids.

    Rounds go on until no pair is left that occurs MIN_COUNT times. A pair of old symbols never gains places, so after
    the first round only pairs that were frequent then, or hold a new symbol, are counted again (`live`)."""
    seq, last = ids.astype(np.int64), np.zeros(len(ids), dtype=bool)
    last[ends - 1] = True
    rules, sizes = [], []
    live = np.flatnonzero(~last[:-1]) if len(seq) > 1 else np.zeros(0, dtype=np.int64)
    while len(live):
        pair = seq[live] << 32 | seq[live + 1]
        # Pairs are counted in a hashed table first: only those of full places are sorted.
        place = _place(pair)
        full = (np.bincount(place, minlength=1 << 20) >= MIN_COUNT)[place]
        live, pair, place = live[full], pair[full], place[full]
        keys, count = np.unique(pair, return_counts=True)
        some = np.flatnonzero(count >= MIN_COUNT)
        # The most frequent ones of a round; the others wait for a later one.
        keys = keys[some[np.argsort(-count[some], kind="stable")[:PAIRS]]]
        if not len(keys):
            break
        # Of keys that share a place, the first one has it; the others wait too.
        owner = np.full(1 << 20, -1, dtype=np.int32)
        owner[_place(keys)[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        found = owner[place]
        match = np.flatnonzero(found >= 0)
        match = match[keys[found[match]] == pair[match]]
        at, found = live[match], found[match]
        # Of matches in a row, every other one: they share symbols.
        run = np.flatnonzero(np.diff(at, prepend=-9) != 1)
        odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 1
        good = np.bincount(found[~odd], minlength=len(keys)) >= 3
        # Pairs that overlap others in almost every place gain nothing and are given up.
        live = np.delete(live, match[~good[found]])
        name = np.full(len(keys), -1)
        name[good] = base + len(rules) + np.arange(good.sum())
        at, new = at[~odd & good[found]], name[found[~odd & good[found]]]
        for key in keys[good].tolist():
            a, b = key >> 32, key & 0xFFFFFFFF
            rules.append((a, b))
            sizes.append(sum(1 if x < base else sizes[x - base] for x in (a, b)))
        seq[at], last[at] = new, last[at + 1]
        stay = np.ones(len(seq), dtype=bool)
        stay[at + 1] = False
        alive = np.zeros(len(seq), dtype=bool)
        alive[live] = True
        alive[at] = True
        before = at[at > 0] - 1
        alive[before] = True
        alive[before[~stay[before]] - 1] = True
        seq, last, alive = seq[stay], last[stay], alive[stay]
        live = np.flatnonzero(alive[:-1] & ~last[:-1])
    return seq.astype(np.uint32), np.flatnonzero(last) + 1, np.array(rules, dtype=np.uint32).reshape(-1, 2), np.array(sizes, dtype=np.uint32)


def expand(symbols: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """The ids of symbols."""
    made: list[np.ndarray] = []
    for a, b in rules.tolist():
        made.append(np.concatenate([made[x - base] if x >= base else np.array([x], dtype=np.uint32) for x in (a, b)]))
    size = np.ones(base + len(made) if not len(symbols) else max(int(symbols.max()) + 1, base + len(made)), dtype=np.int64)
    size[base : base + len(made)] = [len(m) for m in made]
    at = np.zeros(len(size), dtype=np.int64)
    at[base : base + len(made)] = np.cumsum(size[base : base + len(made)]) - size[base : base + len(made)]
    flat, count = np.concatenate([*made, np.zeros(1, dtype=np.uint32)]), size[symbols]
    stop = np.cumsum(count)
    place = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - count, count)
    whole = np.repeat(symbols, count)
    return np.where(whole < base, whole, flat[np.repeat(at[symbols], count) + place if len(made) else np.zeros(len(whole), dtype=np.int64)]).astype(np.uint32)


def decode_range(block: dict, doc: int, lo: int, hi: int) -> np.ndarray:
    """Ids lo to hi of document number `doc` of a block (a row of the files), from the symbols that hold them."""
    ends, rules = np.frombuffer(block["ends"], "<u4"), np.frombuffer(block["rules"], "<u4").reshape(-1, 2)
    symbols = np.frombuffer(block["symbols"], f"<u{block['width']}")[ends[doc - 1] if doc else 0 : ends[doc]]
    of_rule, base = np.frombuffer(block["rule_lengths"], "<u4"), block["base"]
    size = np.ones(len(symbols), dtype=np.int64)
    size[symbols >= base] = of_rule[symbols[symbols >= base] - base]
    stop = np.cumsum(size)
    first, end = np.searchsorted(stop, lo, side="right"), np.searchsorted(stop, hi, side="left") + 1
    start, out, stack = stop[first] - size[first] if first < len(stop) else 0, [], symbols[first:end][::-1].tolist()
    while stack:
        x = stack.pop()
        if x < base:
            out.append(x)
        else:
            stack += rules[x - base].tolist()[::-1]
    return np.array(out, dtype=np.uint32)[lo - start : hi - start]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, text: str = "text", end_id: int = 0) -> None:
    """Encodes and writes the documents in ascending doc_id order."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, block = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        held, lengths, names, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, held, lengths, names, total
            ids, size = np.concatenate(held), np.concatenate(lengths)
            symbols, ends, rules, sizes = compress(ids, np.cumsum(size), encoder.size)
            width = 2 if encoder.size + len(rules) <= 65536 else 4
            row = {"shard": shard, "block": block, "n_ids": len(ids), "doc_ids": pa.concat_arrays(names).to_pylist(), "lengths": size.astype("<u4").tobytes(), "ends": ends.astype("<u4").tobytes(), "base": encoder.size, "rules": rules.astype("<u4").tobytes(), "rule_lengths": sizes.astype("<u4").tobytes(), "width": width, "symbols": symbols.astype(f"<u{width}").tobytes()}
            block, held, lengths, names, total = block + 1, [], [], [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for piece in W.slices(batch.column(1)):
                ids, of = encoder.encode(piece)
                with_end = np.insert(ids, of[1:], end_id)
                held.append(with_end)
                lengths.append(np.diff(of) + 1)
                names.append(batch.column(0).slice(piece.lo, piece.hi - piece.lo).cast(pa.int64()))
                total += len(with_end)
                if total >= BLOCK_IDS:
                    yield close()
        if total:
            yield close()
        release_memory()

    ranged.mapInArrow(blocks, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of the files."""
    return spark.read.schema(SCHEMA).parquet(path)


def token_index(blocks: DataFrame) -> DataFrame:
    """From the decoded files, one row per document: doc_id, start, n_tokens, ids_crc32."""

    def rows(batch: pa.RecordBatch):
        out = {"shard": [], "block": [], "doc_id": [], "offset": [], "n_tokens": [], "ids_crc32": []}
        for r in batch.to_pylist():
            ids = expand(np.frombuffer(r["symbols"], f"<u{r['width']}"), r["base"], np.frombuffer(r["rules"], "<u4").reshape(-1, 2))
            size, raw = np.frombuffer(r["lengths"], "<u4").astype(np.int64), ids.astype("<u4").tobytes()
            stop = np.cumsum(size)
            out["doc_id"] += r["doc_ids"]
            out["offset"] += (stop - size).tolist()
            out["n_tokens"] += size.tolist()
            out["ids_crc32"] += [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(stop - size, stop, strict=True)]
            out["shard"] += [r["shard"]] * len(size)
            out["block"] += [r["block"]] * len(size)
        return pa.table({k: pa.array(v, pa.int32() if k in ("shard", "block") else pa.int64()) for k, v in out.items()})

    docs = map_batches(blocks, rows, "shard int, block int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    # Ids before each block: a running sum over shards, and one within each shard.
    sizes = blocks.select("shard", "block", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", before(Window.orderBy("shard")).alias("b1"))
    starts = sizes.select("shard", "block", before(Window.partitionBy("shard").orderBy("block")).alias("b2")).join(shards, "shard")
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("b1") + F.col("b2") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_index(read_tokens(spark, path))
