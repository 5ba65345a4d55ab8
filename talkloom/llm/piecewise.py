"""Context-triggered piecewise hashes of texts, and how alike two of them are.

A rolling hash of the last eight bytes decides where a text's UTF-8 bytes are cut: at block size 2**k a chunk ends
where its k lowest bits are all set, so cuts depend on nearby bytes alone and fall into step again after an edit. A chunk
is written as 12 bits of its CRC, two letters. A fingerprint `k:first:second:third` holds the chunks at the block sizes
2**k, 2**(k+1) and 2**(k+2); k is the smallest, from 2, that gives at most 63 cuts, so fingerprints stay short without
leaving out any byte, and a text and half of it still share a block size.

Likeness is 1 - d / (m + n), where d is the edit distance (insertions and deletions) of the chunk sequences, m and n
long, at the smallest block size that both fingerprints have; 0 where they share none.

Defined results: a null text is an empty one, with the fingerprint `2:::`; two empty texts have likeness 1, an empty one
and another 0; equal texts have equal fingerprints and likeness 1. With neighbours, rows follow each other by id (null
first), rows of one id by their text's hash; the last is followed by the first, a single row by itself; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import words as W
from talkloom.llm.shared import bound_batches, map_batches, release_memory, stored

#: The smallest k, cuts at most at the first block size, and block sizes in a fingerprint.
LEAST, CUTS, SIZES = 2, 63, 3
#: Bytes that are hashed at a time.
PIECE = 1 << 20
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_BYTE = (W.stream(61, 256) >> np.uint64(32)).astype(np.uint32)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _rolling(data: np.ndarray) -> np.ndarray:
    """At each byte: the hash of it and the seven before it (fewer at the begin)."""
    h = _BYTE[data]
    for step in (1, 2, 4):
        out = h.copy()
        out[step:] ^= _turned(h[:-step], step) if len(h) > step else h[:0]
        h = out
    # Every bit of the sum reaches the lowest ones.
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def _cuts(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ends of chunks at block size 2**k, and the low bits that are set at each of them."""
    at, level = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    mask = np.uint32((1 << k) - 1)
    for lo in range(0, len(data), PIECE):
        before = min(lo, 7)
        h = _rolling(data[lo - before : lo + PIECE])[before:]
        some = np.flatnonzero((h & mask) == mask)
        free = (~h[some]).astype(np.int64)
        at.append(some + lo + 1)
        level.append(np.where(free == 0, 32, np.round(np.log2(np.maximum(free & -free, 1))).astype(np.int64)))
    return np.concatenate(at), np.concatenate(level)


def fingerprint(data: bytes) -> str:
    raw = np.frombuffer(data, dtype=np.uint8)
    # Most texts have their 63 cuts near this size; where a text has fewer there, smaller ones are looked at too.
    guess = max(LEAST, (len(raw) // CUTS).bit_length() - 4)
    at, level = _cuts(raw, guess)
    while len(at) <= CUTS and guess > LEAST:
        guess = max(LEAST, guess - 3)
        at, level = _cuts(raw, guess)
    many = np.bincount(level, minlength=34)[::-1].cumsum()[::-1]  # cuts at each block size
    k = guess + int(np.argmax(many[guess:] <= CUTS))
    view, sizes = memoryview(data), []
    for size in range(k, k + SIZES):
        ends = [0, *at[level >= size].tolist()]
        if ends[-1] < len(data):
            ends.append(len(data))
        codes = [zlib.crc32(view[a:b]) & 0xFFF for a, b in zip(ends[:-1], ends[1:], strict=True)]
        sizes.append("".join(_LETTERS[c >> 6] + _LETTERS[c & 63] for c in codes))
    return ":".join([str(k), *sizes])


def _common(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence; the places of a are bits of whole numbers."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    left = full
    for x in b:
        hit = left & where.get(x, 0)
        left = ((left + hit) | (left - hit)) & full
    return len(a) - left.bit_count()


def likeness(one: str, other: str) -> float:
    if one == other:
        return 1.0
    (k, *a), (m, *b) = one.split(":"), other.split(":")
    k, m = int(k), int(m)
    size = max(k, m)
    if size >= min(k, m) + SIZES:
        return 0.0
    x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (a[size - k], b[size - m]))
    return 2 * _common(x, y) / (len(x) + len(y)) if x and y else 0.0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint of each row's whole text."""

    def rows(batch: pa.RecordBatch):
        made = [fingerprint(x.as_buffer() if x.is_valid else b"") for x in batch.column(1).cast(pa.large_binary())]
        return pa.table({"doc_id": batch.column(0), "fingerprint": pa.array(made, pa.string())})

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), rows, "doc_id long, fingerprint string")


class Text(NamedTuple):
    doc_id: int | None
    text: str
    print: str

    @classmethod
    def of(cls, doc_id: int | None, text: str | None) -> Text:
        return cls(doc_id, text or "", fingerprint((text or "").encode()))


#: What a pair gives. Of a range's ends, the texts themselves: `first` of its first row, `last` of its last one.
_ROW = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ENDS = "place long, first struct<doc_id:long,text:string>, last struct<doc_id:long,text:string>"


def _edited(own: Text, following: Text) -> dict:
    """A row and its text with the last half replaced by as much of the next row's begin."""
    half = len(own.text) // 2
    edited = own.text[: len(own.text) - half] + following.text[:half]
    data = edited.encode()
    mark = fingerprint(data)
    return {
        "doc_id": own.doc_id, "n_chars": len(own.text), "edited": hashlib.sha256(data).hexdigest(), "fingerprint": own.print, "edited_fingerprint": mark,
        "near_edited": likeness(own.print, mark), "near_next": likeness(own.print, following.print),
    }


def edited_by_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row, its text edited by the next row's begin, and their fingerprints: doc_id, n_chars, edited (sha256 of
    the edited text), fingerprint, edited_fingerprint, near_edited and near_next (likeness to the edited text and to the
    next row).

    Texts move once, into sorted ranges in which each row meets the next one. Of a range only the two texts at its ends
    are kept, to meet those of the neighbouring ranges."""
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    by = ["doc_id", F.xxhash64("text")]
    ordered = named.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    bound_batches(docs.sparkSession)
    kinds = {"i": pa.int64(), "s": pa.string(), "d": pa.float64()}
    names = {"doc_id": "i", "n_chars": "i", "edited": "s", "fingerprint": "s", "edited_fingerprint": "s", "near_edited": "d", "near_next": "d"}
    end = pa.struct([("doc_id", pa.int64()), ("text", pa.string())])
    schema = pa.schema([(c, kinds[k]) for c, k in names.items()] + [("place", pa.int64()), ("first", end), ("last", end)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = None, 0
        for batch in batches:
            out = []
            for i, t, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                following = Text.of(i, t.as_py())
                if own is None:
                    out.append({"place": at, "first": {"doc_id": i, "text": following.text}})
                else:
                    out.append(_edited(own, following))
                own, place = following, at
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if own is not None:
            yield pa.RecordBatch.from_pylist([{"place": place, "last": {"doc_id": own.doc_id, "text": own.text}}], schema=schema)
        release_memory()

    made = stored(ordered.mapInArrow(run, f"{_ROW}, {_ENDS}"), "pieces")
    # Two rows for each range; their order, without the texts, is settled in one place.
    ends = made.filter("place is not null")
    ranges = ends.groupBy(F.shiftrightunsigned("place", 33).alias("part")).agg(F.max("first").alias("first"), F.max("last").alias("last"))
    parts = [r[0] for r in ranges.select("part").orderBy("part").collect()]
    if not parts:
        return made.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    nexts = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part long, following long")
    left = ranges.select("part", "last").join(nexts, "part")
    met = left.join(ranges.select(F.col("part").alias("following"), "first"), "following").select("last", "first")

    def close(batch: pa.RecordBatch):
        rows = [_edited(Text.of(**a), Text.of(**b)) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        return pa.Table.from_pylist(rows, schema=pa.schema([(c, kinds[k]) for c, k in names.items()]))

    closed = stored(map_batches(met, close, _ROW), "closed-ranges")
    return made.filter("place is null").select(*names).unionByName(closed)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = edited_by_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n_chars", F.col("edited").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
