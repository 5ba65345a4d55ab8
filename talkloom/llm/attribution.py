"""Token counts of the sections of a document, from one encoding of the whole document.

The document is encoded once. Each token stands for a run of bytes, hence for a span of characters; a token that
holds a part of a character spans all of it. Token spans are joined with the section spans [start, end), in
characters: a token belongs to the section it shares the most characters with, the earlier one of equals. Tokens
that touch several sections are counted as `crossing` in the section they go to; tokens that touch none belong
to the row of section null. So the counts of a document's rows add up to its tokens.

Rows are encoded and joined where they lie: nothing is shuffled, and sections may overlap or leave gaps.

Defined results: a null or empty text has no tokens; null or empty section lists give the null section alone;
sections are clipped to the text, and null or empty ones get 0 tokens; repeated rows and null ids are kept as
they are; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import words as W
from talkloom.llm.shared import map_batches
from talkloom.llm.tokens import encoder

SECTION = "struct<name:string,start:int,end:int>"


def spans_of(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens of `sizes` bytes over the UTF-8 bytes of a text."""
    letter = np.cumsum((data & 0xC0) != 0x80)
    stop = np.cumsum(sizes)
    return letter[stop - sizes] - 1, letter[stop - 1]


def attribute(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none), and how many sections it touches."""
    best, owner, touched = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), -1), np.zeros(len(starts), dtype=np.int64)
    for i, (a, b) in enumerate(sections):
        lo, hi = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
        if a >= b or lo >= hi:
            continue
        shared = np.minimum(ends[lo:hi], b) - np.maximum(starts[lo:hi], a)
        more = shared > best[lo:hi]
        best[lo:hi][more], owner[lo:hi][more] = shared[more], i
        touched[lo:hi] += 1
    return owner, touched


def section_tokens(docs: DataFrame, tokenizer: str, sections: Column | None = None, text: str = "text") -> DataFrame:
    """One row per document and section, in the order of the list: doc_id, section (its place, null for none),
    name, start, end, n_tokens, crossing. `sections` is an array of (name, start, end). When
    it is not given, each line is a section, with its line feed, named by its number from 0."""
    own = sections.cast(f"array<{SECTION}>") if sections is not None else F.lit(None).cast(f"array<{SECTION}>")
    by_line = sections is None

    def rows(batch: pa.RecordBatch):
        enc = encoder(tokenizer)
        listed = None if by_line else batch.column(2).to_pylist()
        out = {"doc_id": [], "section": [], "name": [], "start": [], "end": [], "n_tokens": [], "crossing": []}
        ids_of = batch.column(0).to_pylist()
        for piece in W.slices(batch.column(1)):
            ids, of = enc.encode(piece)
            sizes = enc.bytes_of[ids]
            for i in range(piece.hi - piece.lo):
                data = piece.data[piece.offsets[i] : piece.offsets[i + 1]]
                starts, ends = spans_of(data, sizes[of[i] : of[i + 1]])
                n_chars = int(ends[-1]) if len(ends) else 0
                if by_line:
                    cut = np.append(0, np.cumsum((data & 0xC0) != 0x80)[data == 10])
                    cut = [*cut.tolist(), n_chars]
                    spans, names = list(zip(cut[:-1], cut[1:], strict=True)), [str(k) for k in range(len(cut) - 1)]
                else:
                    got = [s or {"name": None, "start": 0, "end": 0} for s in listed[piece.lo + i] or []]
                    spans, names = [(max(0, s["start"] or 0), min(n_chars, n_chars if s["end"] is None else s["end"])) for s in got], [s["name"] for s in got]
                owner, touched = attribute(starts, ends, spans)
                count = np.bincount(owner + 1, minlength=len(spans) + 1)
                crossing = np.bincount(owner[touched > 1] + 1, minlength=len(spans) + 1)
                n = len(spans)
                skip = 0 if count[0] or not n else 1
                out["doc_id"] += [ids_of[piece.lo + i]] * (n + 1 - skip)
                out["section"] += [None, *range(n)][skip:]
                out["name"] += [None, *names][skip:]
                out["start"] += [None, *(a for a, _ in spans)][skip:]
                out["end"] += [None, *(b for _, b in spans)][skip:]
                out["n_tokens"] += count[skip:].tolist()
                out["crossing"] += crossing[skip:].tolist()
        kinds = {"doc_id": pa.int64(), "name": pa.string(), "n_tokens": pa.int64(), "crossing": pa.int64()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int32())) for k, v in out.items()})

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), own.alias("sections")), rows, "doc_id long, section int, name string, start int, end int, n_tokens long, crossing long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every line of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return section_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("name")
