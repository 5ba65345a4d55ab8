"""Repeated runs of lines, found by winnowing over line hashes and deleted after their first place.

A document is the sequence of its lines that hold more than ASCII white space; the other lines are kept and not
looked at. A run is `min_run` consecutive lines of the sequence or, with `min_words`, fewer whole lines that hold
that many words together (words are what ASCII white space parts). Every line of a run that has an earlier place,
in the order of documents (doc_id, text hash) and lines, is deleted.

1. Of the `gram`-line hashes in each run of min_run lines the smallest one (the rightmost of equals) is its
   fingerprint. Equal runs select the same one at the same place of the run. Runs next to one another mostly
   select one together, so a document has a fingerprint for about two lines of three: one for each place selected,
   with the runs that select it. A shorter run of many words is a fingerprint as a whole.
2. Fingerprints are joined over the corpus. Most occur once: their runs are found nowhere else and go no further.
3. Matches are extended, line by line to the left and to the right, to the runs that selected the fingerprint:
   each run is joined with the first place of the same fingerprint and the same lines around it.
4. Runs that have an earlier place run on into one another, and their lines are deleted.

Counts and first places are aggregated before they are shuffled. Runs that hold more than a ten-thousandth of the rows are
few and are broadcast back to them, so no task gets a third of all rows. Texts are joined by document with what to
delete; a bit set of the documents that lose lines, of at most 2**24 bits, lets most others pass by that join.

Defined results: null and empty texts have no run and come back as they are; documents of fewer than min_run
such lines lose nothing without min_words; rows of equal doc_id and text are one document and get the same result;
a null doc_id comes last in the order; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import words as W
from talkloom.llm.shared import drop_stored, join_hot, map_batches, mark_possible, stored

U64 = W.U64
_IN_LINE = np.arange(256) != 0x0A
SPANS = "array<struct<start:int,end:int>>"
#: A fingerprint, its runs' lines, and each run that selects it: a hash of it with the fingerprint's place, and its start.
PRINT = "struct<fp:long,n:int,runs:array<struct<k:long,start:int>>>"
_RUN = pa.struct([("k", pa.int64()), ("start", pa.int32())])


def _word_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of words in each line."""
    inside = W.SPACED[data]
    begins = np.concatenate([[0], np.cumsum(inside & ~np.concatenate([[False], inside[:-1]]))])
    return begins[ends] - begins[starts] + (inside[starts] & (starts > 0) & inside[np.maximum(starts, 1) - 1])


def _extended(lines: np.ndarray, prints: np.ndarray, start: np.ndarray, gram: int, n: int) -> np.ndarray:
    """A hash of the n lines from each start on, by the fingerprint's own lines, its place in the run, and the lines that
    extend it to the left and to the right."""
    total, by = W.grams(lines, gram, 44)[prints] + (prints - start).astype(U64), W.stream(52, n) | U64(1)
    total = W.mix(total)
    for j in range(n):
        at = start + j
        outside = (at < prints) | (at >= prints + gram)
        total = total + np.where(outside, lines[at] * by[j], U64(0))
    return W.mix(total)


def selected(h: np.ndarray, of: np.ndarray, min_run: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of min_run lines of a text: where it begins, and where the fingerprint is that it selects."""
    best = W.minima(W.grams(h, gram, 43), min_run - gram + 1)
    at = np.flatnonzero(W.whole(of, min_run, len(best)))
    return at, best[at]


def _fingerprints(t: W.Words, min_run: int, gram: int, min_words: int | None) -> pa.ListArray:
    """A list of PRINT for each text of a slice."""
    solid = np.concatenate([[0], np.cumsum(W.SPACED[t.data])])
    filled = solid[t.ends] > solid[t.starts]
    of = np.concatenate([[0], np.cumsum(filled)])[t.of]
    starts, ends = t.starts[filled], t.ends[filled]
    h, second = W.FIRST.spans(t.data, starts, ends), W.SECOND.spans(t.data, starts, ends)
    at, place = selected(h, of, min_run, gram)
    # Places rise from run to run: those of one fingerprint are neighbours.
    first = np.flatnonzero(np.diff(place, prepend=-1))
    lanes = [(W.grams(h, gram, 43)[place[first]], np.full(len(first), min_run), at[first], np.diff(np.append(first, len(at))), _extended(second, place, at, gram, min_run), at)]
    if min_words:
        total = np.concatenate([[0], np.cumsum(_word_counts(t.data, starts, ends))])
        for n in range(1, min_run):
            ok = W.whole(of, n, max(0, len(starts) - n + 1))
            own = np.flatnonzero(ok & (total[n:] - total[: len(ok)] >= min_words))
            lanes.append((W.mix(W.grams(h, n, 45)[own] + U64(n)), np.full(len(own), n), own, np.ones(len(own), dtype=np.int64), W.grams(second, n, 46)[own], own))
    fp, n, begin, count, k, run = (np.concatenate(x) for x in zip(*lanes, strict=True))
    doc = np.searchsorted(of, begin, side="right") - 1
    order, of_run = np.argsort(doc, kind="stable"), np.repeat(doc, count)
    by = np.argsort(of_run, kind="stable")
    runs = pa.StructArray.from_arrays([k[by].view(np.int64), (run - of[of_run])[by].astype(np.int32)], fields=list(_RUN))
    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count[order])]).astype(np.int32), runs)
    made = pa.StructArray.from_arrays([fp[order].view(np.int64), n[order].astype(np.int32), lists], names=["fp", "n", "runs"])
    return pa.ListArray.from_arrays(np.searchsorted(doc[order], np.arange(len(t.of))).astype(np.int32), made)


def _prints(docs: DataFrame, min_run: int, gram: int, min_words: int | None) -> DataFrame:
    def rows(batch: pa.RecordBatch):
        found = [_fingerprints(W.words(piece, _IN_LINE, lower=False), min_run, gram, min_words) for piece in W.slices(batch.column(2))]
        return pa.table({"doc_id": batch.column(0), "th": batch.column(1), "prints": pa.chunked_array(found)})

    return map_batches(docs.filter("text is not null").select("doc_id", "th", "text"), rows, f"doc_id long, th long, prints array<{PRINT}>")


def _cut(batch: pa.RecordBatch) -> pa.Table:
    texts, lines, removed, spans = batch.column(1).to_pylist(), [], [], []
    for i, starts in enumerate(batch.column(2).to_pylist()):
        if not starts:
            lines.append(texts[i].count("\n") + 1)
            removed.append(0)
            spans.append([])
            continue
        own = texts[i].split("\n")
        filled = [k for k, line in enumerate(own) if line.strip(" \t\n\v\f\r")]
        gone: set[int] = set()
        merged: list[list[int]] = []
        for run in starts:
            s, e = run["start"], run["start"] + run["n"]
            gone.update(filled[s:e])
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        texts[i] = "\n".join(line for k, line in enumerate(own) if k not in gone)
        lines.append(len(own))
        removed.append(len(gone))
        spans.append([{"start": a, "end": b} for a, b in merged])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    made = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
    return pa.table({"doc_id": batch.column(0), **made, "spans": pa.array(spans, kind)})


def dedup_lines(docs: DataFrame, text: str = "text", min_run: int = 3, gram: int = 2, min_words: int | None = 50) -> DataFrame:
    """One row per document: doc_id, text (without repeated runs), n_lines, n_removed, spans (the deleted runs,
    as ranges of places in the sequence of lines)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    prints = stored(_prints(docs, min_run, gram, min_words).filter(F.size("prints") > 0), "line-prints")
    often = stored(prints.select(F.explode("prints.fp").alias("fp")).groupBy("fp").agg(F.count("*").alias("places")).filter("places > 1").select("fp"), "repeated-prints")
    # The bit set only saves rows: what passes it without a second place meets none below.
    rows = mark_possible(prints.select("doc_id", "th", F.explode("prints").alias("p")), F.col("p.fp"), often).filter("possible")
    found = stored(rows.select("doc_id", "th", "p.fp", "p.n", F.explode("p.runs").alias("r")).select("doc_id", "th", "fp", "n", "r.k", "r.start"), "line-matches")
    drop_stored(prints, often)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "start")
    firsts = stored(found.groupBy("fp", "k").agg(F.min(order).alias("first"), F.count("*").alias("places")).filter("places > 1"), "first-places")
    late = join_hot(found, firsts, ["fp", "k"], "places", found.count()).filter(order > F.col("first"))
    late = late.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("starts"))
    late = stored(late.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "th", "starts"), "late-runs")
    drop_stored(found, firsts)
    # Documents whose hash has no place in the set lose nothing.
    marked = mark_possible(docs, F.col("th"), late.select("th").distinct())
    maybe = F.col("text").isNotNull() & F.col("possible")
    keys = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "th"]
    joined = marked.filter(maybe).select("doc_id", *keys, "text").join(late, ["id", "no_id", "th"], "left")
    lost = map_batches(joined.select("doc_id", "text", "starts"), _cut, f"doc_id long, text string, n_lines long, n_removed long, spans {SPANS}")
    feeds = F.char_length("text") - F.char_length(F.translate("text", "\n", ""))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(feeds + 1).cast("long").alias("n_lines")
    passed = marked.filter(~maybe).select("doc_id", "text", n_lines, F.lit(0).cast("long").alias("n_removed"), F.expr(f"cast(array() as {SPANS})").alias("spans"))
    return lost.unionByName(passed)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_lines", "n_removed", F.char_length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p, len(ls) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS s, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
-- Runs: one or two whole lines of 50 words together, and any three lines.
x AS (
  SELECT doc_id, s, line, words, lead(line, 1) OVER w AS line2, lead(words, 1) OVER w AS words2, lead(line, 2) OVER w AS line3
  FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
r AS (
  SELECT doc_id, s, 1 AS n, line AS run FROM x WHERE words >= 50
  UNION ALL SELECT doc_id, s, 2, line || chr(10) || line2 FROM x WHERE words + words2 >= 50
  UNION ALL SELECT doc_id, s, 3, line || chr(10) || line2 || chr(10) || line3 FROM x WHERE line3 IS NOT NULL),
k AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, s) AS place FROM r),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS s FROM k WHERE place > 1),
y AS (
  SELECT l.doc_id, l.line, l.p, g.s IS NOT NULL AS gone
  FROM l LEFT JOIN f USING (doc_id, p) LEFT JOIN g ON g.doc_id = f.doc_id AND g.s = f.s),
o AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '') AS kept
  FROM y GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN o USING (doc_id)
"""
