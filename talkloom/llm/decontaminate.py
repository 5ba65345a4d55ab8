"""Benchmark decontamination by winnowing.

Words are the runs `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A window is `window`
consecutive words of an item; an item of fewer words, but at least one, is one window of its own length.
Of the k-grams in each window the smallest hash (the rightmost of equals) is the window's fingerprint, with
k = gram and window - gram + 1 k-grams to a window, so a span of `window` shared words always shares one, at one
place of the span.

1. Items and documents give one row for each fingerprint they select, with the window - gram words on either
   side of it. A short item is a fingerprint as a whole.
2. Fingerprints of documents and items are joined and each match is extended word by word to the left and to the
   right. It counts when window words or more are equal. Such a match agrees on half of the extension at one side
   at least: that is part of the join key, so a phrase that many texts share makes no row by itself.
3. Matches of neighbouring fingerprints run on into one another: those that touch or overlap are one span; the
   words in spans are hit.

A bit set of the items' fingerprints and keys, of a size between 2**22 and 2**27 bits, spares the documents' other
fingerprints the join. It only saves rows: when it is full, everything passes and the join decides. Items of equal
words are one class until the end, and equal surroundings of fingerprints one row.

Defined results: a null or empty text has no words, no hit and is not contaminated; null items and items
without words match nothing; a null doc_id or item_id is kept (a null item_id is counted but not listed);
repeated rows give one result row each, and rows of one item_id count once, whatever their words; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.llm import words as W
from talkloom.llm.shared import bit_table, bits_for, in_bits, map_batches, stored

U64 = W.U64
PRINT = "struct<at:int,n:int,fp:long,left:array<long>,right:array<long>,kl:long,kr:long>"
#: What stands for a word beyond the text's edge: never equal between items and documents.
ITEM_EDGE, DOC_EDGE = 1, 2
#: Fingerprints of items up to this number, about 250 bytes each, are broadcast; more are shuffled.
BROADCAST_ROWS = 100_000


def _longs(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).astype(U64, copy=False).view(np.int64)


def _weighed(values: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each row of values."""
    return (values * (W.stream(seed, values.shape[1]) | U64(1))[None, :]).sum(axis=1, dtype=U64)


def _window_prints(t: W.Words, h: np.ndarray, window: int, gram: int, edge: int, passes=None) -> dict:
    """The fingerprints of the windows of a word table, with their surroundings and join keys."""
    m, g = window - gram, W.grams(h, gram, 3)
    best = W.minima(g, m + 1)
    at = np.unique(best[W.whole(t.of, window, len(best))])
    if passes is not None:
        at = at[passes(g[at])]
    doc = np.searchsorted(t.of, at, side="right") - 1
    low, high, step = t.of[doc], t.of[doc + 1], np.arange(m)[None, :]
    before, after = at[:, None] - 1 - step, at[:, None] + gram + step
    left = np.where(before >= low[:, None], h[np.maximum(before, 0)], U64(edge))
    right = np.where(after < high[:, None], h[np.minimum(after, len(h) - 1)], U64(edge))
    half = (m + 1) // 2
    keys = [W.mix(g[at] + _weighed(side[:, :half], seed)) for side, seed in ((left, 91), (right, 92))]
    ok = [at - half >= low, at + gram + half <= high] if m else [np.ones(len(at), dtype=bool), np.zeros(len(at), dtype=bool)]
    if passes is not None:
        ok = [o & passes(k) for o, k in zip(ok, keys, strict=True)]
    return {"doc": doc, "at": at, "n": np.zeros(len(at), dtype=np.int64), "fp": g[at], "left": left, "right": right, "keys": keys, "ok": ok}


def _short_prints(t: W.Words, h: np.ndarray, n: int, m: int, passes=None) -> dict:
    """Each run of n words as a fingerprint, with a second hash of it as the only word to compare."""
    g = W.grams(h, n, 1)
    at = np.flatnonzero(W.whole(t.of, n, len(g)))
    keys = W.mix(g[at] ^ U64(n))
    if passes is not None:
        some = passes(keys)
        at, keys = at[some], keys[some]
    doc = np.searchsorted(t.of, at, side="right") - 1
    second = W.SECOND.spans(t.data, t.starts, t.ends) if len(at) else h
    left = np.zeros((len(at), m), dtype=U64)
    left[:, 0] = _weighed(second[at[:, None] + np.arange(n)[None, :]], 77 + n) if len(at) else 0
    none = np.zeros(len(at), dtype=bool)
    return {"doc": doc, "at": at, "n": np.full(len(at), n), "fp": g[at], "left": left, "right": np.zeros_like(left), "keys": [keys, keys], "ok": [~none, none]}


def _prints(t: W.Words, window: int, gram: int, short: list[int], edge: int, passes=None, keep=None) -> pa.ListArray:
    """A list of PRINT for each text of a slice. keep(rows): which rows of a lane to keep."""
    h, m = W.FIRST.spans(t.data, t.starts, t.ends), max(1, window - gram)
    lanes = [_short_prints(t, h, n, m, passes) for n in short]
    whole = _window_prints(t, h, window, gram, edge, passes)
    if window == gram:
        whole |= {k: np.zeros((len(whole["at"]), 1), dtype=U64) for k in ("left", "right")}
    rows = []
    for lane in [*lanes, whole]:
        some = np.flatnonzero((lane["ok"][0] | lane["ok"][1]) & (keep(lane) if keep else True))
        rows.append({k: [x[some] for x in v] if k in ("keys", "ok") else v[some] for k, v in lane.items()})
    col = lambda k: np.concatenate([r[k] for r in rows])
    doc = col("doc")
    order = np.argsort(doc, kind="stable")
    lists = [pa.ListArray.from_arrays(np.arange(0, m * len(doc) + 1, m, dtype=np.int32), _longs(col(k)[order]).ravel()) for k in ("left", "right")]
    keys = []
    for side in (0, 1):
        value, ok = (np.concatenate([r[k][side] for r in rows])[order] for k in ("keys", "ok"))
        keys.append(pa.array(_longs(value), pa.int64(), mask=~ok))
    place = (col("at") - t.of[doc])[order].astype(np.int32)
    made = [place, col("n")[order].astype(np.int32), _longs(col("fp")[order]), *lists, *keys]
    made = pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], names=["at", "n", "fp", "left", "right", "kl", "kr"])
    return pa.ListArray.from_arrays(np.searchsorted(doc[order], np.arange(len(t.of))).astype(np.int32), made)


def _item_rows(items: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    """(item_id, k1, k2, n_words, prints) of each item; k1 and k2 are equal for items of equal words."""

    def rows(batch: pa.RecordBatch):
        out = []
        for piece in W.slices(batch.column(1)):
            t = W.words(piece, W.ALNUM)
            sizes = np.diff(t.of)
            place = np.arange(len(t.starts)) - np.repeat(t.of[:-1], sizes)
            keys = []
            for hasher in (W.FIRST, W.SECOND):
                total = np.zeros(len(t.starts) + 1, dtype=U64)
                np.cumsum(W.mix(hasher.spans(t.data, t.starts, t.ends) + U64(7)) * (place.astype(U64) * U64(2) + U64(1)), out=total[1:])
                keys.append(_longs(W.mix(total[t.of[1:]] - total[t.of[:-1]] + sizes.astype(U64))))
            short = sorted({int(x) for x in sizes if 0 < x < window})
            own = lambda lane: (lane["n"] == 0) | (lane["n"] == sizes[lane["doc"]])  # noqa: B023, E731
            out.append(pa.table({"item_id": batch.column(0).slice(piece.lo, piece.hi - piece.lo), "k1": keys[0], "k2": keys[1], "n_words": sizes.astype(np.int64), "prints": _prints(t, window, gram, short, ITEM_EDGE, keep=own)}))
        return pa.concat_tables(out)

    names = items.select(F.col("item_id").cast("string"), F.col(text).cast("string").alias("text"))
    return map_batches(names, rows, f"item_id string, k1 long, k2 long, n_words long, prints array<{PRINT}>").filter("n_words > 0")


def _equal_words(side: str, m: int) -> F.Column:
    """How many words are equal, from the fingerprint on, between the document's side and the item's."""
    out = F.lit(m)
    for j in reversed(range(m)):
        out = F.when(F.get(side, F.lit(j)) != F.get(f"i_{side}", F.lit(j)), j).otherwise(out)
    return out


def _matches(hits: DataFrame, surroundings: DataFrame, window: int, gram: int) -> DataFrame:
    """uid, start, end, c1, c2: each fingerprint of a document extended along each item surrounding it meets."""
    keyed = hits.select("uid", "at", "n", "fp", "left", "right", F.explode(F.array("kl", "kr")).alias("k")).filter("k is not null")
    both = keyed.join(surroundings, ["k", "n", "fp"])
    m = window - gram
    left, right = (_equal_words(side, m).cast("int") for side in ("left", "right"))
    ranges = both.select("uid", "at", "n", "c1", "c2", left.alias("l"), right.alias("r"), (F.get("left", F.lit(0)) == F.get("i_left", F.lit(0))).alias("same"))
    short, wide = F.col("n") > 0, F.col("l") + F.col("r") >= m
    start = F.when(short, F.col("at")).otherwise(F.col("at") - F.col("l"))
    end = F.when(short, F.col("at") + F.col("n")).otherwise(F.col("at") + gram + F.col("r"))
    return ranges.filter((short & F.col("same")) | (~short & wide)).select("uid", start.alias("start"), end.alias("end"), "c1", "c2").distinct()


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", window: int = 10, gram: int = 5, key: F.Column | None = None
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (sorted strings), spans
    (array of word ranges [start, end)), contaminated; and key, a string column made of docs' own columns, where
    it is given."""
    spark = docs.sparkSession
    of_items = stored(_item_rows(items, item_text, window, gram), "items")
    prints = of_items.select("k1", "k2", F.explode("prints").alias("p")).select("k1", "k2", "p.*")
    around = ("n", "fp", "left", "right")
    named = prints.withColumn("c1", F.xxhash64(*around)).withColumn("c2", F.xxhash64(F.lit(1), *reversed(around)))
    own = stored(named.select("c1", "c2", "k1", "k2", *around, F.explode(F.array("kl", "kr")).alias("k")).filter("k is not null").distinct(), "item-prints")
    surroundings = own.select("k", "n", "fp", F.col("left").alias("i_left"), F.col("right").alias("i_right"), "c1", "c2").distinct()
    classes = own.select("c1", "c2", "k1", "k2").distinct()
    n_own = own.count()
    short = sorted(r[0] for r in own.filter("n > 0").select("n").distinct().collect())  # below window
    bits = bits_for(2 * n_own, 22, 27)
    held = spark.sparkContext.broadcast(bit_table(own.select(F.explode(F.array("fp", "k")).alias("k")).distinct(), bits))

    def read(batch: pa.RecordBatch):
        passes, counts, hits = lambda keys: in_bits(held.value, bits, keys), [], []
        for piece in W.slices(batch.column(2)):
            t = W.words(piece, W.ALNUM)
            counts.append(np.diff(t.of))
            hits.append(_prints(t, window, gram, short, DOC_EDGE, passes))
        return pa.table({"uid": batch.column(0), "doc_id": batch.column(1), "key": batch.column(3), "n_words": np.concatenate(counts), "hits": pa.chunked_array(hits)})

    name = (F.lit(None) if key is None else key).cast("string").alias("key")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), name)
    seen = stored(map_batches(rows, read, f"uid long, doc_id long, key string, n_words long, hits array<{PRINT}>"), "read")
    hits = seen.filter(F.size("hits") > 0).select("uid", F.explode("hits").alias("h")).select("uid", "h.*")
    matched = stored(_matches(hits, F.broadcast(surroundings) if n_own <= BROADCAST_ROWS else surroundings, window, gram), "matches")
    # Spans: matches of a document that touch or overlap run on into one another.
    order = Window.partitionBy("uid").orderBy("start", "end")
    runs = matched.select("uid", "start", "end").distinct()
    runs = runs.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum(F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("uid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.sum(F.col("end") - F.col("start")).cast("long")
    spans = spans.groupBy("uid").agg(length.alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    met = matched.select("uid", "c1", "c2").distinct().join(classes, ["c1", "c2"]).select("uid", "k1", "k2").distinct()
    met = met.join(of_items.select("k1", "k2", "item_id").distinct(), ["k1", "k2"]).select("uid", "item_id").distinct()
    met = met.groupBy("uid").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    out = seen.select("uid", "doc_id", "key", "n_words").join(spans, "uid", "left").join(met, "uid", "left")
    none, no_span = F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<struct<start:int,end:int>>)")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("spans", no_span).alias("spans"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        *(["key"] if key is not None else []),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS uid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s : s + least(len(ws), 10) - 1], ' ') AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS s FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT uid, n, s, array_to_string(ws[s : s + n - 1], ' ') AS win FROM (SELECT uid, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, lens WHERE len(ws) >= n)),
m AS (SELECT dw.uid, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(s, s + n)) AS p FROM m) GROUP BY uid),
i AS (SELECT uid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY uid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN h USING (uid) LEFT JOIN i USING (uid)
"""
