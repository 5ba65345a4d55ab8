"""Near duplicates: MinHash bands give candidates, sequential Bayesian tests prune them, full sets decide.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased. A document's set holds its distinct shingles of
`shingle` words; with fewer words, the whole sequence as one; without words it is empty and links with nothing.
Two documents are linked when 100 * |intersection| >= percent * |union|.

1. Texts are read once into signatures. Documents of equal sets (a 128-bit key) are one class, so copies are
   one row from here on, whatever their number.
2. Classes that agree on a band are candidates. In each bucket every member is paired with one centre, the
   member that lies in the fullest buckets: rows stay linear in the bucket.
3. Pairs are tested on batches of the signature: a pair goes when the posterior probability (uniform prior)
   that its similarity reaches the limit falls under `miss`. Survivors are decided on full sets.
4. Links give components. Only buckets that still hold several components have pairs left: blocks of signatures of
   their members outside the centre's component meet blocks of all members, in numpy, under the same tests, each
   pair in the first band it shares; members with a survivor leave, no pairs. Blocks of these members, now with
   their full sets and of bounded bytes, meet once more and decide their survivors on the sets. One link at most
   leaves for a member, component and block. This holds for buckets of every size.

Misses are bounded: with the defaults a pair of similarity 0.8 shares no band with probability 5e-8, and is pruned
with probability `miss` at the most on each batch.

Defined results: null or empty texts have n_shingles 0 and are their own component; a row of null doc_id is
linked with nothing and kept; rows that repeat a doc_id are one node that has every row's set; ties go to the
smallest doc_id; other columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import words as W
from talkloom.llm.components import components
from talkloom.llm.shared import drop_stored, join_hot, map_batches, mark_possible, stored

U64 = W.U64
HASHES, ROWS, BANDS, BATCH = 256, 4, 32, 32
#: Members of a bucket to a block of signatures (2.2 MB), and bytes to a block with full sets; a longer set is a block.
BLOCK, BLOCK_BYTES = 4096, 4 << 20


def shingle_sets(piece: W.Slice, k: int):
    """The sorted distinct shingle hashes of each text of a slice."""
    t = W.words(piece, W.SPACED)
    h = W.FIRST.spans(t.data, t.starts, t.ends)
    g = W.grams(h, k, 5)
    for a, b in zip(t.of[:-1], t.of[1:], strict=True):
        yield np.unique(g[a : b - k + 1]) if b - a >= k else W.grams(h[a:b], int(b - a), 5) if b > a else h[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each of HASHES minima."""
    a, b = (W.stream(s, HASHES).astype(np.uint32)[:, None] for s in (21, 22))
    a = a | np.uint32(1)
    x = (shingles >> U64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (x[None, i : i + 1024] * a + b).min(axis=1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _summaries(docs: DataFrame, text: str, k: int) -> DataFrame:
    def rows(batch: pa.RecordBatch):
        n, keys, sigs = [], [], []
        for piece in W.slices(batch.column(1)):
            for s in shingle_sets(piece, k):
                n.append(len(s))
                keys.append(b"".join(int(W.mix(s ^ U64(c)).sum(dtype=U64)).to_bytes(8, "little") for c in (0x5BF03635, 0x1F83D9AB)) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
        return pa.table({"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "key": pa.array(keys, pa.binary()), "sig": pa.array(sigs, pa.binary())})

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")), rows, "doc_id long, n long, key binary, sig binary")


def _bands(nodes: DataFrame) -> DataFrame:
    def rows(batch: pa.RecordBatch):
        sig = _matrix(batch.column(1))
        bands = W.mix(np.ascontiguousarray(sig[:, : BANDS * ROWS]).view(U64) + W.stream(31, BANDS)[None, :])
        return pa.table({"band": bands.ravel().view(np.int64), "no": np.tile(np.arange(BANDS, dtype=np.int32), len(sig)), "node": np.repeat(batch.column(0).to_numpy(), BANDS)})

    return map_batches(nodes.select("node", "sig"), rows, "band long, no int, node long")


def _matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), dtype=np.uint16).reshape(-1, HASHES)


def least_matches(percent: int, miss: float) -> list[int]:
    """For 32, 64, ... compared hashes: the fewest matches at which the similarity may still reach the limit.

    With a uniform prior, P(similarity >= t | m of n) is P(Binomial(n + 1, t) <= m)."""
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss and m < n:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _prune(pairs: DataFrame, nodes: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) that pass every batch of the test."""
    limits = least_matches(percent, miss)
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")

    def rows(batch: pa.RecordBatch):
        a, b, left, matched = _matrix(batch.column(2)), _matrix(batch.column(3)), np.arange(batch.num_rows), 0
        for i, least in enumerate(limits):
            matched = matched + (a[left, i * BATCH : (i + 1) * BATCH] == b[left, i * BATCH : (i + 1) * BATCH]).sum(axis=1)
            left, matched = left[matched >= least], matched[matched >= least]
        return batch.select([0, 1]).take(pa.array(left))

    return map_batches(both.select("a", "b", "sa", "sb"), rows, "a long, b long").distinct()


def _sets(nodes: DataFrame, docs: DataFrame, text: str, k: int) -> DataFrame:
    """(node, shingles) of the documents whose id is a node: sorted hashes as longs. Only texts that may be of a node
    are moved."""
    wanted = stored(nodes.select("node"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = mark_possible(texts, F.xxhash64("doc_id"), wanted.select(F.xxhash64("node").alias("h"))).filter("possible").drop("possible")
    texts = texts.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")

    def rows(batch: pa.RecordBatch):
        sets = [s for piece in W.slices(batch.column(1)) for s in shingle_sets(piece, k)]
        flat = np.concatenate([*sets, np.zeros(0, dtype=U64)]).view(np.int64)
        ends = np.cumsum([0, *map(len, sets)])
        return pa.table({"node": batch.column(0), "shingles": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)})

    sets = stored(map_batches(texts.select("doc_id", "text"), rows, "node long, shingles array<long>").distinct(), "sets")
    drop_stored(wanted)
    return sets


def _exact(pairs: DataFrame, docs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough, as a stored table; the sets are deleted after use."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, text, k)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = stored(both.filter((100 + percent) * shared >= percent * (F.size("sa") + F.size("sb"))).select("a", "b").distinct(), "links")
    drop_stored(sets)
    return links


def _left_buckets(members: DataFrame, centres: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, no, node, component, out) of the buckets that still hold several components, without their centres; no is
    the number of the bucket's band, and `out` marks members outside the centre's component."""
    home = centres.join(comp.withColumnRenamed("node", "centre"), "centre", "left").select("band", "centre", F.coalesce("component", "centre").alias("home"))
    own = members.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = own.join(home, "band").filter("node <> centre").withColumn("out", F.col("component") != F.col("home"))
    # Of buckets in which all but the centre are of one component, no pair is left.
    seen = own.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count_if("out").alias("n_out"))
    left = own.join(seen.filter("lo <> hi and n_out > 0").select("band"), "band")
    return stored(left.select(F.xxhash64("no", "band").alias("key"), "no", "node", "component", "out"), "left-over")


def _lengths(sets: pa.ListArray) -> np.ndarray:
    return sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _shared(a: pa.ListArray, b: pa.ListArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[j]: exact counts, by products of 0/1 blocks of columns."""
    fa, fb = a.flatten().to_numpy(), b.flatten().to_numpy()
    both = np.intersect1d(fa, fb)
    total = np.zeros((len(a), len(b)))
    cells = []
    for sets, flat in ((a, fa), (b, fb)):
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), dtype=bool)
        cells.append((np.repeat(np.arange(len(sets)), _lengths(sets))[hit], at[hit]))
    for lo in range(0, len(both), 2048):
        dense = []
        for sets, (row, col) in zip((a, b), cells, strict=True):
            m = np.zeros((len(sets), 2048), dtype=np.float32)
            some = (col >= lo) & (col < lo + 2048)
            m[row[some], col[some] - lo] = 1
            dense.append(m)
        total += dense[0] @ dense[1].T
    return total[i, j].astype(np.int64)


def _survivors(left: pa.StructScalar, right: pa.StructScalar, no: int, limits: list[int]):
    """Pairs (i, j) of members of two blocks of a bucket that pass every test of their signatures, in the first band that
    they share; and the members' nodes and components. left holds members outside the home component."""
    (na, ca, _), (nb, cb, ob) = ([x.values.field(f).to_numpy(zero_copy_only=False) for f in ("node", "component", "out")] for x in (left, right))
    sa, sb = (_matrix(x.values.field("sig")) for x in (left, right))
    found = [np.zeros((2, 0), dtype=np.int64)]
    for lo in range(0, len(na), 64):
        i, j = np.nonzero((ca[lo : lo + 64, None] != cb[None, :]) & (~ob[None, :] | (na[lo : lo + 64, None] < nb[None, :])))
        i, matched = i + lo, np.zeros(len(i), dtype=np.int64)
        for x, least in enumerate(limits):
            cols = slice(x * BATCH, (x + 1) * BATCH)
            matched += (sa[i, cols] == sb[j, cols]).sum(axis=1)
            ok = matched >= least
            i, j, matched = i[ok], j[ok], matched[ok]
        same = (sa[i, : BANDS * ROWS] == sb[j, : BANDS * ROWS]).reshape(len(i), BANDS, ROWS).all(axis=2)
        here = same[:, no] & ~same[:, :no].any(axis=1)
        found.append(np.stack([i[here], j[here]]))
    i, j = np.concatenate(found, axis=1)
    return i, j, na, nb, cb


def _blocks(rows: DataFrame, carried: DataFrame, fields: list[str], most: int) -> DataFrame:
    """(key, no, outer, all): blocks of a bucket's members (key, no, node, component, out, size) outside the home
    component, each with blocks of all its members; a block's sizes add up to about `most`. `carried` has a row for each
    node with the other fields, which only the last joins move."""
    n_blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.coalesce(c, F.lit(0)) / most)).cast("int")
    totals = rows.groupBy("key").agg(F.count("*").alias("n"), n_blocks(F.sum("size")).alias("n_all"), n_blocks(F.sum(F.when(F.col("out"), F.col("size")))).alias("n_out"))
    placed = stored(join_hot(rows, totals, ["key"], "n", rows.count()).drop("size", "n"), "placed")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    row = F.collect_list(F.struct(*fields))
    full = placed.join(carried, "node")
    every = full.groupBy("key", "no", place("n_all").alias("p")).agg(row.alias("all"))
    # Each block of the outer ones goes to every block of all, so that a bucket's blocks are spread over tasks.
    outer = full.filter("out").groupBy("key", "n_all", place("n_out").alias("q")).agg(row.alias("outer"))
    sent = outer.select("key", "outer", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("p"))
    return every.join(sent, ["key", "p"]).select("key", "no", "outer", "all")


def _left_over(members: DataFrame, centres: DataFrame, comp: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, k: int, percent: int, miss: float) -> DataFrame:
    """Links of step 4: enough of them to join every component that any left pair joins."""
    limits = least_matches(percent, miss)
    own = _left_buckets(members, centres, comp)
    fields = ["node", "component", "out", "sig"]

    def meet(batch: pa.RecordBatch):
        keys, found = [], []
        for key, no, left, right in zip(*(c.to_pylist() for c in batch.columns[:2]), *batch.columns[2:], strict=True):
            i, j, na, nb, _ = _survivors(left, right, no, limits)
            some = np.unique(np.concatenate([na[i], nb[j]]))
            keys += [key] * len(some)
            found.append(some)
        return pa.table({"key": pa.array(keys, pa.int64()), "node": np.concatenate(found)})

    sigs = nodes.select("node", "sig")
    met = stored(map_batches(_blocks(own.withColumn("size", F.lit(1)), sigs, fields, BLOCK), meet, "key long, node long").distinct(), "left-members")
    sets = _sets(met.select("node").distinct(), docs, text, k)

    def decide(batch: pa.RecordBatch):
        found = [np.zeros((2, 0), dtype=np.int64)]
        for no, left, right in zip(batch.columns[1].to_pylist(), *batch.columns[2:], strict=True):
            i, j, na, nb, cb = _survivors(left, right, no, limits)
            if len(i):
                ha, hb = (x.values.field("shingles") for x in (left, right))
                shared = _shared(ha, hb, i, j)
                ok = (100 + percent) * shared >= percent * (_lengths(ha)[i] + _lengths(hb)[j])
                i, j = i[ok], j[ok]
                # One link for each member and component is enough.
                _, one = np.unique(np.stack([i, cb[j]], axis=1), axis=0, return_index=True)
                found.append(np.stack([na[i[one]], nb[j[one]]]))
        a, b = np.concatenate(found, axis=1)
        return pa.table({"a": a, "b": b})

    size = (F.size("shingles") * 8 + 600).alias("size")
    full = stored(own.join(met, ["key", "node"]).join(sets.select("node", size), "node"), "full-members")
    links = stored(map_batches(_blocks(full, sigs.join(sets, "node"), [*fields, "shingles"], BLOCK_BYTES), decide, "a long, b long").distinct(), "links")
    drop_stored(own, met, sets, full)
    return links


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_key (of its set), component_id, kept."""
    base = stored(_summaries(docs, text, shingle), "summaries")
    nodes = base.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")).filter("node is not null")
    nodes = stored(nodes, "classes")
    bands = _bands(nodes)
    members = stored(bands.join(bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "band"), "members")
    score = members.groupBy("node").agg(F.sum("size").alias("score"))
    centres = stored(members.join(score, "node").groupBy("band").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("centre")), "centres")
    stars = members.join(centres, "band").filter("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    pairs = stored(_prune(stars, nodes, percent, miss), "candidates")
    links = _exact(pairs, docs, text, shingle, percent)
    comp = components(links)
    more = _left_over(members, centres, comp, nodes, docs, text, shingle, percent, miss)
    drop_stored(members, centres, pairs, links)
    if not more.isEmpty():
        joined = more.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        joined = joined.join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        wider = components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        both = comp.withColumnRenamed("component", "via").join(wider.select(F.col("node").alias("via"), "component"), "via", "left")
        both = both.select("node", F.coalesce("component", "via").alias("component"))
        comp = stored(both.unionByName(wider.join(comp, "node", "left_anti")), "components")
    drop_stored(more)
    # A doc_id whose rows differ is one node of several classes.
    same = nodes.select("key", F.col("node").alias("rep"))
    of_row = base.join(same, "key", "left").select("doc_id", "n", "key", "rep")
    twice = of_row.filter("rep is not null and doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi")
    if not twice.isEmpty():
        again = of_row.join(twice.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        comp = components(again.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    out = of_row.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4).drop("class_key")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[p : p + 3], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r(node, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node WHERE r.c < e.b)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id, min(c) = doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.node = doc_id GROUP BY doc_id
"""
