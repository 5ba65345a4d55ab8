"""Mixing sources to target weights: a min-cost flow over membership patterns, then seeded documents.

A document may belong to several sources. Documents are aggregated by membership pattern; each pattern is a
node of the flow with one unit capacity per repetition, and repetition r costs r (convex: a first use is
always cheaper than a second one). Source quotas are the sinks. The flow gives the words that each pattern
sends; with R = the full repetitions below that amount, every document of the pattern is taken R times and a
seeded part of them once more. That part is a threshold on a seeded hash: a distributed prefix sum over hash
prefixes, refined twice, names the document at which the amount is reached, so no group is ever sorted whole.
The document closest in size to what is then missing is added.

Targets: sources sorted by name (code points, null last) weigh weights[i % len(weights)], share `share` of all
sizes, and stop at `most` times their size; what is cut off is shared again by weight until none is above.

Every pattern is routed by the flow, which the driver settles: names and sizes of the patterns are all that reaches it.
They must be `max_patterns` at most, else an error is raised; no pattern is mixed in another way.

Defined results: null texts have size 0 and are taken 0 words; an empty table gives no row; the null source is
a source like any other, the last one; a null or empty list of sources is taken 0 words; equal doc_ids (repeated
rows) are one document for the choice and each row gets its own words; a null doc_id orders as the text 'null';
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.llm.shared import join_hot, stored

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 3  # hex digits of the seeded hash to a refinement
#: Tables of a row per group are broadcast up to this number of groups (about 200 bytes each), else shuffled.
BROADCAST_GROUPS = 50_000


def water_fill(sizes: list[int], weights: list[int], total: float, most: float) -> list[float]:
    """Shares of total by weight, each stopped at most * size, the excess shared again by weight."""
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    left, weight, level = total, sum(weights), None
    for i in order:
        if most * sizes[i] / weights[i] <= left / weight:
            left, weight = left - most * sizes[i], weight - weights[i]
        else:
            level = left / weight
            break
    return [float(most * s) if level is None or most * s / w <= level else w * level for s, w in zip(sizes, weights, strict=True)]


def min_cost_flow(supply: list[int], members: list[tuple[int, ...]], quotas: list[int], repeats: int) -> list[list[int]]:
    """Words sent from each pattern to each of its sources: quotas are met as far as capacity allows, at the
    least total cost when the r-th use of a pattern costs r a word.

    Only the first arc of a path costs anything, so the least cost comes from sending all that first uses can, then
    all that second uses can add, and so on. Each of these is a largest flow, found by blocking flows over shortest
    paths: from a pattern to a source, and on from there over patterns that already send to it."""
    sent = [dict.fromkeys(own, 0) for own in members]
    left = list(quotas)
    for _ in range(repeats):
        spare = list(supply)
        while _blocking_flow(spare, left, members, sent):
            pass
    return [[flow[m] for m in own] for flow, own in zip(sent, members, strict=True)]


def _layers(spare: list[int], left: list[int], members: list[tuple[int, ...]], sent: list[dict]) -> tuple[list[int], list[int], list[list[int]], bool]:
    """Distances of patterns and sources from the patterns with words to spare, and who sends to each source."""
    senders: list[list[int]] = [[] for _ in left]
    for p, flow in enumerate(sent):
        for m, words in flow.items():
            if words:
                senders[m].append(p)
    of_pattern, of_source = [0 if s else -1 for s in spare], [-1] * len(left)
    now, reached, depth = [p for p, s in enumerate(spare) if s], False, 0
    while now and not reached:
        depth += 1
        met = []
        for p in now:
            for m in members[p]:
                if of_source[m] < 0:
                    of_source[m] = depth
                    met.append(m)
                    reached |= left[m] > 0
        depth += 1
        now = []
        for m in met if not reached else ():
            for p in senders[m]:
                if of_pattern[p] < 0:
                    of_pattern[p] = depth
                    now.append(p)
    return of_pattern, of_source, senders, reached


def _blocking_flow(spare: list[int], left: list[int], members: list[tuple[int, ...]], sent: list[dict]) -> bool:
    """Sends words along shortest paths until none is open; whether there was one."""
    of_pattern, of_source, senders, reached = _layers(spare, left, members, sent)
    if not reached:
        return False
    next_m, next_p = [0] * len(spare), [0] * len(left)
    for root in range(len(spare)):
        path = [root]
        while spare[root] and path:
            node = path[-1]
            if len(path) % 2:
                own = members[node]
                while next_m[node] < len(own) and of_source[own[next_m[node]]] != of_pattern[node] + 1:
                    next_m[node] += 1
                if next_m[node] < len(own):
                    path.append(own[next_m[node]])
                    continue
            elif left[node]:
                backs = list(zip(path[1::2], path[2::2], strict=False))
                amount = min([spare[root], left[node], *(sent[p][m] for m, p in backs)])
                for p, m in zip(path[::2], path[1::2], strict=True):
                    sent[p][m] += amount
                for m, p in backs:
                    sent[p][m] -= amount
                spare[root] -= amount
                left[node] -= amount
                path = [root]
                continue
            else:
                own = senders[node]
                while next_p[node] < len(own) and (of_pattern[own[next_p[node]]] != of_source[node] + 1 or not sent[own[next_p[node]]][node]):
                    next_p[node] += 1
                if next_p[node] < len(own):
                    path.append(own[next_p[node]])
                    continue
            # A dead end: the node before goes on with its next neighbour.
            path.pop()
            if path:
                (next_m if len(path) % 2 else next_p)[path[-1]] += 1
    return True


def _reached(docs: DataFrame, groups: list[str], upto: str) -> DataFrame:
    """Groups are not null. Marks `below`: the documents whose running size in the order (hash, doc_id) stays within `upto`.

    docs: groups, hash, doc_id, size, upto. Sums by hash prefix find the prefix in which the amount is reached;
    its documents are ordered after two refinements only."""
    rest, done = docs.withColumn("base", F.lit(0).cast("long")), []
    for level in (1, 2):
        prefix = F.substring("hash", 1, level * DIGITS)
        keyed = rest.withColumn("prefix", prefix)
        sums = keyed.groupBy(*groups, "prefix").agg(F.sum("size").alias("s"), F.first(upto).alias("u"), F.first("base").alias("b"))
        run = F.sum("s").over(Window.partitionBy(*groups).orderBy("prefix"))
        sums = sums.withColumn("run", F.col("b") + run).select(*groups, "prefix", (F.col("run") - F.col("s")).alias("start"), (F.col("run") <= F.col("u")).alias("in"), (F.col("run") - F.col("s") >= F.col("u")).alias("out"))
        keyed = keyed.join(sums, [*groups, "prefix"])
        done.append(keyed.filter(F.col("in") | F.col("out")).select(*docs.columns, F.col("in").alias("below")))
        rest = keyed.filter(~F.col("in") & ~F.col("out")).select(*docs.columns, F.col("start").alias("base"))
    run = F.sum("size").over(Window.partitionBy(*groups, F.substring("hash", 1, 2 * DIGITS)).orderBy("hash", "doc_id"))
    done.append(rest.withColumn("below", F.col("base") + run <= F.col(upto)).select(*docs.columns, "below"))
    return done[0].unionByName(done[1]).unionByName(done[2])


def mix(
    docs: DataFrame, size: Column, sources: Column, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17, max_patterns: int = 500_000
) -> DataFrame:
    """One row per document: doc_id, sources, size, taken, and its (first) source's source_size and target.
    `sources` is an array of names."""
    spark = docs.sparkSession
    # Null names are written as a flag, so that they sort last by code point.
    member = "struct<last:boolean,name:string>"
    named = F.transform(sources, lambda s: F.struct(s.isNull().alias("last"), F.coalesce(s, F.lit("")).alias("name")))
    named = F.coalesce(F.array_sort(F.array_distinct(named)), F.expr(f"cast(array() as array<{member}>)"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    base = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("size"), named.alias("members"), F.md5(key).alias("hash")), "sizes")
    patterns = stored(base.groupBy("members").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "patterns")
    by_source = patterns.select(F.explode("members").alias("m"), "size").groupBy("m").agg(F.sum("size").alias("size"))
    sizes = {tuple(r.m): r.size for r in by_source.collect()}
    names = sorted(sizes, key=lambda m: (m[0], m[1].encode("utf-8")))
    total, rows = patterns.agg(F.sum("size"), F.sum("n")).first()
    of_name = [weights[i % len(weights)] for i in range(len(names))]
    targets = water_fill([sizes[m] for m in names], of_name, share * (total or 0), most) if names else []
    quota = spark.createDataFrame([(m, sizes[m], t) for m, t in zip(names, targets, strict=True)], f"first {member}, source_size long, target double")
    with_quota = F.broadcast(quota) if len(names) <= BROADCAST_GROUPS else quota
    # max_patterns rows at most; the largest first, so that a rerun routes them in the same order.
    found = patterns.filter(F.size("members") > 0).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"there are more than {max_patterns} patterns of sources; raise max_patterns and the driver's memory, or join sources")
    found = sorted(((tuple(tuple(m) for m in r.members), r.size) for r in found), key=lambda p: (-p[1], p[0]))
    place = {m: i for i, m in enumerate(names)}
    sent = min_cost_flow([size for _, size in found], [tuple(place[m] for m in own) for own, _ in found], [round(t) for t in targets], most)
    plan = spark.createDataFrame([(own, sum(flow), size) for (own, size), flow in zip(found, sent, strict=True)], f"members array<{member}>, words long, total long")
    full = F.when(F.col("total") > 0, F.floor(F.col("words") / F.col("total"))).otherwise(0).cast("long")
    upto = F.col("words") - F.col("full") * F.col("total")
    of_pattern = patterns.select("members", "n").join(F.broadcast(plan) if len(found) <= BROADCAST_GROUPS else plan, "members").withColumn("full", full)
    of_pattern = of_pattern.select("members", "n", F.to_json("members").alias("g"), "full", upto.alias("upto"))
    taking = join_hot(base, of_pattern, ["members"], "n", rows or 0).select("doc_id", "g", "size", "hash", "full", "upto")
    # Rows of one doc_id share a hash and so stay together or not in the order; doc_id breaks no other tie.
    marked = stored(_reached(taking, ["g"], "upto"), "chosen")
    small = F.broadcast if len(found) <= BROADCAST_GROUPS else lambda df: df
    below = F.sum(F.when(F.col("below"), F.col("size")))
    got = marked.groupBy("g").agg(F.coalesce(below, F.lit(0)).alias("got"), F.first("upto").alias("u"))
    gap = marked.filter(~F.col("below") & (F.col("size") > 0)).join(small(got), "g")
    # One more document: the one that leaves the least gap, if it leaves a smaller one than there is.
    off = F.struct(F.abs(F.col("u") - F.col("got") - F.col("size")).alias("off"), "hash", "doc_id")
    more = gap.groupBy("g").agg(F.min(off).alias("m"), F.first(F.col("u") - F.col("got")).alias("missing")).filter("m.off < missing")
    out = marked.join(small(more.select("g", F.col("m.hash").alias("more_hash"), F.col("m.doc_id").alias("more_id"))), "g", "left")
    extra = F.col("below") | (F.col("hash").eqNullSafe(F.col("more_hash")) & F.col("doc_id").eqNullSafe(F.col("more_id")))
    taken = (F.col("size") * (F.col("full") + F.when(extra, 1).otherwise(0))).cast("long")
    out = out.select("doc_id", F.from_json("g", f"array<{member}>").alias("members"), "size", taken.alias("taken"))
    without = base.filter(F.size("members") == 0).select("doc_id", "members", "size", F.lit(0).cast("long").alias("taken"))
    out = out.unionByName(without).withColumn("first", F.get("members", F.lit(0))).join(with_quota, "first", "left")
    listed = F.transform("members", lambda m: F.when(~m["last"], m["name"]))
    return out.select("doc_id", listed.alias("sources"), "size", "taken", "source_size", "target")


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, words_in(), F.array(F.col("source").cast("string"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w
  FROM d GROUP BY source),
-- Targets: sources fill up in the order of size to weight, until a level is reached that holds for all others.
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source IS NULL, source) AS k FROM s),
l AS (
  SELECT *,
    1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rw
  FROM o),
v AS (SELECT min(k) FILTER (2.0 * source_size / w > CAST(rest AS DOUBLE) / rw) AS k0 FROM l),
t AS (
  SELECT l.source, l.source_size,
    CASE WHEN k0 IS NULL OR l.k < k0 THEN CAST(2 * l.source_size AS DOUBLE) ELSE l.w * (SELECT CAST(rest AS DOUBLE) / rw FROM l WHERE k = k0) END AS target
  FROM l, v),
q AS (
  SELECT *, CAST(round_even(target, 0) AS BIGINT) AS words,
    CASE WHEN source_size > 0 THEN CAST(round_even(target, 0) AS BIGINT) // source_size ELSE 0 END AS f
  FROM t),
-- Documents in seeded order, up to the words that full repetitions leave; then the one that fits the gap best.
r AS (
  SELECT d.*, source_size, target, f, words - f * source_size AS u, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id) AS run
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
g AS (SELECT *, run <= u AS below, u - coalesce(sum(size) FILTER (run <= u) OVER (PARTITION BY source), 0) AS missing FROM r),
m AS (SELECT *, row_number() OVER (PARTITION BY source, below OR size = 0 ORDER BY abs(missing - size), h, doc_id) AS rn FROM g)
SELECT doc_id, size, source_size, target,
  CAST(size * (f + CASE WHEN below OR (rn = 1 AND size > 0 AND abs(missing - size) < missing) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM m
"""
