"""A Merkle manifest of a table: leaves, subroots, root, proofs, and roots folded from changed leaves.

H is the lowercase hex sha256 of its inputs, concatenated. A row's leaf is H of its columns, each `-` if null, else its
UTF-8 byte count, `:` and the value. In a group (a tree) leaves ascend by the key; while several nodes remain, every
16 consecutive ones become their H. What remains is the group's subroot; subroots, in the bytewise order of the
groups, null first, are the leaves of one more tree, whose top is the root.

1. Leaves are hashed where the texts lie; only digests move from there on. Sorted ranges of them and the counts of
   each range give every leaf its place, so no group is one task.
2. A superblock is 256 consecutive nodes of a tree, two levels. Superblocks are reduced to their tops, these make
   superblocks again, and so on until each tree has one node: a round for each factor of 256.
3. From the top down, the nodes of each superblock are cogrouped with one row of the nodes that its proofs need from
   outside. There the local reduction is finished, local and outer siblings are joined to proofs, and, for leaves,
   the root is folded from them.

Defined results: groups and keys may be null (null keys come first); rows of equal key in a group ascend by their
leaf, and equal rows are leaves of their own; null and empty texts differ; a changed leaf that is null stands for the
leaf itself; an empty table gives no row; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.llm.shared import drop_stored, stored

#: Nodes of a run, levels of a superblock, and nodes of a superblock.
RUN, LEVELS = 16, 2
SPAN = RUN**LEVELS
_PATH = "tree string, pos long, before array<string>, after array<string>, subroot string, root string"


def leaf(columns: Sequence[Column]) -> Column:
    """H of a row's columns, as bytes."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds `pos`, the place of each row in its tree (from 0), and `n`, the rows of the tree; a stored table."""
    by = ["tree", *order]
    table = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    part = F.shiftrightunsigned("at", 33)
    ranges = table.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("k"))
    # A tree has at most one row for each range.
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("k").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("k").over(whole).alias("n"))
    placed = table.withColumn("part", part).join(ranges, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")
    out = stored(placed, name)
    drop_stored(table)
    return out


def _block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {SPAN}"))


def _reduced(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, d): the tops of the superblocks. One shuffle: both levels are built where a superblock lies."""
    now = _block(nodes).select("tree", "block", "pos", "n", "d").repartition("tree", "block")
    for _ in range(LEVELS):
        run = F.array_sort(F.collect_list(F.struct("pos", "d")))
        now = now.groupBy("tree", "block", F.expr(f"pos div {RUN}").alias("pos"), "n").agg(run.alias("run"))
        digest = F.unhex(F.sha2(F.array_join(F.transform("run", lambda x: F.lower(F.hex(x["d"]))), ""), 256))
        now = now.select("tree", "block", "pos", F.ceil(F.col("n") / RUN).alias("n"), F.when(F.col("n") > 1, digest).otherwise(F.col("run")[0]["d"]).alias("d"))
    return now.select("tree", "pos", "n", "d")


def _rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The nodes, the tops of their superblocks, and so on until each tree has one node left."""
    out = [nodes]
    while len(out) == 1 or (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(stored(_reduced(out[-1]), f"{name}-{len(out)}"))
    return out


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def local_levels(digests: list[str], n: int) -> list[list[tuple[str, str]]]:
    """For each level of a superblock: the siblings before and after each node of it. n: the nodes of the tree."""
    out = []
    for _ in range(LEVELS):
        if n <= 1:
            break
        runs = [digests[i : i + RUN] for i in range(0, len(digests), RUN)]
        out.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))])
        digests, n = [digest("".join(run)) for run in runs], -(-n // RUN)
    return out


def fold(own: str, before: Sequence[str], after: Sequence[str]) -> str:
    for a, b in zip(before, after, strict=True):
        own = digest(a + own + b)
    return own


def _paths(nodes: pd.DataFrame, outer: pd.DataFrame) -> tuple[pd.DataFrame, list[list[str]], list[list[str]]]:
    """The nodes of a superblock in their order, and the siblings before and after on each level up to the root."""
    nodes = nodes.sort_values("pos", ignore_index=True)
    levels = local_levels([bytes(d).hex() for d in nodes["d"]], int(nodes["n"].iloc[0]))
    up = [list(outer[side].iloc[0]) for side in ("before", "after")]
    paths = [[[level[i // RUN**k][side] for k, level in enumerate(levels)] + up[side] for i in range(len(nodes))] for side in (0, 1)]
    return nodes, *paths


def _inner(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Paths of nodes: what superblocks of the next round below need from outside."""
    if nodes.empty or outer.empty:
        return pd.DataFrame(columns=["tree", "pos", "before", "after", "subroot", "root"])
    nodes, before, after = _paths(nodes, outer)
    subroot = outer["subroot"].iloc[0]
    return pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "before": before, "after": after, "subroot": subroot, "root": outer["root"].iloc[0]})


def _outer(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Paths of subroots: each is the one node above its own group's tree."""
    made = _inner(nodes, outer)
    if len(made):
        own = nodes.sort_values("pos", ignore_index=True)
        made = made.assign(tree=own["group"], pos=0, subroot=[bytes(d).hex() for d in own["d"]])
    return made


def _leaves(proofs: bool):
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", *(["before", "after"] if proofs else [])]
        if nodes.empty or outer.empty:
            return pd.DataFrame(columns=names)
        nodes, before, after = _paths(nodes, outer)
        own = [bytes(d).hex() for d in nodes["d"]]
        tried = [x if c is None else bytes(c).hex() for x, c in zip(own, nodes["changed"], strict=True)]
        made = {"id": nodes["id"], "leaf": own, "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0], "before": before, "after": after}
        made["proof_sha256"] = [digest("".join(x + y for x, y in zip(b, a, strict=True))) for b, a in zip(before, after, strict=True)]
        made["folded_root"] = [fold(x, b, a) for x, b, a in zip(tried, before, after, strict=True)]
        return pd.DataFrame(made)[names]

    return run


def _exchange(nodes: DataFrame, outer: DataFrame, fn, schema: str) -> DataFrame:
    """fn over each superblock's nodes and its one row of `outer`, whose pos is the superblock's number."""
    keys = ["tree", "block"]
    return _block(nodes).groupBy(*keys).cogroup(outer.withColumnRenamed("pos", "block").groupBy(*keys)).applyInPandas(fn, schema)


def manifest(rows: DataFrame, key: str, group: str, columns: Sequence[str], changed: Column | None = None, proofs: bool = False) -> DataFrame:
    """One row per row: key, leaf, subroot, root, proof_sha256 (H of its siblings, level by level to the root),
    folded_root (from the leaf `changed`, as leaf() makes it, and the siblings), verified (whether that is the root)
    and, with proofs, the siblings themselves, `before` and `after`, a string for each level."""
    # One text for the group, in the same order: nothing for null.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    whole = leaf([F.col(c) for c in columns])
    made = rows.select(tree.alias("tree"), F.col(key).cast("long").alias("key"), whole.alias("d"), (F.lit(None).cast("binary") if changed is None else changed).alias("changed"))
    hashed = stored(made, "leaves")
    leaves = _placed(hashed, ["key", "d"], "placed-leaves")
    drop_stored(hashed)
    forest = _rounds(leaves, "nodes")
    tops = _placed(forest[-1].select(F.lit("").alias("tree"), F.col("tree").alias("group"), "d"), ["group"], "subroots")
    upper = _rounds(tops, "upper-nodes")
    outer = upper[-1].select("tree", "pos", *[F.array().cast("array<string>").alias(c) for c in ("before", "after")], F.lit("").alias("subroot"), F.lower(F.hex("d")).alias("root"))
    for nodes in upper[-2:0:-1]:
        outer = stored(_exchange(nodes, outer, _inner, _PATH), "outer")
    outer = stored(_exchange(tops, outer, _outer, _PATH), "outer")
    drop_stored(*upper)
    for nodes in forest[-2:0:-1]:
        above, outer = outer, stored(_exchange(nodes, outer, _inner, _PATH), "outer")
        drop_stored(above)
    drop_stored(*forest[1:])
    # The key as text: pandas has no nullable longs by itself.
    last = leaves.select("tree", "pos", "n", F.col("key").cast("string").alias("id"), "d", "changed")
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (", before array<string>, after array<string>" if proofs else "")
    out = _exchange(last, outer, _leaves(proofs), schema)
    more = ["before", "after"] if proofs else []
    return out.select(F.col("id").cast("long").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *more)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = leaf([F.translate(F.col(c), _UPPER, _LOWER) if c == "text" else F.col(c) for c in COLUMNS])
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, tampered)
    return manifest(docs, "doc_id", "source", COLUMNS, changed)


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
ORACLE = rf"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) x(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_LEAF.format("text")} AS leaf, {_LEAF.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS tampered,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 5 = 0 AS change
  FROM documents, crc),
l AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM d),
t(tree, lvl, pos, n, d) AS (
  SELECT tree, 0, pos, n, leaf FROM l
  UNION ALL SELECT tree, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, lvl, pos // 16, n),
s AS (SELECT tree, d, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, pos, n, d) AS (
  SELECT 0, pos, n, d FROM s
  UNION ALL SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 16, n),
-- A row for each leaf and level: the siblings before and after.
p AS (
  SELECT l.doc_id, l.tree, 0 AS upper, t.lvl, string_agg(t.d, '' ORDER BY t.pos) FILTER (t.pos < l.pos // CAST(pow(16, t.lvl) AS BIGINT)) AS before,
    string_agg(t.d, '' ORDER BY t.pos) FILTER (t.pos > l.pos // CAST(pow(16, t.lvl) AS BIGINT)) AS after
  FROM l JOIN t ON t.tree = l.tree AND t.n > 1 AND t.pos // 16 = l.pos // CAST(pow(16, t.lvl + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT l.doc_id, l.tree, 1, u.lvl, string_agg(u.d, '' ORDER BY u.pos) FILTER (u.pos < s.pos // CAST(pow(16, u.lvl) AS BIGINT)),
    string_agg(u.d, '' ORDER BY u.pos) FILTER (u.pos > s.pos // CAST(pow(16, u.lvl) AS BIGINT))
  FROM l JOIN s ON s.tree = l.tree JOIN u ON u.n > 1 AND u.pos // 16 = s.pos // CAST(pow(16, u.lvl + 1) AS BIGINT) GROUP BY ALL),
q AS (
  SELECT doc_id, coalesce(before, '') AS before, coalesce(after, '') AS after, row_number() OVER (PARTITION BY doc_id ORDER BY upper, lvl) AS step
  FROM p),
f(doc_id, step, d) AS (
  SELECT doc_id, 0, CASE WHEN change THEN tampered ELSE leaf END FROM l
  UNION ALL SELECT f.doc_id, f.step + 1, sha256(before || d || after) FROM f JOIN q ON q.doc_id = f.doc_id AND q.step = f.step + 1),
g AS (SELECT doc_id, arg_max(d, step) AS folded FROM f GROUP BY doc_id),
h AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM q GROUP BY doc_id),
r AS (SELECT d AS root FROM u WHERE n = 1)
SELECT l.doc_id, leaf, s.d AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM l JOIN s USING (tree) JOIN g USING (doc_id) LEFT JOIN h USING (doc_id), r
"""
