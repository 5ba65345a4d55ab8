"""The manifest against a plain version that builds whole trees in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from talkloom.llm import manifest as M
from tests.llm.helpers import docs, empty, messy, sentences

COLS = M.COLUMNS


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    out = []
    for c in COLS:
        x = row[c]
        if lower and c == "text" and x is not None:
            x = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in x)
        out.append("-" if x is None else f"{len(str(x).encode())}:{x}")
    return h("".join(out))


def tree(nodes):
    """The top of a tree, and each node's siblings (before, after) on every level."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(now) > 1:
        for path, i in zip(paths, at):
            run = now[i // 16 * 16 : i // 16 * 16 + 16]
            path.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        now = [h("".join(now[i : i + 16])) for i in range(0, len(now), 16)]
        at = [i // 16 for i in at]
    return (now[0] if now else None), paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names, tops, inner = sorted(groups), [], {}
    for g in names:
        own = sorted(groups[g], key=lambda x: x[:3])
        top, paths = tree([x[2] for x in own])
        tops.append(top)
        inner[g] = list(zip(own, paths))
    root, upper = tree(tops)
    out = []
    for g, top, up in zip(names, tops, upper):
        for (has, i, own, r), path in inner[g]:
            path = path + up
            now = leaf(r, True) if has and zlib.crc32(str(i).encode()) % 5 == 0 else own
            for a, b in path:
                now = h(a + now + b)
            out.append((i if has else None, own, top, root, h("".join(a + b for a, b in path)), now, now == root))
    return out


def made(df, **more):
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, M.leaf([F.translate(F.col(c), M._UPPER, M._LOWER) if c == "text" else F.col(c) for c in COLS]))
    return M.manifest(df, "doc_id", "source", COLS, changed, **more)


def test_deep_trees_and_many_groups(spark):
    """One group of three levels and two rounds, one of exactly a superblock, single leaves, and a tree of groups."""
    sizes = {"hot": 4200, "full": 256, "run": 16, None: 17, "é": 1} | {f"s{i}": 1 + i % 3 for i in range(20)}
    rows = [(n * 10_000 + i, sentences(i, 3).title() if i % 4 else "lower", "en", s) for n, (s, k) in enumerate(sizes.items()) for i in range(k)]
    df = docs(spark, rows)
    want = plain([r.asDict() for r in df.collect()])
    got = [tuple(r) for r in made(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_messy_tables(spark):
    df = messy(spark)
    want = plain([r.asDict() for r in df.select(*COLS).collect()])
    got = [tuple(r) for r in made(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == df.count()


def test_one_row_and_none(spark):
    one = made(docs(spark, [(3, "Text", "en", "s")])).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == h("") and one.verified == (one.folded_root == one.root)
    assert made(empty(spark)).collect() == []


def test_proofs_lead_to_the_root(spark):
    rows = made(docs(spark, [(i, f"Text {i}", "en", f"s{i % 3}") for i in range(100)]), proofs=True).collect()
    for r in rows:
        assert M.fold(r.leaf, r.before, r.after) == r.root
        assert r.proof_sha256 == h("".join(a + b for a, b in zip(r.before, r.after)))
    assert M.fold(h("other"), rows[0].before, rows[0].after) != rows[0].root


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 33, 256])
def test_local_levels(n):
    nodes = [h(str(i)) for i in range(n)]
    _, paths = tree(nodes)
    levels = M.local_levels(nodes, n)
    assert [[level[i // 16**k] for k, level in enumerate(levels)] for i in range(n)] == paths
