"""Hard negatives against a plain version that scores every row with every anchor."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.llm import negatives as N
from tests.llm.helpers import CLASHES

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def plain(rows, anchor=lambda i: i % 100 == 0, n_positives=5, k=10, low=30, high=90):
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        best[i] = min(best.get(i, (label, v)), (label, v))
    lengths = [len(v) for _, v in best.values()]
    width = max(set(lengths), key=lambda d: (lengths.count(d), -d)) if lengths else 0
    q = {i: (label, [int(x) * 256 if abs(x) > 2**53 else math.floor(256 * x) for x in v]) for i, (label, v) in best.items() if len(v) == width}
    most, out = 2**63 - 1, []
    for a in (i for i in q if anchor(i)):
        got = sorted((-max(-most, min(most, sum(x * y for x, y in zip(q[a][1], v)))), i, label) for i, (label, v) in q.items() if i != a)
        for s, p, _ in [x for x in got if x[2] == q[a][0]][:n_positives]:
            hits = [(-t, i) for t, i, label in got if label != q[a][0] and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, r + 1, i, -s, t) for r, (t, i) in enumerate(hits[:k])]
    return out


def made(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASHES if c != "label"})
    return [tuple(r) for r in N.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label")).collect()]


def clustered(seed, n, width=8, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(i, (centres[i % 6] + spread * rng.normal(size=width)).tolist(), int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_equals_brute_force_over_several_blocks_and_trees(spark, monkeypatch, spread):
    monkeypatch.setattr(N, "BLOCK_ROWS", 300)
    monkeypatch.setattr(N, "GROUP", 16)
    rows = [(i, v, label) for i, v, label in clustered(1, 2000, spread=spread)]
    rows = [(i * 5, v, label) for i, v, label in rows]  # 100 anchors, several trees
    assert sorted(made(spark, rows)) == sorted(plain(rows))


def test_ties_nulls_and_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)], rng.randrange(3)) for i in range(301)]
    rows += [(rows[5][0], rows[5][1], rows[5][2])] * 3 + [(7, [0.0, 0.0, 0.0, 0.0], 2), (None, [1.0] * 4, 1), (400, None, 1), (500, [1.0] * 4, None), (600, [1.0, None, 1.0, 1.0], 1)]
    rows += [(601, [1.0, float("nan"), 1.0, 1.0], 1), (602, [1.0, float("inf"), 1.0, 1.0], 1), (603, [1.0], 1), (604, [], 1), (700, [0.0] * 4, 9)]
    got = made(spark, rows)
    assert sorted(got) == sorted(plain(rows)) and got


def test_numbers_beyond_doubles_precision(spark):
    rng = random.Random(4)
    rows = [(i * 50, [rng.choice([1.0, 3e9, 2.5e15, -1e17, 1e306, 7e-300]) * rng.random() for _ in range(3)], rng.randrange(2)) for i in range(60)]
    assert sorted(made(spark, rows)) == sorted(plain(rows))


def test_nothing_to_mine(spark):
    assert made(spark, []) == []
    assert made(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert made(spark, [(100, [1.0], 1)]) == []
    assert made(spark, [(100, [], 1), (101, [], 1), (102, [], 2)]) == plain([(100, [], 1), (101, [], 1), (102, [], 2)])


def test_bounds_hold_and_spare_rows():
    """On clustered vectors most rows are never rescored; every bound holds the true score."""
    rows = clustered(2, 3000, width=16, spread=0.01)
    v = np.floor(256 * np.array([x[1] for x in rows]))
    block = N.Rows(np.arange(len(v)), np.array([x[2] for x in rows]), v, np.sqrt((v * v).sum(axis=1)))
    anchors = np.arange(0, 60)
    order, parent = N.spanning_tree(v[anchors])
    assert sorted(order) == anchors.tolist() and (parent[1:] < np.arange(1, 60)).all()
    bounds, rescored = [], 0
    for i, p in zip(order, parent):
        b = N.Bounds(block, v[anchors[i]], bounds[p] if p >= 0 else None)
        true = v @ v[anchors[i]]
        assert (b.low <= true).all() and (true <= b.high).all()
        N.positives(b, int(anchors[i]), int(block.labels[anchors[i]]), 5)
        rescored += b.rescored
        bounds.append(b)
    assert rescored < 0.5 * 60 * len(v)


def test_window_is_exact():
    for s in (-7, -1, 0, 1, 9, 10, 11, 10**18):
        least, most = N.window(s, 30, 90)
        for x in (least - 1, least, most, most + 1):
            assert (least <= x <= most) == (30 * s <= 100 * x <= 90 * s)


def test_trees_meet_blocks_without_a_broadcast(spark, monkeypatch):
    """Their copies, one for each block, would all pass through the driver."""
    plans, map_batches = [], N.map_batches
    monkeypatch.setattr(N, "BLOCK_ROWS", 100)
    monkeypatch.setattr(N, "map_batches", lambda df, fn, schema: (plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())), map_batches(df, fn, schema))[1])
    rows = [(i * 20, v, label) for i, v, label in clustered(7, 300)]
    assert sorted(made(spark, rows)) == sorted(plain(rows))
    met = [text for columns, text in plans if "rows" in columns]
    assert len(met) == 2
    for text in met:
        assert "SortMergeJoin [block#" in text.split("Generate explode(")[0]
