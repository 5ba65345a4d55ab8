"""Near duplicates, decontamination, line dedup, mixing, neighbours and the pipeline."""

import hashlib
import random
import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkloom.llm import components, decontaminate, line_dedup, mixing, near_duplicates, neighbours
from talkloom.llm import words as W
from tests.llm.helpers import docs, empty, messy, sentences

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(rows, k):
    sets, up = {}, {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        up[i] = i
    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies():
    """Groups of copies around a base at many distances: some link only through others, some not at all."""
    rng, rows = random.Random(5), []
    for g in range(3):
        base = sentences(g, 90).split()
        for c in range(60):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((g * 1000 + (c * 37) % 61, " ".join(w)))
    rows += [(5000 + i, sentences(100 + i, 50)) for i in range(30)] + [(6000, "Just three words"), (6001, "just  three\tWORDS"), (6002, "word"), (6003, ""), (6004, None)]
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, k, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    monkeypatch.setattr(near_duplicates, "BLOCK_BYTES", 6000)
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs(spark, [(i, t, None, None) for i, t in rows]), shingle=k).collect()}
    want = brute_components(rows, k)
    assert got == want and 3 < len({c for _, c in want.values()}) < len(want)


def test_a_bucket_of_unlike_and_very_long_members(spark, monkeypatch):
    """600 texts that share half of their words, three texts of 200,000 words, and few links."""
    sizes, stored = {}, near_duplicates.stored

    def seen(df, name):
        out = stored(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(near_duplicates, "stored", seen)
    common = sentences(7, 300).split()
    rows = [(i, " ".join(common + sentences(5000 + i, 280).split()), None, None) for i in range(600)]
    long_text = sentences(8, 200_000)
    rows += [(10_000, long_text, None, None), (10_001, long_text + " more", None, None), (10_002, " ".join(common) + " " + long_text, None, None)]
    rows += [(20_000 + i, rows[i][1] + " tail" * i, None, None) for i in range(3)]
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs(spark, rows)).collect()}
    linked = {i: c for i, c in got.items() if i != c}
    assert linked == {10_001: 10_000, 10_002: 10_000, 20_000: 0, 20_001: 1, 20_002: 2}
    assert sizes["left-members"] <= len(rows) and sizes["candidates"] <= 32 * len(rows)


def test_near_duplicate_edges(spark):
    got = near_duplicates.near_duplicates(messy(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == 11 and {r.component_id for i in (1, 7) for r in by[i]} == {1} and by[None][0].kept and by[None][0].component_id is None
    assert all(by[i][0].n_shingles == 0 and by[i][0].component_id == i for i in (2, 3, 4)) and near_duplicates.near_duplicates(empty(spark)).count() == 0


def test_bayesian_limits_follow_the_posterior():
    from math import comb

    for n, m in zip(range(32, 257, 32), near_duplicates.least_matches(80, 1e-6)):
        tail = lambda k: sum(comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= 1e-6 > tail(m - 1)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}


def brute_hits(texts, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    out = []
    for t in texts:
        w, hit, ids = split(t), set(), set()
        for i, x in items:
            v = split(x)
            k = min(n, len(v))
            wins = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in wins:
                    hit |= set(range(j, j + k))
                    ids.add(str(i))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_decontamination_equals_all_windows(spark):
    rng = random.Random(2)
    items = [(i, sentences(200 + i, n)) for i, n in enumerate([10, 11, 14, 30, 60, 9, 3, 1])] + [(8, sentences(203, 30)), (9, None), (10, "!!"), (11, "La la la la la la la la la la la la")]
    texts = [None, "", "la " * 40]
    for d in range(60):
        w = sentences(300 + d, 50).split()
        for _ in range(rng.randrange(3)):
            v = rng.choice(items[:8])[1].split()
            a = rng.randrange(len(v))
            cut = v[a : a + rng.randrange(1, 25)]
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in cut]
        texts.append(" ".join(w))
    bench = spark.createDataFrame([*items, (3, items[3][1])], "item_id long, text string").withColumn("fp", F.lit(1))
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), bench).collect()}
    for i, (n, hit, ids) in enumerate(brute_hits(texts, items)):
        assert (got[i].n_words, got[i].n_hit, list(got[i].item_ids), got[i].contaminated) == (n, hit, ids, hit > 0)
        assert sum(s.end - s.start for s in got[i].spans) == hit


@pytest.mark.parametrize("window,gram", [(6, 6), (7, 3), (4, 1)])
def test_decontamination_at_other_window_sizes(spark, window, gram):
    rng, pool = random.Random(window), "a b c d e f g h".split()
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for i in range(12)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 80))) for _ in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), bench, window=window, gram=gram).collect()}
    for i, (n, hit, ids) in enumerate(brute_hits(texts, items, window)):
        assert (got[i].n_words, got[i].n_hit, list(got[i].item_ids)) == (n, hit, sorted(ids))


def test_rows_of_one_item_count_once(spark):
    one, two = sentences(31, 20), sentences(32, 20)
    bench = spark.createDataFrame([("q", one), ("q", two), ("p", one), (None, two), (None, one)], "item_id string, text string")
    got = decontaminate.decontaminate(docs(spark, [(1, one + " " + two, None, None), (2, two, None, None)]), bench).orderBy("doc_id").collect()
    assert [(r.n_items, list(r.item_ids)) for r in got] == [(3, ["p", "q"]), (2, ["q"])]


def test_windows_are_found_by_their_fingerprints_alone(monkeypatch):
    piece = next(W.slices(pa.array([sentences(33, 30)])))
    assert 5 < len(decontaminate._prints(W.words(piece, W.ALNUM), 10, 5, [], 1)[0]) < 21
    monkeypatch.setattr(W, "minima", lambda values, width: np.zeros(0, dtype=np.int64))
    assert len(decontaminate._prints(W.words(piece, W.ALNUM), 10, 5, [], 1)[0]) == 0


def test_every_long_shared_span_shares_a_fingerprint():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 50, 400).astype(np.uint64)
    best = decontaminate.W.minima(g, 6)
    for a in range(len(best)):
        assert a <= best[a] < a + 6 and g[best[a]] == g[a : a + 6].min() and not (g[best[a] + 1 : a + 6] == g[best[a]]).any()


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "one two three"), (None, "seven eight")], "item_id long, text string")
    got = decontaminate.decontaminate(messy(spark), bench).collect()
    assert len(got) == 11 and {r.n_hit for r in got if r.doc_id in (1, 7)} == {5} and {tuple(r.item_ids) for r in got if r.doc_id == 1} <= {("1",)}
    assert decontaminate.decontaminate(messy(spark), bench.limit(0)).filter("contaminated").count() == 0 and decontaminate.decontaminate(empty(spark), bench).count() == 0


def brute_lines(rows, run=3):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = t.split("\n")
        filled = [k for k, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for s in range(len(filled) - run + 1):
            key = tuple(lines[k] for k in filled[s : s + run])
            if key in seen:
                gone |= set(filled[s : s + run])
            seen.add(key)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_line_dedup_equals_all_runs(spark):
    rng = random.Random(9)
    pool = [sentences(400 + i, 4) for i in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, "", "  "]) if rng.random() < 0.8 else sentences(1000 + i * 50 + k, 5) for k in range(rng.randrange(1, 25)))) for i in range(80)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs(spark, [(i, t, None, None) for i, t in rows])).collect()}
    want = brute_lines(rows)
    assert got == want and sum(n for _, _, n in want.values()) > 50


def brute_lines_or_words(rows, run=3, words=50):
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        filled = [k for k, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for s in range(len(filled)):
            for n in range(1, min(run, len(filled) - s) + 1):
                key = tuple(lines[k] for k in filled[s : s + n])
                if n < run and sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in key) < words:
                    continue
                if key in seen:
                    gone |= set(filled[s : s + n])
                seen.add(key)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_line_dedup_counts_a_run_by_its_words(spark):
    rng = random.Random(10)
    pool = [sentences(500 + i, n) for i, n in enumerate([4, 10, 20, 24, 25, 26, 30, 49, 50, 51, 80])]
    rows = [(i, "\n".join(rng.choice([*pool, "", " \t"]) if rng.random() < 0.6 else sentences(9000 + i * 50 + k, 5) for k in range(rng.randrange(1, 9)))) for i in range(80)]
    rows += [(900, "own\n" + pool[9] + "\nline"), (901, pool[9]), (902, pool[7])]
    d = docs(spark, [(i, t, None, None) for i, t in rows])
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(d, min_words=50).collect()}
    assert got == brute_lines_or_words(rows) and got[900][0] == "own\nline" and got[901] == ("", 1, 1) and got[902][2] == 0


def test_lines_are_winnowed():
    """Each run selects the smallest of its hashes; runs share what they select, so fewer places than lines are kept;
    equal runs select the same place. With any other choice than the smallest, all places would be kept."""
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    h[2000:2100] = h[100:200]
    of = np.array([0, 1000, 1000, 2950, 2952, 3000])
    at, place = line_dedup.selected(h, of, 6, 2)
    grams = line_dedup.W.grams(h, 2, 43)
    assert at.tolist() == [s for a, b in zip(of[:-1], of[1:]) for s in range(a, b - 5)]
    assert all(grams[p] == grams[s : s + 5].min() and s <= p < s + 5 for s, p in zip(at, place))
    assert len(set(place.tolist())) < 0.4 * len(at)
    where = dict(zip(at.tolist(), place.tolist()))
    assert all(where[2000 + i] - 2000 == where[100 + i] - 100 for i in range(95))
    short = line_dedup.selected(h, of, 3, 2)[1]
    assert len(set(short.tolist())) < 0.72 * len(short)


@pytest.mark.parametrize("run,gram", [(2, 1), (4, 2), (5, 1), (6, 3), (3, 3)])
def test_line_dedup_at_other_lengths_of_runs(spark, run, gram):
    rng = random.Random(run * 10 + gram)
    pool = [sentences(700 + i, 3) for i in range(5)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else sentences(3000 + i * 50 + k, 4) for k in range(rng.randrange(1, 25)))) for i in range(60)]
    passage = [sentences(900 + i, 3) for i in range(15)]
    for i in range(0, 60, 3):
        at = rng.randrange(0, 15 - run)
        rows[i] = (i, "\n".join([rows[i][1], *passage[at : at + rng.randrange(run - 1, 16)]]))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs(spark, [(i, t, None, None) for i, t in rows]), min_run=run, gram=gram, min_words=None).collect()}
    want = brute_lines(rows, run)
    assert got == want and sum(n for _, _, n in want.values()) > 10


def test_line_dedup_edges(spark):
    got = line_dedup.dedup_lines(messy(spark)).collect()
    assert len(got) == 11 and sum(r.n_removed for r in got) == 0 and {r.text for r in got if r.doc_id == 2} == {None} and line_dedup.dedup_lines(empty(spark)).count() == 0


def test_flow_meets_quotas_of_overlapping_sources_at_least_cost():
    sent = mixing.min_cost_flow([100, 50, 80], [(0,), (0, 1), (1,)], [120, 130], 2)
    assert sent[0][0] + sent[1][0] == 120 and sent[1][1] + sent[2][0] == 130
    used = [sum(s) for s in sent]
    assert sum(max(0, u - c) for u, c in zip(used, [100, 50, 80])) == 20 and all(u <= 2 * c for u, c in zip(used, [100, 50, 80]))


def plain_least_cost(supply, members, quotas, repeats):
    """Largest flow at least cost, a word at a time along cheapest paths (Bellman-Ford)."""
    sent, used, left = [[0] * len(m) for m in members], [0] * len(supply), list(quotas)
    while True:
        cost, via = {("p", p): used[p] // s + 1 for p, s in enumerate(supply) if used[p] < repeats * s}, {}
        for _ in range(2 * (len(supply) + len(quotas))):
            for p, own in enumerate(members):
                for k, m in enumerate(own):
                    if cost.get(("p", p), 99) < cost.get(("m", m), 99):
                        cost["m", m], via["m", m] = cost["p", p], (p, k)
                    if sent[p][k] and cost.get(("m", m), 99) < cost.get(("p", p), 99):
                        cost["p", p], via["p", p] = cost["m", m], (m, k)
        ends = [(cost["m", m], m) for m in range(len(quotas)) if left[m] and ("m", m) in cost]
        if not ends:
            return sent
        m = min(ends)[1]
        left[m] -= 1
        while True:
            p, k = via["m", m]
            sent[p][k] += 1
            if ("p", p) not in via:
                used[p] += 1
                break
            m, k = via["p", p]
            sent[p][k] -= 1


def test_flow_costs_no_more_than_cheapest_paths():
    rng = random.Random(3)
    for _ in range(40):
        n_s, n_p = rng.randrange(1, 5), rng.randrange(1, 7)
        members = [tuple(sorted(rng.sample(range(n_s), rng.randrange(1, n_s + 1)))) for _ in range(n_p)]
        supply, quotas = [rng.randrange(1, 9) for _ in range(n_p)], [rng.randrange(0, 20) for _ in range(n_s)]
        flows = [f(supply, members, quotas, 2) for f in (mixing.min_cost_flow, plain_least_cost)]
        used = [[sum(x) for x in f] for f in flows]
        cost = [sum(max(0, u - c) for u, c in zip(x, supply)) for x in used]
        assert sum(used[0]) == sum(used[1]) and cost[0] == cost[1] and all(0 <= u <= 2 * c for u, c in zip(used[0], supply))
        into = [sum(f for x, own in zip(flows[0], members) for f, k in zip(x, own) if k == m) for m in range(n_s)]
        assert all(i <= q for i, q in zip(into, quotas)) and all(f >= 0 for x in flows[0] for f in x)


def test_flow_of_many_patterns_is_quick():
    rng, began = random.Random(6), time.time()
    members = [tuple(sorted(rng.sample(range(60), 3))) for _ in range(20_000)]
    supply = [rng.randrange(1, 2000) for _ in members]
    sent = mixing.min_cost_flow(supply, members, [sum(supply) // 50] * 60, 2)
    assert sum(map(sum, sent)) == sum(supply) // 50 * 60 and time.time() - began < 30


def test_mix_routes_every_pattern_or_none(spark):
    """50,000 patterns of two of 400 sources; with a smaller bound, an error instead of another way to mix."""
    pair = F.array(F.concat(F.lit("s"), F.col("id") % 400), F.concat(F.lit("s"), (F.col("id") * 7 + F.floor(F.col("id") / 400)) % 400))
    d = spark.range(50_000).select(F.col("id").alias("doc_id"), pair.alias("both"), (F.col("id") % 13 + 5).alias("size"))
    got = mixing.mix(d, F.col("size"), F.col("both")).agg(F.count("*"), F.sum("taken"), F.sum("size"), F.max(F.col("taken") / F.col("size"))).first()
    assert got[0] == 50_000 and abs(got[1] - 1.5 * got[2]) < 0.01 * got[2] and got[3] <= 2
    with pytest.raises(ValueError, match="max_patterns"):
        mixing.mix(d, F.col("size"), F.col("both"), max_patterns=500)


def test_targets_are_capped_and_shared_again():
    assert mixing.water_fill([10, 100, 100], [5, 2, 1], 315, 2) == [20.0, 2 * (295 / 3), 295 / 3]
    assert mixing.water_fill([], [], 0, 2) == [] and mixing.water_fill([0, 4], [1, 1], 6, 2) == [0.0, 6.0]


def test_mix_takes_overlapping_documents_near_the_targets(spark):
    rng = random.Random(4)
    rows = [(i, sentences(i, rng.randrange(5, 60)), None, rng.choice(["a", "b", None])) for i in range(400)]
    d = docs(spark, rows)
    both = mixing.mix(d, mixing.words_in(), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source"))).collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in both) and len(both) == 400
    one = mixing.mix(d, mixing.words_in(), F.array("source")).collect()
    for s in {r.sources[0] for r in one}:
        own = [r for r in one if r.sources[0] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 8 and own[0].source_size == sum(r.size for r in own)
    assert sorted(map(str, one)) == sorted(map(str, mixing.mix(d.repartition(7), mixing.words_in(), F.array("source")).collect()))


def test_mix_edges(spark):
    got = mixing.mix(messy(spark), mixing.words_in(), F.array("source")).collect()
    assert len(got) == 11 and all(r.taken <= 2 * r.size for r in got) and mixing.mix(empty(spark), mixing.words_in(), F.array("source")).count() == 0
    none = mixing.mix(messy(spark), mixing.words_in(), F.when(F.col("doc_id") == 1, F.array("source")).when(F.col("doc_id") == 2, F.array())).collect()
    assert len(none) == 11 and {r.doc_id for r in none if r.taken} <= {1}


def test_neighbours_reach_the_recall_and_are_exact_on_small_tables(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) + 2 * rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)]
    x[300:700] = x[300]  # a vector that many rows share
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    found, hits, n = {}, 0, np.sqrt((x * x).sum(axis=1))
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in range(0, 1500, 50):
        s = (x @ x[q]) / (n * n[q])
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        hits += len({v for v, _ in found[q].values()} & set(best.tolist()))
        assert all(abs(score - s[v]) < 1e-12 for v, score in found[q].values()) and sorted(found[q]) == [1, 2, 3, 4, 5]
        if 300 <= q < 700:
            assert [found[q][k][0] for k in range(1, 6)] == [i for i in range(300, 307) if i != q][:5]
    assert hits / (30 * 5) >= 0.9


def test_the_index_reads_few_entries_of_a_large_block():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 24))
    p = x[:1000] / np.sqrt((x[:1000] ** 2).sum(axis=1))[:, None]
    order = neighbours.orders(x, p.astype(np.float32), 64)
    block, free, read = neighbours.Block(order, 8, 1000), np.full(1000, 64, dtype=np.int32), []
    near = (x @ p.T) / np.sqrt((x * x).sum(axis=1))[:, None]
    assert (np.take_along_axis(near, order.astype(int), axis=1)[:, :-1] >= np.take_along_axis(near, order.astype(int), axis=1)[:, 1:] - 1e-6).all()
    for q in range(0, 6000, 600):
        some = block.found(order[q, :24])
        want = [i for i in range(6000) if set(order[i, :8].tolist()) & set(order[q, :24].tolist())]
        assert some.tolist() == want and q in want
        place = {int(v): k for k, v in enumerate(order[q])}
        for i, gap in zip(some[:20], block.footrule(order[q], some, free)[:20]):
            other = {int(v): k for k, v in enumerate(order[i])}
            assert gap == sum(abs(place.get(v, 64) - other.get(v, 64)) for v in place | other)
        assert (free == 64).all()
        read.append(len(some))
    assert np.mean(read) < 0.25 * 6000


def test_neighbour_edges(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (50, [2.0, 0.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("ids", F.lit(1)).withColumn("v", F.lit(2))
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 12)) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(0, 1): (50, 1.0), (0, 2): (7, 0.0), (50, 1): (0, 1.0), (50, 2): (7, 0.0)}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_of_finite_vectors_of_any_size(spark):
    """Squares of these overflow or vanish; cosines don't."""
    v = {0: [1e200, 1.0, 1.0, 1.0], 50: [1e-200, 1e-200, 0.0, 0.0], 100: [1e300, 1e300, 0.0, 0.0], 1: [3.0, 3.0, 0.0, 0.0], 2: [5.0, 0.0, 0.0, 1e-3], 3: [5e-324, 0.0, 0.0, 0.0], 4: [0.0, 0.0, 0.0, -0.0]}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = {i: np.array(x) / max(map(abs, x)) for i, x in v.items() if any(x)}
    for q in (0, 50, 100):
        score = {i: float(u @ unit[q] / np.sqrt((u @ u) * (unit[q] @ unit[q]))) for i, u in unit.items() if i != q}
        found = sorted(got[q])
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5] and {i for _, i, _ in found} == set(score)
        assert all(abs(s - score[i]) < 1e-12 for _, i, s in found)


def test_pipeline_carries_columns_of_any_name(spark):
    """Every name that the stages use inside, as a column of the table's own."""
    import corpus_pipeline as pipe

    names = ["times", "taken_id", "row", "col", "component_id", "kept", "contaminated", "lang_pred", "members", "target", "words", "total", "full", "upto", "g", "hash", "key", "h", "i", "possible", "label", "sources"]
    now = docs(spark, [(i, sentences(i, 40), ("en", "fr")[i % 2], f"s{i % 3}") for i in range(40)]).withColumns({c: F.lit(c) for c in names})
    columns = now.columns
    for _, stage in pipe.STAGES[:-1]:
        now = pipe.stored(stage(spark, now, "/root/testdata/sf0.001"), "test")
        assert now.columns == columns and all(r[c] == c for r in now.collect() for c in names)
    assert now.count() > 0 and pipe.write_token_files(spark, now, "/root/testdata/sf0.001").count() == now.count()


def test_pipeline_stages_equal_plain_python(spark):
    import corpus_pipeline as pipe

    sf = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    now = before
    for name, stage in pipe.STAGES:
        now = pipe.stored(stage(spark, now, sf), "test")
        kept[name] = now.collect()
        if name != "token files":
            assert now.columns == before.columns
    texts = {r.doc_id: r.text for r in before.collect()}
    first = {r.doc_id for r in kept["language"]}
    assert {i for i, t in texts.items() if not re.search(r"[^\W\d_]", t or "")}.isdisjoint(first)
    comp = brute_components([(i, texts[i]) for i in sorted(first)], 5)
    assert {r.doc_id for r in kept["near duplicates"]} == {i for i in comp if comp[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    ids = sorted(r.doc_id for r in kept["near duplicates"])
    assert {r.doc_id for r in kept["decontamination"]} == {i for i, (_, hit, _) in zip(ids, brute_hits([texts[i] for i in ids], items)) if not hit}
    assert {r.doc_id for r in kept["mixing"]} <= {r.doc_id for r in kept["decontamination"]} and sum(r.n_tokens for r in kept["token files"]) == max(r.start + r.n_tokens for r in kept["token files"])
    assert [r.doc_id for r in sorted(kept["token files"], key=lambda r: r.start)] == sorted(r.doc_id for r in kept["mixing"])


def test_pipeline_stages_take_messy_and_empty_tables(spark):
    import corpus_pipeline as pipe

    for table in (messy(spark), empty(spark)):
        now = table
        for _, stage in pipe.STAGES[:-1]:
            now = pipe.stored(stage(spark, now, "/root/testdata/sf0.001"), "test")
            assert now.columns == table.columns
        last = pipe.write_token_files(spark, now, "/root/testdata/sf0.001")
        assert last.count() == now.count() and last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_run_leaves_its_result_alone(spark, tmp_path):
    import corpus_pipeline as pipe
    from talkloom.llm import shared

    before = list(shared._WRITTEN)
    sf = str(tmp_path)
    messy(spark).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    got = pipe.run(spark, sf)
    assert got.count() > 0 and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and before == shared._WRITTEN


def test_languages_are_rejected_under_nearly_even_shares():
    import corpus_pipeline as pipe

    assert pipe.least_share(1) == 1 and round(pipe.least_share(4), 9) == 0.3 and pipe.least_share(0) == 1 and 0.01 < pipe.least_share(100) < 0.08


def test_pipeline_drops_contaminated_documents_without_an_id(spark):
    import corpus_pipeline as pipe

    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("text is not null").orderBy("item_id").first().text
    rows = [(None, "before " + item + " after", None, None), (None, "a clean text", None, None), (None, "a clean text", None, None), (None, None, None, None), (1, item, None, None), (1, "same id", None, None), (2, "clean", None, None), (2, None, None, None)]
    got = pipe.drop_contaminated(spark, docs(spark, rows).withColumn("key", F.lit("x")), sf)
    assert got.columns[-1] == "key" and sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, ""), (0, "a clean text"), (0, "a clean text"), (2, ""), (2, "clean")]


def test_registered_queries_have_the_contracts_columns(spark):
    from talkloom.llm import queries

    want = {"op6_near_duplicates": {"doc_id", "n_shingles", "component_id", "kept"}, "op10_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}, "op9_neighbours": {"query_id", "rank", "vec_id", "score"}}
    for name, columns in want.items():
        assert columns <= set(queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_queries_meet_blocks_without_a_broadcast(spark, monkeypatch):
    """Their copies, one for each block, would all pass through the driver."""
    plans, map_batches = [], neighbours.map_batches
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(neighbours, "map_batches", lambda df, fn, schema: (plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())), map_batches(df, fn, schema))[1])
    x = np.random.default_rng(8).normal(size=(400, 8))
    got = neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=1, keep=1.0, probed=64).collect()
    cosine = (x @ x.T) / np.sqrt((x * x).sum(axis=1))[:, None] / np.sqrt((x * x).sum(axis=1))
    np.fill_diagonal(cosine, -2)
    assert {r.query_id: r.vec_id for r in got} == {i: int(cosine[i].argmax()) for i in range(0, 400, 50)}
    met = [text for columns, text in plans if columns == ["asks", "entries"]]
    assert len(met) == 1 and "SortMergeJoin [block#" in met[0] and "BroadcastHashJoin" not in met[0]
