"""Piecewise hashes against plain loops over bytes, chunks and rows."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkloom.llm import piecewise as P
from tests.llm.helpers import docs, empty, messy, sentences

M32 = 0xFFFFFFFF


def rotate(x, n):
    return ((x << n) | (x >> (32 - n))) & M32 if n else x


def plain_print(data):
    """A byte at a time: the window's hash, cuts at each block size, chunks of every size."""
    table, level = [int(x) for x in P._BYTE], []
    for i in range(len(data)):
        h = 0
        for j in range(min(i + 1, 8)):
            h ^= rotate(table[data[i - j]], j)
        h = (h ^ (h >> 15)) * 0x2C1B3C6D & M32
        h ^= h >> 13
        level.append(next((b for b in range(32) if not h >> b & 1), 32))
    k = 2
    while sum(x >= k for x in level) > 63:
        k += 1
    out = [str(k)]
    for size in (k, k + 1, k + 2):
        sig, begin = "", 0
        for i, x in enumerate(level):
            if x >= size or i == len(data) - 1:
                code = zlib.crc32(data[begin : i + 1]) & 4095
                sig += P._LETTERS[code >> 6] + P._LETTERS[code & 63]
                begin = i + 1
        out.append(sig)
    return ":".join(out)


def plain_distance(a, b):
    """Edit distance with insertions and deletions, row by row."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(last[j] if x == y else 1 + min(last[j + 1], now[j]))
        last = now
    return last[-1]


def plain_likeness(one, other):
    a, b = one.split(":"), other.split(":")
    for size in range(max(int(a[0]), int(b[0])), min(int(a[0]), int(b[0])) + 3):
        x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (a[1 + size - int(a[0])], b[1 + size - int(b[0])]))
        return 1 - plain_distance(x, y) / (len(x) + len(y)) if x or y else 1.0
    return 0.0


@pytest.mark.parametrize("text", ["", "a", "ab" * 5000, "x" * 70_000, sentences(1, 9), sentences(2, 300), sentences(3, 9000), "ééé 🎈" * 300])
def test_fingerprint_is_that_of_a_loop(text, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 1000)
    assert P.fingerprint(text.encode()) == plain_print(text.encode())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["AA", "BB", "CC", "DD"]), max_size=20), st.lists(st.sampled_from(["AA", "BB", "CC", "DD"]), max_size=20))
def test_edit_distance_is_that_of_the_table(a, b):
    assert len(a) + len(b) - 2 * P._common(a, b) == plain_distance(a, b)


def test_edits_are_alike_and_others_are_not():
    rng = random.Random(5)
    for n in (200, 2000, 40_000):
        text, other = sentences(n, n), sentences(n + 1, n)
        words = text.split()
        words[len(words) // 2] = "edited"
        near = P.likeness(P.fingerprint(text.encode()), P.fingerprint(" ".join(words).encode()))
        half = P.likeness(P.fingerprint(text.encode()), P.fingerprint((text[: len(text) // 2] + other[: len(text) // 2]).encode()))
        far = P.likeness(P.fingerprint(text.encode()), P.fingerprint(other.encode()))
        assert near > 0.85 and 0.3 < half < 0.7 and far < 0.15
        cut = rng.randrange(len(text) // 2)
        assert P.likeness(P.fingerprint(text.encode()), P.fingerprint((text[:cut] + text[cut + 5 :]).encode())) > 0.85


def plain(rows):
    rows = [(i, t or "") for i, t in rows]
    out = []
    for (i, t), (_, u) in zip(rows, [*rows[1:], rows[0]]):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        a, b, c = (plain_print(x.encode()) for x in (t, edited, u))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, c)))
    return out


def near(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("n", [1, 2, 57])
def test_rows_meet_the_next_ones_over_ranges(spark, n):
    rows = [(i * 7, sentences(i, 3 + i * i % 40) if i % 5 else None, "en", "s") for i in range(n)]
    got = [tuple(r) for r in P.edited_by_next(docs(spark, rows).repartition(5)).collect()]
    assert near(got) == near(plain([(i, t) for i, t, *_ in rows]))
    one = {r.doc_id: r.fingerprint for r in P.fingerprints(docs(spark, rows)).collect()}
    assert one == {r[0]: r[3] for r in got}


def test_messy_and_empty_tables(spark):
    from pyspark.sql import functions as F

    df = messy(spark)
    ordered = df.select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()
    got = [tuple(r) for r in P.edited_by_next(df).collect()]
    assert near(got) == near(plain([tuple(r) for r in ordered]))
    assert P.edited_by_next(empty(spark)).collect() == []
    assert P.likeness("2:::", "2:::") == 1 and P.likeness("2:::", P.fingerprint(b"text")) == 0
