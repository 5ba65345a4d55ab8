"""Word tables over Arrow text columns, computed with numpy for a slice of many texts at a time.

A slice is a run of whole texts of about SLICE_BYTES; a longer text is a slice of its own. Every
function here treats a null text as an empty one and never cuts a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values for a seed."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 0xD1B54A32D192ED03 % (1 << 64)))


BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse, for spans that begin before n. Kept for one slice's length only."""
    if _POWERS and n <= len(_POWERS[0]):
        return _POWERS
    made, size = [], max(n, min(1 << n.bit_length(), SLICE_BYTES + 1))
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        up = np.full(size, base, dtype=U64)
        up[0] = 1
        made.append(np.multiply.accumulate(up, out=up))
    if n <= SLICE_BYTES + 1:
        _POWERS[:] = made
    return made


class Hasher:
    """Polynomial hashes of byte spans: the spans' bytes are mapped to random values first."""

    def __init__(self, seed: int) -> None:
        self.byte = stream(seed, 256)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=U64)
        np.multiply(self.byte[data], up[: len(data)], out=total[1:])
        np.cumsum(total, out=total)
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))

    def parts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 17) -> np.ndarray:
        """spans() of ascending spans, about `limit` bytes at a time: the same values, in less memory."""
        out, lo = np.empty(len(starts), dtype=U64), 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + limit, side="right")))
            a, b = starts[lo], ends[hi - 1]
            out[lo:hi] = self.spans(data[a:b], starts[lo:hi] - a, ends[lo:hi] - a)
            lo = hi
        return out


FIRST, SECOND = Hasher(11), Hasher(12)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Slice(NamedTuple):
    """Rows lo to hi of a batch: their bytes and each text's offsets in them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """data: the slice's bytes, lower-cased; of: each text's first word, and the number of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield Slice(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def words(piece: Slice, kind: np.ndarray = SPACED, lower: bool = True) -> Words:
    data = _LOWER[piece.data] if lower else piece.data
    inside = kind[data]
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = piece.offsets[1:-1]
    before[edge[edge < len(data)]] = False
    after[edge[edge > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, piece.offsets))


def grams(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The hash of each k consecutive values; the caller leaves out those that cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    by = stream(seed + 100 * k, k) | U64(1)
    total = hashes[:n] * by[0]
    for j in range(1, k):
        total = total + hashes[j : j + n] * by[j]
    return mix(total)


def whole(of: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n starts have k values of one text after them."""
    ok = np.zeros(n, dtype=bool)
    last = np.maximum(of[1:] - k + 1, of[:-1])
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, np.minimum(of[:-1], n), 1)
    np.add.at(edge, np.minimum(last, n), -1)
    np.greater(np.cumsum(edge[:n]), 0, out=ok)
    return ok


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the position of its smallest one, the rightmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = values[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, width):
        less = values[j : j + n] <= best
        best[less], at[less] = values[j : j + n][less], j
    return np.arange(n) + at
