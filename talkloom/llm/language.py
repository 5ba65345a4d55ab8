"""Word-level language identification with a linear-chain conditional random field.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text. A word's features are its
hash, its 2- and 3-byte affixes, its byte bigrams and trigrams (all hashed into one weight table) and, where
the training texts hold it mostly under one label, a lexicon feature of that label. Label-to-label weights are
learned with them, on sequences spliced from pieces of texts of different labels, so that switches within a
text are seen. Words are labelled by forward-backward over the whole text, and the text's label is the one
with the largest mean posterior.

Fitting uses every label and at most `per_label` documents of each, of `label_bytes` bytes together: those of the
smallest hashed ids, an id once however many rows repeat it; longer ones than an eighth of those bytes are passed
over, but for the shortest one of a label that has no other. The sample is chosen by id, so rows of null doc_id teach
nothing. The model and the sample grow with the number of labels alone. Everything else covers every word of every
document; the weights (a fixed table) are the only thing that is broadcast.

Defined results: null texts and texts without any letter get label `und` and score 0; texts whose words can
give no evidence get the likeliest label with its posterior; null labels are not learned; with nothing to learn
from every text is `und`; repeated rows and null ids give one result row each; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.llm import words as W
from talkloom.llm.shared import held_out, map_batches, release_memory, sample

U64 = W.U64
BITS, STEPS = 17, 48


class Crf(NamedTuple):
    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    lexicon: np.ndarray
    of_lexicon: np.ndarray


def _distinct(t: W.Words):
    """The distinct words of a word table: hashes, one occurrence of each, and each word's place among them."""
    return np.unique(W.FIRST.parts(t.data, t.starts, t.ends), return_index=True, return_inverse=True)


def _features(t: W.Words, at: np.ndarray, hashes: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(places in the weight table, offsets) of the features of the words `at`, made for `step` words at a time."""
    made = [_some_features(t, at[lo : lo + step], hashes[lo : lo + step]) for lo in range(0, max(1, len(at)), step)]
    sizes = np.concatenate([np.diff(ends) for _, ends in made])
    return np.concatenate([keys for keys, _ in made]), np.concatenate([[0], np.cumsum(sizes)])


def _some_features(t: W.Words, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = t.ends[at] - t.starts[at]
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(at), dtype=np.int32), sizes)
    place = np.arange(len(row)) - np.repeat(ends - sizes, sizes)
    code = np.zeros(len(row) + 3, dtype=U64)
    code[: len(row)] = t.data[t.starts[at][row] + place]
    left = sizes[row] - place
    pair = code[:-3] << U64(8) | code[1:-2]
    triple = pair << U64(8) | code[2:-1]
    rows, keys = [np.arange(len(at), dtype=np.int32)], [hashes]
    begin = place == 0
    kinds = [(left >= 2, pair), (left >= 3, triple), (begin & (left >= 2), pair), (begin & (left >= 3), triple)]
    kinds += [(left == 2, pair), (left == 3, triple), (begin & (left == 1), code[:-3])]
    for kind, (ok, key) in enumerate(kinds, 1):
        rows.append(row[ok])
        keys.append(W.mix(key[ok] | U64(kind << 40)))
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(rows, kind="stable")
    return (keys[order] >> U64(64 - BITS)).astype(np.int32), np.searchsorted(rows[order], np.arange(len(at) + 1))


def _lexical(hashes: np.ndarray, lexicon: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The lexicon label of each word, -1 where it has none."""
    if not len(lexicon):
        return np.full(len(hashes), -1)
    i = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[i] == hashes, of[i], -1)


def _emissions(t: W.Words, crf: Crf) -> np.ndarray:
    if not len(t.starts):
        return np.zeros((0, len(crf.labels)), dtype=np.float32)
    hashes, at, back = _distinct(t)
    keys, ends = _features(t, at, hashes)
    score = np.add.reduceat(crf.weights[keys], ends[:-1], axis=0)
    lex = _lexical(hashes, crf.lexicon, crf.of_lexicon)
    score[lex >= 0] += crf.weights[(1 << BITS) + lex[lex >= 0]]
    return score[back]


def _exp(score: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -30))


def posteriors(emit: np.ndarray, of: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward over texts of emissions, all texts a step at a time; of: each text's first word."""
    e = _exp(emit)
    move, begin = np.exp(moves - moves.max()).astype(e.dtype), np.exp(first - first.max()).astype(e.dtype)
    sizes = np.diff(of)
    order = np.argsort(-sizes, kind="stable")
    base, live = of[:-1][order], np.searchsorted(-sizes[order], -np.arange(max(sizes, default=0)), side="left")
    out, a = np.empty_like(e), None
    for t, n in enumerate(live):
        at = base[:n] + t
        a = e[at] * (begin if t == 0 else a[:n] @ move)
        a /= a.sum(axis=1, keepdims=True)
        out[at] = a
    b = np.ones((0, e.shape[1]), dtype=e.dtype)
    for t in range(len(live) - 1, -1, -1):
        n, at = live[t], base[: live[t]] + t
        b = np.concatenate([b, np.ones((n - len(b), e.shape[1]), dtype=e.dtype)])
        g = out[at] * b
        out[at] = g / g.sum(axis=1, keepdims=True)
        b = (e[at] * b) @ move.T
        b /= b.sum(axis=1, keepdims=True)
    return out


def fit(texts: list[str], tags: list[str], epochs: int = 4, rate: float = 0.3, seed: int = 5) -> Crf:
    """A CRF from labelled texts. Runs on the driver, on a sample of bounded size."""
    labels, rng = sorted(set(tags)), np.random.default_rng(seed)
    n_labels = len(labels)
    weights = np.zeros(((1 << BITS) + n_labels, n_labels), dtype=np.float32)
    moves, first = np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    none = Crf(labels, weights, moves, first, np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64))
    if not texts:
        return none
    full = pa.array(texts, pa.large_string())
    t = W.words(next(W.slices(full, 1 << 62)), W.ALNUM)
    if not len(t.starts):
        return none
    hashes, at, word = _distinct(t)
    y = np.repeat([labels.index(x) for x in tags], np.diff(t.of))
    # Each word's rate by label, for the (word, label) pairs that occur.
    pairs, counts = np.unique(word * n_labels + y, return_counts=True)
    of_word, of_label = np.divmod(pairs, n_labels)
    seen = counts / np.bincount(of_label, weights=counts, minlength=n_labels)[of_label] * 1e6
    begins = np.searchsorted(of_word, np.arange(len(hashes)))
    known = (np.bincount(word) >= 5) & (np.maximum.reduceat(seen, begins) >= 0.9 * np.add.reduceat(seen, begins))
    likeliest = of_label[np.lexsort((of_label, -seen, of_word))[begins]]
    lexicon, of_lexicon = hashes[known], likeliest[known]
    keys, ends = _features(t, at, hashes)
    lex = _lexical(hashes, lexicon, of_lexicon)
    # Pieces of texts, spliced in random order, cut into sequences of STEPS words.
    cuts, lo = [], 0
    while lo < len(y):
        cuts.append(lo)
        lo += int(rng.integers(4, 120))
    cuts = np.unique(np.concatenate([cuts, t.of[:-1][t.of[:-1] < len(y)]]))
    squares = np.zeros_like(weights, dtype=np.float64) + 1e-3
    for _ in range(epochs):
        pieces = rng.permutation(len(cuts))
        stops = np.append(cuts, len(y))
        line = np.concatenate([np.arange(stops[i], stops[i + 1]) for i in pieces])
        line = line[: len(line) // STEPS * STEPS].reshape(-1, STEPS) if len(line) >= STEPS else line.reshape(1, -1)
        for batch in np.array_split(line, max(1, len(line) // 192)):
            used, back = np.unique(word[batch.ravel()], return_inverse=True)
            size = ends[used + 1] - ends[used]
            flat = np.repeat(ends[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            key, row = keys[flat], np.repeat(np.arange(len(used)), size)
            emit = np.add.reduceat(weights[key], np.cumsum(size) - size, axis=0)
            in_lex = lex[used] >= 0
            emit[in_lex] += weights[(1 << BITS) + lex[used][in_lex]]
            steps = batch.shape[1]
            e = emit[back].astype(np.float64)
            gamma = posteriors(e, np.arange(0, e.shape[0] + 1, steps), moves, first)
            target = np.eye(n_labels)[y[batch.ravel()]]
            # Expected moves: the pairwise posterior of neighbours from the two unary ones and the move weights.
            ee, move = _exp(e).reshape(-1, steps, n_labels), np.exp(moves - moves.max())
            g3, y3 = gamma.reshape(-1, steps, n_labels), target.reshape(-1, steps, n_labels)
            forward = np.empty_like(ee)
            forward[:, 0] = ee[:, 0] * np.exp(first - first.max())
            forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
            expected = np.zeros_like(moves)
            for s in range(1, steps):
                raw = (forward[:, s - 1] @ move) * ee[:, s]
                forward[:, s] = raw / raw.sum(axis=1, keepdims=True)
                later = g3[:, s] / np.maximum(forward[:, s], 1e-12)
                ahead = ee[:, s] * later
                total = ((forward[:, s - 1] @ move) * ahead).sum(axis=1, keepdims=True)
                expected += move * ((forward[:, s - 1] / np.maximum(total, 1e-300)).T @ ahead)
            count = len(batch)
            moves += rate * ((y3[:, :-1, :, None] * y3[:, 1:, None, :]).sum(axis=(0, 1)) - expected) / count
            first += rate * (y3[:, 0] - g3[:, 0]).mean(axis=0)
            grad = np.zeros((len(used), n_labels))
            np.add.at(grad, back, target - gamma)
            touched, place = np.unique(np.concatenate([key, (1 << BITS) + lex[used][in_lex]]), return_inverse=True)
            source = np.concatenate([row, np.flatnonzero(in_lex)])
            step = np.stack([np.bincount(place, weights=grad[source, k], minlength=len(touched)) for k in range(n_labels)], axis=1)
            squares[touched] += step**2
            weights[touched] += (rate * step / np.sqrt(squares[touched])).astype(np.float32)
    return Crf(labels, weights, moves, first, lexicon, of_lexicon)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_label: int = 250, label_bytes: int = 1 << 20) -> Crf:
    """Fits on at most per_label documents, of label_bytes bytes together, of each label that is not null."""
    rows = docs.select(F.col("doc_id").alias("i"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("l"))
    found = sample(rows.filter("l is not null and text is not null"), "l", per_label, label_bytes).orderBy("i", "l", "text").collect()
    model = fit([r.text for r in found], [r.l for r in found])
    release_memory()
    return model


def label_words(docs: DataFrame, crf: Crf, text: str = "text", spans: bool = False, carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, shares (label -> mean posterior) and, if asked for, the runs of words of one
    label: (label, first word, number of words), and `row`, the document's own columns."""
    held = docs.sparkSession.sparkContext.broadcast(crf)
    row = F.struct("*") if carry else F.lit(None).cast("int")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), row.alias("row"))
    shape = T.StructType.fromDDL("doc_id long, best int, score double, shares array<float>, runs array<struct<label:string,start:int,n:int>>").add("row", read.schema["row"].dataType)

    def rows(batch: pa.RecordBatch):
        crf = held.value
        n_labels = len(crf.labels)
        shares, tops, sizes = [], [], []
        for piece in W.slices(batch.column(1), W.SLICE_BYTES * 8 // max(8, n_labels)):
            t = W.words(piece, W.ALNUM)
            n = np.diff(t.of)
            g = posteriors(_emissions(t, crf), t.of, crf.moves, crf.first)
            share = np.full((len(n), n_labels), 1 / n_labels, dtype=np.float32)
            if (n > 0).any():
                share[n > 0] = np.add.reduceat(g, t.of[:-1][n > 0], axis=0) / n[n > 0][:, None]
            shares.append(share)
            sizes.append(n)
            if spans:
                tops.append(g.argmax(axis=1))
        share, of = np.concatenate(shares), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        best = share.argmax(axis=1)
        runs = [None] * batch.num_rows
        if spans:
            top = np.concatenate(tops)
            for i, (a, b) in enumerate(zip(of[:-1], of[1:], strict=True)):
                at = np.flatnonzero(np.diff(top[a:b], prepend=-1)) if b > a else []
                runs[i] = [{"label": crf.labels[top[a + s]], "start": int(s), "n": int(n)} for s, n in zip(at, np.diff([*at, b - a]), strict=True)]
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("n", pa.int32())]))
        flat = pa.array(share.astype(np.float32).ravel())
        score = np.clip(np.round(share[np.arange(len(best)), best].astype(np.float64), 5), 0, 1)
        return pa.table({"doc_id": batch.column(0), "best": best.astype(np.int32), "score": score, "shares": pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, n_labels, dtype=np.int32), flat), "runs": pa.array(runs, kind), "row": batch.column(2)})

    out = map_batches(read, rows, shape)
    labels = F.array(*[F.lit(x) for x in crf.labels])
    return out.select("doc_id", F.get(labels, F.col("best")).alias("lang_pred"), "score", F.map_from_arrays(labels, "shares").alias("shares"), "runs", "row")


def identify(docs: DataFrame, crf: Crf, text: str = "text", spans: bool = False, carry: bool = False) -> DataFrame:
    """label_words() with `und` and score 0 for null texts and texts without a letter."""
    lettered = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    none = docs.filter(~lettered) if crf.labels else docs
    empty = none.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("map<string,float>").alias("shares"), F.lit(None).cast("array<struct<label:string,start:int,n:int>>").alias("runs"), (F.struct("*") if carry else F.lit(None).cast("int")).alias("row"))
    return label_words(docs.filter(lettered), crf, text, spans, carry).unionByName(empty) if crf.labels else empty


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
