"""Toxicity scores from a convolutional text classifier trained in numpy.

Words (runs of letters, digits and non-ASCII characters of the lower-cased text) are hashed into an embedding
table: a word's vector is the sum of the rows of the word and of its first PREFIXES bytes. Filters of several
widths slide over the word sequence; each keeps its largest response in the text (max pooling, rectified), and a
logistic layer turns those into a probability, which is then calibrated on labelled rows that the weights were not
trained on: every fifth id, by its hash. For each language of those rows that has label 1 among them the threshold of
the best F1 is kept as well; languages choose a threshold and never enter a score.

Every labelled text is learnt from or calibrated on, whole, however many there are:

1. Labelled rows are dealt by their hash to shards of about SHARD_BYTES and stored.
2. The driver takes the first steps, on `per_class` documents of each class at most, of `class_bytes` bytes together.
3. In each pass all shards learn from all their rows, each beginning with the classifier that is broadcast, and the mean of
   their steps is added to it. What comes back is as large as the classifier, whatever the number of shards.
4. Logits of the rows held out are counted in steps of 1/256, and slope, shift and thresholds follow from the counts.

Neither the number of tasks nor their order changes the classifier. Scoring covers every word of every text in slices,
with the fixed-size model as the only broadcast.

Defined results: null, empty and word-less texts get the score of a text without any response; null labels are
left out, rows of null doc_id have no label, and of a doc_id labelled twice the larger label holds; labelled rows of the
same id, text and language count once; where a class has no row to be held out, or none that is not, all rows teach and
calibrate; with fewer than two classes to learn from, every score is the share of label 1 (0 without labels); repeated
rows give one result row each; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import words as W
from talkloom.llm.shared import drop_stored, held_out, map_batches, mark_possible, release_memory, sample, stored

BITS, SIZE, WIDTHS, FILTERS = 18, 8, (1, 2, 3), 8
PREFIXES = (4, 6)
PAD = max(WIDTHS) - 1
#: Bytes of labelled texts to a shard.
SHARD_BYTES = 4 << 20


class Cnn(NamedTuple):
    """embed has a zero row at its end for padding; slope and shift calibrate the logit."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: float
    slope: float
    shift: float
    thresholds: dict[str, float]
    common: float = 0.5


def word_ids(piece: W.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The embedding rows of each word, and each text's first word."""
    t = W.words(piece, W.ALNUM)
    spans = [W.FIRST.spans(t.data, t.starts, t.ends)]
    spans += [W.mix(W.FIRST.spans(t.data, t.starts, np.minimum(t.ends, t.starts + k)) + W.U64(k)) for k in PREFIXES]
    return (np.stack(spans, axis=1) >> W.U64(64 - BITS)).astype(np.int32), t.of


def _padded(ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with PAD + 1 padding ids after each text; each text's first place; which places are words."""
    begin = of[:-1] + np.arange(len(of) - 1) * (PAD + 1)
    flat = np.full((len(ids) + (len(of) - 1) * (PAD + 1), 1 + len(PREFIXES)), 1 << BITS, dtype=np.int32)
    at = np.arange(len(ids)) + np.repeat(np.arange(len(of) - 1), np.diff(of)) * (PAD + 1)
    flat[at] = ids
    return flat, begin, at


def _vectors(embed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    total = embed[ids[..., 0]]
    for j in range(1, ids.shape[-1]):
        total += embed[ids[..., j]]
    return total


def _responses(m: Cnn, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each filter's response at each place, 0 where no word begins or the filter is silent."""
    x, made = _vectors(m.embed, flat), np.zeros((len(flat), len(m.bias)), dtype=np.float32)
    for i, (w, f) in enumerate(zip(WIDTHS, m.filters, strict=True)):
        cols = slice(i * FILTERS, (i + 1) * FILTERS)
        total = np.zeros((len(flat), FILTERS), dtype=np.float32)
        for j in range(w):
            total[: len(flat) - j] += x[j:] @ f[j]
        made[at, cols] = np.maximum(total[at] + m.bias[cols], 0)
    return made


def logits(m: Cnn, ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    flat, begin, at = _padded(ids, of)
    if not len(begin):
        return np.zeros(0)
    return np.maximum.reduceat(_responses(m, flat, at), begin, axis=0).astype(np.float64) @ m.out + m.base


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic slope and shift by Newton steps with a small ridge."""
    ab = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(25):
        p = _sigmoid(design @ ab)
        grad = design.T @ (weight * (y - p)) - 0.02 * (ab - [1.0, 0.0])
        ab = ab + np.linalg.solve((design * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ design + 0.02 * np.eye(2), grad)
    return max(0.05, float(ab[0])), float(ab[1])


def _best_threshold(score: np.ndarray, y: np.ndarray, count: np.ndarray) -> float:
    """The cut of the best F1 of scores that occur `count` times: the middle between the last score taken and the next."""
    order = np.argsort(-score, kind="stable")
    hit, taken = np.cumsum((y * count)[order]), np.cumsum(count[order])
    last = np.append(np.diff(score[order]) != 0, True)
    f1 = np.where(last, 2 * hit / (taken + max(1, hit[-1])), -1)
    k = int(f1.argmax())
    return float((score[order][k] + (score[order][k + 1] if k + 1 < len(y) else 0)) / 2)


def started(seed: int = 7) -> tuple[Cnn, list[np.ndarray]]:
    """A classifier that has learnt nothing, and the squared steps of its arrays."""
    rng = np.random.default_rng(seed)
    n = len(WIDTHS) * FILTERS
    table = rng.normal(0, 0.02, ((1 << BITS) + 1, SIZE)).astype(np.float32)
    filters = [rng.normal(0, 0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    m = Cnn(table, filters, np.zeros(n, dtype=np.float32), rng.normal(0, 0.3, n), 0.0, 1.0, 0.0, {})
    m.embed[-1] = 0
    return m, [np.full(a.shape, 1e-4, dtype=np.float32) for a in (m.embed, *filters, m.bias, m.out)]


def learn(m: Cnn, speed: list[np.ndarray], texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 8, rate: float = 0.05, seed: int = 7) -> Cnn:
    """The classifier after steps by batches of hashed texts, weight for each class; arrays of m and speed change in place."""
    rng = np.random.default_rng(seed)
    n = len(WIDTHS) * FILTERS
    embed, filters, bias, out, base = m.embed, m.filters, m.bias, m.out, m.base
    for _ in range(epochs if len(texts) else 0):
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 32)):
            of = np.concatenate([[0], np.cumsum([len(texts[i]) for i in batch])])
            flat, begin, at = _padded(np.concatenate([texts[i] for i in batch]), of)
            m = m._replace(base=base)
            made = _responses(m, flat, at)
            stop = np.append(begin[1:], len(flat))
            top = np.stack([a + made[a:b].argmax(axis=0) for a, b in zip(begin, stop, strict=True)])
            z = made[top, np.arange(n)[None]]
            error = (_sigmoid(z @ out + base) - y[batch]) * weight[y[batch]] / len(batch)
            dz = (error[:, None] * out[None]) * (z > 0)
            grads = [np.zeros_like(f) for f in filters]
            words, backs = [], []
            for i, w in enumerate(WIDTHS):
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                d, t = dz[:, cols], top[:, cols]
                for j in range(w):
                    ids = flat[np.minimum(t + j, len(flat) - 1)]
                    x = _vectors(embed, ids)
                    grads[i][j] = np.einsum("bfs,bf->sf", x, d)
                    words.append(ids.reshape(-1, ids.shape[-1]))
                    backs.append((d[:, :, None] * filters[i][j].T[None]).reshape(-1, SIZE))
            used, back = np.unique(np.concatenate(words), return_inverse=True)
            g, step = np.zeros((len(used), SIZE)), np.concatenate(backs)
            for j in range(1 + len(PREFIXES)):
                np.add.at(g, back.reshape(-1, 1 + len(PREFIXES))[:, j], step)
            g[used == 1 << BITS] = 0
            speed[0][used] += g**2
            embed[used] -= (rate * g / np.sqrt(speed[0][used])).astype(np.float32)
            for a, v, grad in zip([*filters, bias, out], speed[1:], [*grads, dz.sum(axis=0), z.T @ error], strict=True):
                v += (grad**2).astype(v.dtype)
                a -= (rate * grad / np.sqrt(v)).astype(a.dtype)
            base -= rate * float(error.sum())
    return m._replace(base=base)


def _hashed(texts: pa.Array) -> list[np.ndarray]:
    ids = []
    for piece in W.slices(texts):
        of_words, of = word_ids(piece)
        ids += [of_words[a:b] for a, b in zip(of[:-1], of[1:], strict=True)]
    return ids


def _rows_of(m: Cnn, dense: list[np.ndarray]) -> np.ndarray:
    """The classifier's numbers as rows of SIZE: the embeddings, then all others."""
    flat = np.concatenate([np.ravel(a).astype(np.float64) for a in dense])
    return np.concatenate([m.embed, np.resize(np.append(flat, np.zeros(-len(flat) % SIZE)), (-(-len(flat) // SIZE), SIZE))])


def _moved(m: Cnn, ids: np.ndarray, steps: np.ndarray) -> Cnn:
    """The classifier with steps added to its rows."""
    dense = [*m.filters, m.bias, m.out, np.array([m.base])]
    rows = _rows_of(m, dense)
    rows[ids] += steps
    flat, made = rows[len(m.embed) :].ravel(), []
    for a in dense:
        made.append(flat[: a.size].reshape(a.shape).astype(a.dtype))
        flat = flat[a.size :]
    return m._replace(embed=rows[: len(m.embed)].astype(np.float32), filters=made[:-3], bias=made[-3], out=made[-2], base=float(made[-1][0]))


def _pass(shards: DataFrame, m: Cnn, speed: list[np.ndarray], weight: np.ndarray, seed: int) -> Cnn:
    """The classifier after every shard has learnt from its rows, each from m on: a row of numbers moves by the mean step
    of the shards that moved it. Steps are summed as whole numbers, so that their order doesn't matter."""
    held = shards.sparkSession.sparkContext.broadcast((m, speed))

    def steps(batch: pa.RecordBatch):
        ids, moves = [], []
        for rows in batch.column(0):
            of, (start, fast) = _by_hash(rows.values), held.value
            own = [i for i, known in enumerate(of["held"].to_pylist()) if not known]
            texts = _hashed(of["text"].take(pa.array(own, pa.int64())))
            mine = start._replace(embed=start.embed.copy(), filters=[f.copy() for f in start.filters], bias=start.bias.copy(), out=start.out.copy())
            after = learn(mine, [v.copy() for v in fast], texts, of["y"].to_numpy()[own].astype(np.int64), weight, 1, seed=seed)
            gone = _rows_of(after, [*after.filters, after.bias, after.out, np.array([after.base])])
            gone -= _rows_of(start, [*start.filters, start.bias, start.out, np.array([start.base])])
            ids.append(np.flatnonzero((gone != 0).any(axis=1)))
            moves.append(np.round(gone[ids[-1]] * 2.0**32).astype(np.int64))
        moves = np.concatenate(moves)
        return pa.table({"id": np.concatenate(ids).astype(np.int32)} | {f"d{k}": moves[:, k] for k in range(SIZE)})

    made = map_batches(shards, steps, "id int, " + ", ".join(f"d{k} long" for k in range(SIZE)))
    mean = made.groupBy("id").agg(*[(F.sum(f"d{k}") / F.count("*") / 2.0**32).cast("float").alias(f"d{k}") for k in range(SIZE)])
    got = mean.toArrow()  # at most a row of SIZE numbers for each of the classifier's
    held.destroy()
    return _moved(m, got["id"].to_numpy(), np.stack([got[f"d{k}"].to_numpy() for k in range(SIZE)], axis=1).astype(np.float64))


def _by_hash(rows: pa.StructArray) -> dict[str, pa.Array]:
    """The fields of a shard's rows, in the order of their hashes."""
    order = pa.array(np.lexsort((rows.field("i").to_numpy(zero_copy_only=False), rows.field("h").to_numpy(zero_copy_only=False))))
    return {c: rows.field(c).take(order) for c in ("text", "lang", "y", "held")}


def _calibration(shards: DataFrame, m: Cnn, share: float, all_rows: bool) -> Cnn:
    """m with its slope, shift and thresholds, from the logits of the rows held out, counted in steps of 1/256."""
    held = shards.sparkSession.sparkContext.broadcast(m)

    def raw(batch: pa.RecordBatch):
        parts = []
        for rows in batch.column(0):
            of = _by_hash(rows.values)
            own = [i for i, known in enumerate(of["held"].to_pylist()) if known or all_rows]
            some = {c: of[c].take(pa.array(own, pa.int64())) for c in of}
            got = np.concatenate([np.zeros(0), *[logits(held.value, *word_ids(piece)) for piece in W.slices(some["text"])]])
            parts.append(pa.table({"lang": some["lang"], "y": some["y"], "at": np.round(np.clip(got, -30, 30) * 256).astype(np.int32)}))
        return pa.concat_tables(parts)

    # A row for each language, class and step.
    got = map_batches(shards, raw, "lang string, y int, at int").groupBy("lang", "y", "at").count().orderBy("lang", "y", "at").toArrow()
    held.destroy()
    x, y, n = got["at"].to_numpy() / 256, got["y"].to_numpy().astype(float), got["count"].to_numpy()
    lang = got["lang"].to_pylist()
    weight = np.where(y == 1, share / max(1, n[y == 1].sum()), (1 - share) / max(1, n[y == 0].sum())) * n.sum() * n
    slope, shift = _calibrated(x, y, weight)
    score, cuts = _sigmoid(slope * x + shift), {}
    for name in sorted({z for z, hit in zip(lang, y, strict=True) if z is not None and hit}):
        at = np.array([z == name for z in lang])
        cuts[name] = _best_threshold(score[at], y[at], n[at])
    return m._replace(slope=slope, shift=shift, thresholds=cuts, common=_best_threshold(score, y, n))


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", lang: str = "lang", per_class: int = 2500, class_bytes: int = 4 << 20, passes: int = 2
) -> Cnn:
    """Learns from every labelled document; per_class and class_bytes bound what the driver begins with."""
    known = labels.select(F.col("doc_id").alias("i"), F.col(label).cast("int").alias("y")).filter("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0] or 0.0
    rows = docs.select(F.col("doc_id").alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang"))
    total = rows.select("i", F.octet_length("text").cast("long").alias("size")).join(known, "i", "left_semi").agg(F.sum("size")).first()[0] or 0
    n_shards = max(1, -(-total // SHARD_BYTES))
    rows = mark_possible(rows.withColumnRenamed("i", "doc"), F.xxhash64("doc"), known.select(F.xxhash64("i"))).filter("possible")
    rows = rows.select(F.col("doc").alias("i"), "text", "lang", F.xxhash64("doc", "text").alias("h"))
    place = F.pmod("h", F.lit(n_shards)).alias("shard")
    # Texts move once: labels go to the shards that hold their ids.
    marks = rows.select("i", place).distinct().join(known, "i").groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("i", "y"))).alias("of"))
    texts = rows.groupBy(place).agg(F.collect_set(F.struct("i", "h", "text", "lang")).alias("rows"))
    held = lambda x: F.pmod(F.xxhash64(x["i"], F.lit(7)), F.lit(5)) == 0
    marked = F.transform("rows", lambda x: F.struct(*[x[c].alias(c) for c in ("i", "h", "text", "lang")], F.try_element_at("of", x["i"]).alias("y"), held(x).alias("held")))
    dealt = stored(texts.join(marks, "shard").select(F.filter(marked, lambda x: x["y"].isNotNull()).alias("rows")), "labelled")
    counts = {(r.y, r.held): r["count"] for r in dealt.select(F.inline("rows")).groupBy("y", "held").count().collect()}
    m, speed = started()
    if len({y for y, _ in counts}) < 2:
        drop_stored(dealt)
        return m._replace(embed=m.embed * 0, out=m.out * 0, base=float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    shards, all_rows = dealt, len(counts) < 4
    if all_rows:
        shards = dealt.select(F.transform("rows", lambda x: x.withField("held", F.lit(False))).alias("rows"))
        counts = {(y, False): sum(n for (z, _), n in counts.items() if z == y) for y in (0, 1)}
    weight = np.array([0.5 * (counts[0, False] + counts[1, False]) / counts[y, False] for y in (0, 1)])
    each = shards.select(F.inline("rows")).filter("not held")
    found = sample(each.select("i", "text", "y"), "y", per_class, class_bytes).orderBy("i", "text").toArrow()
    y = found["y"].to_numpy().astype(np.int64)
    own = len(y) * 0.5 / np.maximum(1, np.bincount(y, minlength=2))
    m = learn(m, speed, _hashed(found["text"].combine_chunks()), y, own)
    release_memory()
    for k in range(passes):
        m = _pass(shards, m, speed, weight, k)
    m = _calibration(shards, m, float(share), all_rows)
    drop_stored(dealt)
    release_memory()
    return m


def score_toxicity(docs: DataFrame, model: Cnn, text: str = "text", lang: str | None = None) -> DataFrame:
    """doc_id, score, and flagged: the score reaches the threshold of the row's language (where `lang` names
    that column), else the common one."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch):
        m = held.value
        raw = np.concatenate([logits(m, *word_ids(piece)) for piece in W.slices(batch.column(2))])
        return pa.table({"doc_id": batch.column(0), "lang": batch.column(1), "score": np.round(_sigmoid(m.slope * raw + m.shift), 6)})

    of = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    out = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), of.alias("lang"), F.col(text).cast("string").alias("text")), rows, "doc_id long, lang string, score double")
    pairs = [F.lit(x) for kv in model.thresholds.items() for x in kv]
    common = F.lit(model.common)
    cut = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("lang")), common) if pairs else common
    return out.select("doc_id", "score", (F.col("score") >= cut).alias("flagged"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    found = score_toxicity(docs, train(docs.filter(~held_out()), labels), lang="lang")
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "flagged")
