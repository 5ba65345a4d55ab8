"""Language, tokens, toxicity, chat and token counts."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkloom.llm import attribution, chat, grammar, language, tokens, toxicity
from talkloom.llm import words as W
from tests.llm.helpers import docs, empty, messy, sentences

P = pytest.importorskip("public_tokenizers")
BPE = P.path("byte_bpe_50k.json")
EN, FR = "the and of that with from this have been were".split(), "le la des que dans pour avec une est sur".split()


def test_words_follow_the_two_patterns():
    import re

    texts = ["Ab c-d É1!  x\x0by", "", "ß z\n\nEnd", None, "\x1fa\x7fb"]
    for kind, pattern in ((W.SPACED, r"[^\x20\x09-\x0D]+"), (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for piece in W.slices(pa.array(texts), 7):
            t = W.words(piece, kind)
            for i in range(piece.hi - piece.lo):
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[piece.lo + i] or "")
                assert [bytes(t.data[a:b]).decode() for a, b in zip(t.starts[t.of[i] : t.of[i + 1]], t.ends[t.of[i] : t.of[i + 1]])] == re.findall(pattern, low)


def test_hashes_tell_words_apart_wherever_they_stand():
    t = W.words(next(W.slices(pa.array(["ab cd ab dc", "cd ab"]))), W.SPACED)
    h = W.FIRST.spans(t.data, t.starts, t.ends)
    assert h[0] == h[2] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 3


def brute_posteriors(e, moves, first):
    n, k = e.shape
    f, b = np.zeros((n, k)), np.ones((n, k))
    f[0] = np.exp(first) * np.exp(e[0])
    for t in range(1, n):
        f[t] = (f[t - 1] @ np.exp(moves)) * np.exp(e[t])
    for t in range(n - 2, -1, -1):
        b[t] = np.exp(moves) @ (np.exp(e[t + 1]) * b[t + 1])
    g = f * b
    return g / g.sum(axis=1, keepdims=True)


def test_features_of_many_words_take_little_memory():
    """Fitting runs on the driver: what it holds beside its sample must be small."""
    import tracemalloc

    from talkloom.llm import language as L

    texts = pa.array([" ".join(f"word{i * 7919 % 1000003}x" for i in range(lo, lo + 1000)) for lo in range(0, 50_000, 1000)])
    t = W.words(next(W.slices(texts, 1 << 30)), W.ALNUM)
    assert (W.FIRST.parts(t.data, t.starts, t.ends, 50) == W.FIRST.spans(t.data, t.starts, t.ends)).all()
    hashes, at, _ = L._distinct(t)
    tracemalloc.start()
    keys, ends = L._features(t, at, hashes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) == 50_000 and peak < 32 << 20
    few, few_ends = L._features(t, at, hashes, 1000)
    assert (keys == few).all() and (ends == few_ends).all()


def test_forward_backward_equals_sums_over_paths():
    rng = np.random.default_rng(0)
    e, moves, first, of = rng.normal(size=(12, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), np.array([0, 5, 5, 6, 12])
    got = language.posteriors(e, of, moves, first)
    for a, b in zip(of[:-1], of[1:]):
        if b > a:
            assert np.allclose(got[a:b], brute_posteriors(e[a:b], moves, first))


def test_language_of_code_switched_text(spark):
    rows = [(i, sentences(i, 80, EN if i % 2 else FR), "en" if i % 2 else "fr", "s") for i in range(40)]
    crf = language.train(docs(spark, rows))
    mixed = docs(spark, [(1, sentences(99, 30, EN) + " " + sentences(98, 60, FR), None, None), (2, sentences(97, 50, EN), "zz", None)])
    got = {r.doc_id: r for r in language.identify(mixed, crf, spans=True).collect()}
    assert got[2].lang_pred == "en" and got[2].score > 0.9 and got[1].lang_pred == "fr" and 0.5 < got[1].score < 0.8
    assert [r.label for r in got[1].runs] == ["en", "fr"] and abs(got[1].runs[0].n - 30) <= 3


def test_language_learns_every_label(spark):
    own = [[f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}{k}" for x in ("qu", "zor", "mel", "tiv", "bas")] for k in range(70)]
    rows = [(i, sentences(i, 40, own[i % 70]), f"l{i % 70:02d}", "s") for i in range(350)]
    rows += [(1000 + i, sentences(i, 40, own[i]), f"l{i:02d}", "s") for i in range(60)]
    new = docs(spark, [(k, sentences(5000 + k, 60, own[k]), None, None) for k in range(70)])
    crf = language.train(docs(spark, rows))
    assert len(crf.labels) == 70 and {r.doc_id: r.lang_pred for r in language.identify(new, crf).collect()} == {k: f"l{k:02d}" for k in range(70)}


def test_training_rows_are_bounded_in_rows_and_bytes(spark):
    from talkloom.llm.shared import sample

    rows = [(1, "often repeated", "en", "s")] * 3000 + [(2, f"row {i} of one id", "en", "s") for i in range(500)]
    rows += [(100 + i, "x" * (1000 + i), "fr", "s") for i in range(50)] + [(900, "y" * 50_000, "de", "s"), (901, "z" * 40_000, "de", "s")]
    d = docs(spark, rows).select(F.col("doc_id").alias("i"), "text", F.col("lang").alias("l"))
    got = sample(d, "l", 250, 20_000).collect()
    by = {k: [r for r in got if r.l == k] for k in ("en", "fr", "de")}
    assert sorted(r.i for r in by["en"]) == [1, 2] and [r.i for r in by["de"]] == [901]
    assert 15 < len(by["fr"]) < 20 and sum(len(r.text) for r in by["fr"]) <= 20_000
    assert len(sample(d, "l", 3, 1 << 30).collect()) == 2 + 3 + 2
    labels = spark.createDataFrame([(1, 1), (2, 0), (105, 0)], "i long, y int")
    assert sorted((r.i, r.y) for r in sample(d.drop("l"), "y", 2, 1 << 30, labels).collect()) == [(1, 1), (2, 0), (105, 0)]
    assert language.train(docs(spark, rows)).labels == ["de", "en", "fr"]
    assert language.train(docs(spark, [(None, "words without an id", "it", "s"), *rows])).labels == ["de", "en", "fr"]


def test_cnn_logits_equal_a_plain_convolution():
    rng = np.random.default_rng(4)
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    table = rng.normal(size=((1 << toxicity.BITS) + 1, toxicity.SIZE)).astype(np.float32)
    table[-1] = 0
    filters = [rng.normal(size=(w, toxicity.SIZE, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    m = toxicity.Cnn(table, filters, rng.normal(size=n).astype(np.float32), rng.normal(size=n), 0.3, 1.0, 0.0, {})
    texts = ["one", None, "some more words, and Words again", "", "é ß two words", sentences(3, 200)]
    piece = next(W.slices(pa.array(texts)))
    ids, of = toxicity.word_ids(piece)
    got = toxicity.logits(m, ids, of)
    for i in range(len(texts)):
        x = [sum(table[k].astype(float) for k in row) for row in ids[of[i] : of[i + 1]]]
        x += [np.zeros(toxicity.SIZE)] * (max(toxicity.WIDTHS) - 1)
        pooled = np.zeros(n)
        for k, (w, f) in enumerate(zip(toxicity.WIDTHS, filters)):
            for c in range(toxicity.FILTERS):
                made = [sum(float(x[p + j] @ f[j, :, c]) for j in range(w)) + float(m.bias[k * toxicity.FILTERS + c]) for p in range(of[i + 1] - of[i])]
                pooled[k * toxicity.FILTERS + c] = max([0.0, *made])
        assert abs(got[i] - (pooled @ m.out + 0.3)) < 1e-3


def test_crf_features_and_predictions_equal_a_plain_version(spark):
    rows = [(i, sentences(i, 60, EN if i % 2 else FR), "en" if i % 2 else "fr", "s") for i in range(20)]
    crf = language.train(docs(spark, rows))
    texts = [sentences(50, 25, EN) + " le la " + sentences(51, 10, FR), "the", "x", "unseen wörds nowhere"]

    def plain_emissions(text):
        out = []
        for word in text.split():
            b = word.encode()
            h = W.FIRST.spans(np.frombuffer(b, dtype=np.uint8), np.array([0]), np.array([len(b)]))[0]
            keys = [int(h)]
            grams = lambda k: [int.from_bytes(b[i : i + k], "big") for i in range(len(b) - k + 1)]  # noqa: B023, E731
            pairs, triples = grams(2), grams(3)
            for kind, values in ((1, pairs), (2, triples), (3, pairs[:1]), (4, triples[:1]), (5, pairs[-1:]), (6, triples[-1:]), (7, grams(1) if len(b) == 1 else [])):
                keys += [int(W.mix(np.array([v | kind << 40], dtype=np.uint64))[0]) for v in values]
            score = sum(crf.weights[k >> (64 - language.BITS)].astype(float) for k in keys)
            at = np.flatnonzero(crf.lexicon == h)
            out.append(score + (crf.weights[(1 << language.BITS) + crf.of_lexicon[at[0]]] if len(at) else 0))
        return np.array(out)

    got = {r.doc_id: r for r in language.identify(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), crf).collect()}
    for i, text in enumerate(texts):
        share = brute_posteriors(plain_emissions(text), crf.moves, crf.first).mean(axis=0)
        assert got[i].lang_pred == crf.labels[share.argmax()] and abs(got[i].score - share.max()) < 1e-3


def test_rounds_of_grammar_go_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(8)
    phrase = rng.integers(0, 500, 64)
    ids = np.concatenate([x for _ in range(60) for x in (phrase[: rng.integers(2, 64)], rng.integers(0, 500, 5))] + [np.full(400, 7)]).astype(np.uint32)
    ends = np.sort(np.append(rng.choice(np.arange(1, len(ids)), 30, replace=False), len(ids)))
    symbols, stops, rules, sizes = grammar.compress(ids, ends, 500)
    assert (grammar.expand(symbols, 500, rules) == ids).all() and sizes.sum() > 0
    last = np.zeros(len(symbols), dtype=bool)
    last[stops - 1] = True
    left = [tuple(x) for x, end in zip(zip(symbols[:-1].tolist(), symbols[1:].tolist()), last[:-1]) if not end]
    assert max(left.count(x) for x in set(left)) < grammar.MIN_COUNT + 3


def test_grammar_takes_as_many_rules_as_there_are_frequent_pairs():
    """More than two bytes can name: 12,000 pairs that occur nine times each, over a base of 60,000 ids."""
    rng = np.random.default_rng(9)
    pairs = rng.permutation(48_000).reshape(-1, 2)[:12_000]
    ids = np.concatenate([np.append(pairs[rng.permutation(len(pairs))], np.arange(len(pairs))[:, None] + 48_000, axis=1).ravel() for _ in range(9)]).astype(np.uint32)
    ends = np.array([len(ids)])
    symbols, stops, rules, sizes = grammar.compress(ids, ends, 60_000)
    assert len(rules) > 65_536 - 60_000 and (grammar.expand(symbols, 60_000, rules) == ids).all()
    key, count = np.unique(symbols[:-1].astype(np.int64) << 32 | symbols[1:], return_counts=True)
    assert count.max() < grammar.MIN_COUNT


def test_language_edges(spark):
    crf = language.train(messy(spark))
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(messy(spark), crf).collect()]
    assert len(got) == 11 and {i for i, lang, _ in got if lang == "und"} == {2, 3, 4, 5} and all(0 <= s <= 1 for _, _, s in got)
    none = language.train(empty(spark))
    assert {r.lang_pred for r in language.identify(messy(spark), none).collect()} == {"und"} and language.identify(empty(spark), crf).count() == 0


def test_toxicity_learns_words_and_keeps_clean_texts(spark):
    bad = ["grumbo", "zlorpy", "vexnit"]
    rows = [(i, sentences(i, 40) + (" " + bad[i % 3] + " " + bad[(i + 1) % 3] + " tail" if i % 4 == 0 else ""), "en" if i % 2 else "fr", "s") for i in range(400)]
    d = docs(spark, rows)
    labels = d.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("toxic"))
    model = toxicity.train(d, labels.filter("doc_id < 300"))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d.filter("doc_id >= 300"), model, lang="lang").collect()}
    right = sum((s >= 0.7) == (i % 4 == 0) for i, s in got.items())
    assert right >= 97


def test_toxicity_edges(spark):
    d = messy(spark)
    labels = spark.createDataFrame([(1, 1), (6, 0), (1, 0), (None, 1), (8, None), (2, 0)], "doc_id long, toxic int")
    for known in (labels, labels.filter("toxic = 0"), labels.filter("false")):
        got = toxicity.score_toxicity(d, toxicity.train(d, known)).collect()
        assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(empty(spark), toxicity.train(empty(spark), labels)).count() == 0


def test_toxicity_learns_from_every_labelled_text(spark, monkeypatch):
    """Of twelve words that only label 1 holds, the few documents that the driver begins with show a part."""
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 1 << 15)
    bad = [2 * c + "zq" + c for c in "bcdfghjklmnp"]
    rows = [(i, sentences(i, 30) + (f" {bad[i // 3 % 12]} tail" if i % 3 == 0 else ""), "en" if i % 2 else None, "s") for i in range(1080)]
    d = docs(spark, rows + rows[:5])
    labels = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("toxic"))
    model, again = (toxicity.train(x, labels, per_class=4, class_bytes=4000) for x in (d.repartition(1), d.repartition(5)))
    fresh = [(i, sentences(5000 + i, 30) + (f" {bad[i]} tail" if i < 12 else ""), None, "s") for i in range(60)]
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs(spark, fresh), model).collect()}
    assert all(got[i].flagged and got[i].score >= 0.7 for i in range(12)) and sum(got[i].score >= 0.7 for i in range(12, 60)) <= 1
    assert (model.embed == again.embed).all() and (model.out == again.out).all() and model[4:] == again[4:]


TEXTS = ["", "a b  c \n\n d e   f", "  lead trail  ", "é à la x y", "tab\t x\r\n y <|endoftext|> z", " ", "　wide　 spaces", "it's we'll 'quoted' x's", "a.b,c;d\ne\n\nf", "日本語 テキスト", "ok!?\n", "x" * 500, "end.\nNext\nThird 12ab34!"] + [sentences(s, 60) for s in range(5)]


def test_encoder_gives_the_librarys_ids():
    enc = tokens.Encoder(BPE)
    want = [e.ids for e in enc.tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
    for size in (1 << 20, 40):
        for _ in range(2):
            got = []
            for piece in W.slices(pa.array(TEXTS), size):
                ids, of = enc.encode(piece)
                got += [ids[a:b].tolist() for a, b in zip(of[:-1], of[1:])]
            assert got == want


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    ids = rng.choice([5, 6, 7, 8, 900], size=5000, p=[0.4, 0.3, 0.2, 0.05, 0.05]).astype(np.uint32)
    ends = np.unique(np.append(rng.integers(1, 5000, 40), 5000))
    symbols, stop, rules, sizes = grammar.compress(ids, ends, 1000)
    assert len(symbols) < 2500 and len(rules) and (grammar.expand(symbols, 1000, rules) == ids).all()
    block = {"ends": stop.astype("<u4").tobytes(), "rules": rules.astype("<u4").tobytes(), "rule_lengths": sizes.astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes(), "width": 4, "base": 1000}
    starts = np.append(0, ends[:-1])
    for d in range(len(ends)):
        whole = ids[starts[d] : ends[d]]
        lo, hi = len(whole) // 3, max(len(whole) // 3, len(whole) - 2)
        assert (grammar.decode_range(block, d, 0, len(whole)) == whole).all() and (grammar.decode_range(block, d, lo, hi) == whole[lo:hi]).all()


def test_token_files_hold_every_document_in_order(spark, tmp_path):
    d = messy(spark)
    grammar.write_tokens(d, str(tmp_path / "t"), BPE)
    got = grammar.token_index(grammar.read_tokens(spark, str(tmp_path / "t"))).orderBy("start").collect()
    enc, at = tokens.Encoder(BPE).tokenizer, 0
    rows = sorted(d.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    for r, g in zip(rows, got):
        ids = np.array([*enc.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    grammar.write_tokens(empty(spark), str(tmp_path / "e"), BPE)
    assert grammar.token_index(grammar.read_tokens(spark, str(tmp_path / "e"))).count() == 0


def test_token_counts_match_the_librarys_offsets(spark):
    enc = tokens.Encoder(BPE).tokenizer
    texts = [t for t in TEXTS if t]
    got = attribution.section_tokens(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), BPE).collect()
    for i, t in enumerate(texts):
        cuts = [0] + [k + 1 for k, c in enumerate(t) if c == "\n"] + [len(t)]
        spans, want = list(zip(cuts[:-1], cuts[1:])), [0] * (len(cuts) - 1)
        for a, b in enc.encode(t, add_special_tokens=False).offsets:
            shared = [min(b, d) - max(a, c) for c, d in spans]
            want[max(range(len(spans)), key=lambda k: (shared[k], -k))] += 1
        assert [r.n_tokens for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)] == want


def test_token_counts_of_given_sections_and_edges(spark):
    d = messy(spark).withColumn("parts", F.when(F.col("doc_id") == 1, F.expr("from_json('[{\"name\":\"a\",\"start\":0,\"end\":5},{\"name\":\"b\",\"start\":3,\"end\":9},null,{\"name\":\"c\",\"start\":90,\"end\":99}]', 'array<struct<name:string,start:int,end:int>>')")))
    rows = attribution.section_tokens(d, BPE, F.col("parts")).collect()
    of1 = {r.section: r for r in rows if r.doc_id == 1}
    assert of1[2].n_tokens == of1[3].n_tokens == 0 and of1[0].n_tokens + of1[1].n_tokens + of1[None].n_tokens == len(tokens.Encoder(BPE).tokenizer.encode("one two three four five six. Seven\neight").ids)
    assert attribution.section_tokens(messy(spark), BPE).filter("doc_id in (2, 3)").agg(F.sum("n_tokens")).first()[0] == 0 and attribution.section_tokens(empty(spark), BPE).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "</s>[INST] ok [/INST]", "<\\s> \\<s>", "a\\\\[INST]\\", "[[INST]]<</s>>\n", "<s>[INST]x[/INST]\ny</s>\n"])
def test_turns_read_back(text):
    made, mask = chat.render("assistant", text)
    assert chat.parse(made) == ("assistant", text) and chat.unescape(made[mask[0][0] : mask[0][1]]) == text
    assert not any(c in made[mask[0][0] : mask[0][1]] for c in chat.CONTROLS)


def test_logs_fold_deltas_edits_and_regenerations(spark):
    log = [(1, 5, 0, "delta", "lo"), (1, 1, 0, "open", "user"), (1, 3, 0, "delta", "hel"), (1, 6, 1, "open", "assistant"), (1, 7, 1, "delta", "bad"), (1, 8, 1, "regenerate", None), (1, 9, 1, "delta", "good"), (1, 10, 0, "edit", "hello!"), (None, 1, 0, "delta", "x"), (2, 1, 0, "odd", "?")]
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, body string")).collect()}
    assert got == {(1, 0): ("user", "hello!"), (1, 1): ("assistant", "good"), (None, 0): ("", "x"), (2, 0): ("", "")}


def test_chats_equal_a_plain_rendering(spark):
    turns = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", "a" * 200 + "é"), (1, 2, "user", None), (1, 3, None, "x"), (1, 4, "assistant", "y\\"), (None, 0, "assistant", "z"), (2, None, "system", "[INST]"), (1, 4, "assistant", "y\\")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("message", F.lit(1)).withColumn("kind", F.lit("k"))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(chat.events_of(df))).collect()}
    for conv in (1, 2, None):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        flat = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256, g.formatted_chars) == (len(own), hashlib.sha256(flat.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.render(r or "", t or "")[0]) for _, _, r, t in own))
    assert chat.digests(chat.format_chats(chat.events_of(df.limit(0)))).count() == 0
