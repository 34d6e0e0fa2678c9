"""Language identification, quality scores and context trees: held-out accuracy, exact values and odd inputs."""

from __future__ import annotations

import math
import random
from collections import Counter

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from boreline.llm import contexts, languages, quality, text

SYLLABLES = {"en": "the and ing er on tion re th ha", "de": "und sch ein keit ung ge ver ber", "fr": "que eau les oi ment des ai eux", "eo": "kaj estas ojn la vi ĉi as"}


def spoken(rng, lang, words):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def many():
    rng = random.Random(8)
    rows = []
    for i in range(400):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, spoken(rng, lang, rng.randint(5, 80)), None if i % 17 == 0 else lang, "s"))
    return rows


def test_languages_held_out(spark, many):
    table = corpus.frame(spark, many)
    filters = languages.learn_filters(table.filter(~languages.held_out()))
    assert sorted(filters.languages) == sorted(SYLLABLES) and filters.languages[0] == Counter(lang for i, _, lang, _ in many if lang and corpus.fold(i, 4) != 2).most_common(1)[0][0]
    found = {r["doc_id"]: r for r in languages.predict_languages(table, filters).collect()}
    tried = [(i, lang) for i, _, lang, _ in many if lang and corpus.fold(i, 4) == 2]
    assert sum(found[i]["lang_pred"] == lang for i, lang in tried) >= 0.98 * len(tried)
    assert all(0 <= r["lang_score"] <= 1 for r in found.values())
    again = languages.predict_languages(corpus.frame(spark, many, 7), languages.learn_filters(corpus.frame(spark, many, 5).filter(~languages.held_out())))
    assert {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in again.collect()} == {i: (r["lang_pred"], r["lang_score"]) for i, r in found.items()}


def test_languages_of_odd_texts(spark, docs, rows, empty):
    filters = languages.learn_filters(docs)
    found = languages.predict_languages(docs, filters)
    assert found.columns == [*(c for c in docs.columns if c != "lang_pred"), "lang_pred", "lang_score"]
    for r in found.collect():
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == languages.UNKNOWN) == (not has_letter)
        assert has_letter or r["lang_score"] == 0
    assert found.count() == len(rows)
    nothing = languages.learn_filters(empty)
    assert {r["lang_pred"] for r in languages.predict_languages(docs, nothing).collect()} == {languages.UNKNOWN}
    assert languages.predict_languages(empty, filters).count() == 0


def test_filters_hold_what_was_put_in():
    rng = np.random.default_rng(1)
    grams = [(int(k), int(g)) for k, g in zip(rng.integers(0, 11, 4000), rng.integers(0, 1 << 32, 4000), strict=True)]
    own = languages.Filters([f"l{k}" for k in range(11)], grams)
    codes = np.array([g for _, g in grams], np.uint32)
    hits = np.ones((11, len(codes)), bool)
    for slot in languages._probes(codes, own.slots):
        hits &= np.stack([own.bits[k // 8, slot] >> k % 8 & 1 for k in range(11)]).astype(bool)
    assert all(hits[k, i] for i, (k, _) in enumerate(grams))
    truth = np.zeros_like(hits)
    for i, (k, _) in enumerate(grams):
        truth[k, i] = True
    assert hits.sum() - truth.sum() < 0.01 * hits.size
    assert np.all(own.false_rate < 0.02)


def quality_rows(count=500):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(count):
        good = i % 3 != 0
        words = spoken(rng, rng.choice(["en", "de"]), rng.randint(20, 80)).split(" ")
        if not good:
            words = [w + rng.choice(["***", "%%%", " |"]) for w in words] if i % 2 else [words[0]] * len(words)
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_held_out(spark):
    rows, labels = quality_rows()
    table, marks = corpus.frame(spark, rows), spark.createDataFrame([*labels, labels[1], (None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    model = quality.learn_quality(table, marks.filter(~quality.held_out()))
    found = quality.score_quality(table, model)
    assert found.columns == [*(c for c in table.columns if c != "score"), "score", "predicted"]
    got = {r["doc_id"]: r for r in found.collect()}
    tried = [(i, y) for i, y in labels if corpus.fold(i, 4) == 2]
    assert sum(got[i]["predicted"] == y for i, y in tried) >= 0.95 * len(tried)
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())
    again = quality.learn_quality(table.repartition(5), marks.repartition(4).filter(~quality.held_out()))
    assert np.array_equal(model[0], again[0]) and np.array_equal(model[1], again[1])


def test_quality_of_odd_texts(spark, docs, rows, empty):
    none = quality.learn_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    model = quality.learn_quality(docs, spark.createDataFrame([(i, int(i % 2)) for i in range(20)], "doc_id long, quality int"))
    found = quality.score_quality(docs, model).collect()
    assert len(found) == len(rows) and len({r["score"] for r in found if not r["text"]}) == 1
    assert quality.score_quality(empty, model).count() == 0


def test_features_do_not_cross_texts():
    texts = ["ab ab ab", "", "é", "x", "a b", "word"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    sizes = [len(t.encode()) for t in texts]
    ids, first = quality.features(data, np.concatenate([[0], np.cumsum(sizes)]))
    for k, t in enumerate(texts):
        own = np.frombuffer(t.encode(), np.uint8)
        alone, _ = quality.features(own, np.array([0, len(own)]))
        assert alone.tolist() == ids[first[k] : first[k + 1]].tolist()
        assert len(alone) == len(t.split()) + max(0, len(own) - 2)


def base_scores(rows, train):
    counts = Counter()
    for i, t, *_ in rows:
        if train(i):
            counts.update([*corpus.spaced(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t, *_ in rows:
        tokens = [*corpus.spaced(t), None]
        out.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
    return out


def weighted_scores(rows, train):
    """Context-tree weighting node by node, with dictionaries."""
    def choices(data):
        stream = [contexts.END] * contexts.DEPTH + list(data) + [contexts.END]
        for k in range(contexts.DEPTH, len(stream)):
            context, symbol = tuple(stream[k - contexts.DEPTH : k]), stream[k]
            for b in range(8):
                yield context, (1 << b) | symbol >> (8 - b), symbol >> (7 - b) & 1

    counts: dict = {}
    for i, t, *_ in rows:
        if train(i):
            for context, node, bit in choices((t or "").translate(corpus.LOWER).encode()):
                for d in range(contexts.DEPTH + 1):
                    counts.setdefault((context[contexts.DEPTH - d :], node), [0, 0])[bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    below: dict = {}
    weight: dict = {}
    for d in range(contexts.DEPTH, -1, -1):
        for (context, node), (a, b) in counts.items():
            if len(context) == d:
                own = kt(a, b)
                whole = own if d == contexts.DEPTH else np.logaddexp(own, below[context, node]) - math.log(2)
                weight[context, node] = 1.0 if d == contexts.DEPTH else math.exp(own - math.log(2) - whole)
                if d:
                    below[context[1:], node] = below.get((context[1:], node), 0.0) + whole

    def chance(context, node, bit):
        p = None
        for d in range(contexts.DEPTH, -1, -1):
            at = context[contexts.DEPTH - d :], node
            if at in counts:
                a, b = counts[at]
                own = ((b if bit else a) + 0.5) / (a + b + 1)
                p = own if p is None else weight[at] * own + (1 - weight[at]) * p
        return 0.5 if p is None else p

    return [(i, sum(math.log10(chance(*c)) for c in choices((t or "").translate(corpus.LOWER).encode()))) for i, t, *_ in rows]


@pytest.mark.parametrize("block", [contexts.BLOCK_BYTES, 3000])
def test_context_trees(spark, monkeypatch, block):
    monkeypatch.setattr(contexts, "BLOCK_BYTES", block)
    monkeypatch.setattr(contexts, "_SLICE", 2000)
    rows = [r for r in corpus.documents(count=24) if len(r[1] or "") < 5000]
    train = lambda i: i is None or corpus.fold(i, 10) != 0
    found = contexts.score_documents(corpus.frame(spark, rows), F.col("doc_id").isNull() | (text.fold(F.col("doc_id")) % 10 != 0)).collect()
    key = lambda r: (corpus.order(r[0]), *r[1:])
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 3)) for r in found), key=key)
    base, own = base_scores(rows, train), weighted_scores(rows, train)
    want = sorted(((*a[:4], round(a[4], 6), round(b[1], 3)) for a, b in zip(base, own, strict=True)), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) < 1e-5 and abs(g[5] - w[5]) < 2e-3 + 1e-6 * abs(w[5]) for g, w in zip(got, want, strict=True))
    assert all((r["bits_per_byte"] is None) == (abs(r["score"]) > 0 and r["n_tokens"] == 1 and r["bits_per_byte"] is None) for r in found)


def test_context_trees_without_training(spark, docs, rows, empty):
    found = contexts.score_documents(docs, F.lit(None).cast("boolean")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["n_known"] == 0 and r["train_tokens"] == 0
    by_id = {r["doc_id"]: r for r in found}
    assert abs(by_id[1013]["score"] + 8 * math.log10(2) * 8) < 1e-4
    assert contexts.score_documents(empty, F.lit(True)).count() == 0


def test_chances_of_all_symbols_add_up():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    keys, _ = contexts.symbols(data, np.array([0, 1000, 3000]))
    found, counts = np.unique(keys, return_counts=True)
    levels = contexts.subtrees(found, counts, 0)
    for key in [*found[::97], found[0] ^ np.uint64(1 << 20), np.uint64(0)]:
        every = (key >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        mixed = contexts.chances(every, levels, contexts.DEPTH, np.full((8, 256), np.nan))
        total = np.where(np.isnan(mixed), 0.5, mixed).prod(axis=0).sum()
        assert abs(total - 1) < 1e-9


def test_log_gamma():
    for x in [0.5, 1, 1.5, 2, 7.9, 8, 100.25, 1e6, 1e12]:
        assert abs(contexts.log_gamma(np.array([x]))[0] - math.lgamma(x)) <= 1e-12 * max(1, abs(math.lgamma(x)))
