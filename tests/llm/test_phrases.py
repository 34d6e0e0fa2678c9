"""Phrases against plain counting, and the index against a search for each phrase."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import corpus
import numpy as np
import pyarrow as pa
import pytest

from boreline.llm import phrases


def pieces(rows):
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(corpus.LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            if words:
                yield lang or "und", words


def plain(rows, longest=3, least=10, covered=50, top=2000):
    count, total = defaultdict(Counter), Counter()
    for lang, words in pieces(rows):
        total[lang] += len(words)
        for k in range(1, longest + 1):
            count[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i : i + size]] = max(around[p[i : i + size]], a)
        kept = []
        for p, a in candidates.items():
            if p in around and 100 * around[p] >= covered * a:
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def many(rows):
    rng = random.Random(6)
    made = list(rows)
    for i in range(300):
        text = " ".join(rng.choice("alpha Beta gamma delta éa beta,gamma alpha\tbeta new york. New York City eps! z".split(" ")) for _ in range(rng.randint(0, 60)))
        made.append((20000 + i, text, rng.choice(["en", "de", "und", None]), "s"))
    return made


@pytest.mark.parametrize(("shard", "options"), [
    (4 << 20, {}), (300, {}), (2000, {"top": 5}), (2000, {"longest": 4, "least": 3, "covered": 80}), (4000, {"longest": 2, "least": 1})])
def test_collocations(spark, many, monkeypatch, shard, options):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    monkeypatch.setattr(phrases, "_ROWS_OUT", 50)
    got = phrases.collocations(corpus.frame(spark, many, 4), **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(many, **options)


def test_without_phrases(spark, empty):
    assert phrases.collocations(empty).count() == 0
    rows = [(1, None, "en", "s"), (2, " .,;\n", None, "s"), (3, "one. two, three", "en", "s")]
    assert phrases.collocations(corpus.frame(spark, rows)).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of 4e9 make products of 1.6e19 and, scaled, 1.6e25."""
    many = 4_000_000_000
    counted = spark.createDataFrame([("en", 1, "a", many), ("en", 1, "b", many + 1), ("en", 2, "a b", many - 1)], "lang string, k int, phrase string, f long")
    total = spark.createDataFrame([("en", 3 * many)], "lang string, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: (counted, total))
    (row,) = phrases.collocations(None).collect()
    assert row["score"] == 1_000_000 * (many - 1) ** 2 // (many * (many + 1)) and row["n"] == 3 * many


def test_extensions(spark, many):
    got = {(r["lang"], r["phrase"], r["side"], r["word"]): r["f"] for r in phrases.extensions(corpus.frame(spark, many)).collect()}
    f = defaultdict(Counter)
    for lang, words in pieces(many):
        for k in (2, 3):
            f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    want = {}
    for lang, counts in f.items():
        for p, a in counts.items():
            if a >= 10:
                want[lang, " ".join(p[1:]), "left", p[0]] = a
                want[lang, " ".join(p[:-1]), "right", p[-1]] = a
    assert got == want


def test_intervals_of_both_halves():
    """A phrase's interval has its count in both halves, and both begin where the sorted suffixes do."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcd"), rng.integers(1, 9))) + rng.choice([".", "", " . "]) for _ in range(60)]
    ids, langs, words = phrases.shard_words(pa.array(["x"] * len(texts)), pa.array(texts))
    assert langs.to_pylist() == ["x"] * len(words) and sorted(words.to_pylist()) == list("abcd")
    flat = ids.tolist()

    def starts(sequence, phrase):
        padded = [sequence[i : i + 3] for i in range(len(sequence))]
        shortened = [s[: s.index(0) + 1] if 0 in s else s for s in padded]
        order = sorted(shortened)
        return next(k for k, s in enumerate(order) if s[: len(phrase)] == list(phrase)), sum(s[: len(phrase)] == list(phrase) for s in order)

    shard = phrases.Shard(ids, len(words) + 1, 3)
    single = shard.words()
    for sides in (("left", "left"), ("left", "right"), ("right", "left"), ("right", "right")):
        found = single
        for side in sides:
            found = shard.extend(found, slice(None), side)
            want = Counter(tuple(flat[i : i + found[0].shape[1]]) for i in range(len(flat)) if 0 not in flat[i : i + found[0].shape[1]] and i + found[0].shape[1] <= len(flat))
            assert {tuple(p): n for p, n in zip(found[0].tolist(), found[3].tolist(), strict=True)} == want
        for phrase, low, back, count in zip(found[0].tolist(), *(x.tolist() for x in found[1:]), strict=True):
            assert starts(flat, phrase) == (low, count)
            assert starts(flat[::-1], phrase[::-1]) == (back, count)
