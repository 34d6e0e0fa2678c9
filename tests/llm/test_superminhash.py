"""SuperMinHash groups against brute force, and the signatures as estimates of similarity."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest

from boreline.llm import superminhash


def shingles(text):
    words = corpus.spaced(text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def grouped(rows, percent=85):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    lowest = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            lowest[find(k)].append(i)
    return Counter((i, len(s), (min(lowest[find(k)], default=None)) if s else i) for k, ((i, *_), s) in enumerate(zip(rows, sets, strict=True)))


def found(table, **options):
    return Counter(map(tuple, superminhash.group_documents(table, **options).select("doc_id", "n_shingles", "component_id").collect()))


@pytest.mark.parametrize("percent", [85, 60])
def test_groups(docs, rows, percent):
    options = {} if percent == 85 else {"percent": percent, "bands": 60, "rows": 3}
    assert found(docs, **options) == grouped(rows, percent)


def test_chain_and_large_group(spark):
    """A chain of texts each of which links with the next only, and many near copies of one text."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = [(1000 - k, " ".join(words[6 * k : 6 * k + 100]), "en", "s") for k in range(40)]
    base = corpus.prose(rng, 12).split(" ")
    for k in range(250):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
        rows.append((2000 + k, " ".join(own), "en", "s"))
    assert found(corpus.frame(spark, rows, 5)) == grouped(rows)


def test_without_links(spark, empty):
    assert superminhash.group_documents(empty).count() == 0
    rows = [(3, None, None, None), (4, "", None, None), (None, " \n", None, None), (5, "one", None, None), (6, "two", None, None), (None, "three", None, None)]
    assert found(corpus.frame(spark, rows)) == grouped(rows)


def test_query_marks_one_of_each_group(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = superminhash.op12_near_copies(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = grouped(rows)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


@pytest.mark.parametrize("size", [1, 30, 400])
def test_signatures_estimate_similarity(size):
    rng = np.random.default_rng(size)
    wrong = []
    for _ in range(60):
        common, own = rng.integers(0, 1 << 63, size, np.uint64), rng.integers(0, 1 << 63, max(1, size // 4), np.uint64)
        signed = superminhash.signatures([common, np.concatenate([common, own]), common[::-1].copy(), np.empty(0, np.uint64)], 192)
        assert (signed[0] == signed[2]).all() and (signed[3] == ~np.uint64(0)).all() and (signed[:3] < ~np.uint64(0)).all()
        wrong.append((signed[0] == signed[1]).mean() - len(common) / (len(common) + len(own)))
    likely = size / (size + max(1, size // 4))
    assert abs(np.mean(wrong)) < 0.02
    # Less spread than that of independent draws.
    assert np.std(wrong) < 1.15 * (likely * (1 - likely) / 192) ** 0.5


def test_signature_is_the_least_offer():
    """Each place holds the least of the offers of all elements, without early stopping."""
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 1 << 63, 5, np.uint64)
    alone = superminhash.signatures([elements[k : k + 1] for k in range(5)], 64)
    assert (superminhash.signatures([elements], 64)[0] == alone.min(axis=0)).all()
    assert all(sorted(row >> np.uint64(56)) == list(range(64)) for row in alone)
