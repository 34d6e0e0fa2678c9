"""Set join, components and forest search against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from boreline.llm import components, forest, setjoin


def shingles(text):
    words = corpus.spaced(text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def linked(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("most", [None, 3, 40])
def test_set_join(docs, rows, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(setjoin, "boundary", lambda sizes, length: most)
    sets, roots = linked(rows)
    lowest = defaultdict(list)
    for (i, *_), root in zip(rows, roots, strict=True):
        if i is not None:
            lowest[root].append(i)
    want = Counter((i, len(s), (min(lowest[r]) if lowest[r] else None) if s else i) for (i, *_), s, r in zip(rows, sets, roots, strict=True))
    got = Counter(map(tuple, setjoin.link_documents(docs).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == want


def test_one_of_each_group_stays(docs, rows):
    sets, roots = linked(rows)
    groups = {r for r, s in zip(roots, sets, strict=True) if s}
    kept = setjoin.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len(got) == len(groups) + sum(not s for s in sets)
    firsts = {min((corpus.order(i), i) for (i, *_), r in zip(rows, roots, strict=True) if r == g)[1] for g in groups}
    assert {r["doc_id"] for r in got if shingles(r["text"])} == firsts


def test_near_copies_of_one_text(spark):
    """A group whose members are near each other in chains, and a list that many sets without a link share."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        own = list(words)
        for k in rng.integers(0, 120, rng.integers(0, 4)):
            own[k] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    common = " ".join(f"c{i}" for i in range(12))
    rows += [(100 + i, common + " " + " ".join(f"d{i}_{k}" for k in range(6))) for i in range(40)]
    _, roots = linked(rows)
    lowest = {r: min(i for (i, _), own in zip(rows, roots, strict=True) if own == r) for r in roots}
    got = {r["doc_id"]: r["component_id"] for r in setjoin.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: lowest[r] for (i, _), r in zip(rows, roots, strict=True)}


def test_empty_tables(empty):
    assert setjoin.link_documents(empty).count() == 0
    assert setjoin.keep_one(empty).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def near(vectors, k):
    ids = np.array([i for i, _ in vectors])
    values = np.array([v for _, v in vectors], float)
    cosines = values @ values.T / np.outer(np.linalg.norm(values, axis=1), np.linalg.norm(values, axis=1))
    return {i: [(int(ids[j]), cosines[row, j]) for j in np.lexsort((ids, -cosines[row].round(12))) if ids[j] != i][:k] for row, i in enumerate(ids)}


def test_forest_odd_vectors(spark):
    """Copies, ties, and vectors that take no part; small enough that every leaf is read."""
    rng = np.random.default_rng(3)
    sound = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    sound += [(100 + i, sound[0][1]) for i in range(12)] + [(200, [2 * x for x in sound[1][1]])]
    odd = [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [float("nan")] * 6), (305, [float("inf")] + [0.0] * 5), (306, [1.0, 2.0]), (None, sound[2][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in sound + odd], "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in forest.nearest(table, F.col("vec_id") % 2 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = {i: v for i, v in near(sound, 5).items() if i % 2 == 0}
    assert {i: [a for a, _ in v] for i, v in got.items()} == {i: [a for a, _ in v] for i, v in want.items()}
    assert all(abs(x[1] - y[1]) < 1e-12 for i in want for x, y in zip(got[i], want[i], strict=True))


def test_forest_few_or_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert forest.nearest(none, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert forest.nearest(one, F.lit(True)).count() == 0
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in forest.nearest(two, F.lit(True)).orderBy("query_id").collect()] == [(1, 1, 2), (2, 1, 1)]


def test_forest_recall(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=32).tolist()) for i in range(3000)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    want = {i: {a for a, _ in v} for i, v in near(vectors, 5).items() if i % 50 == 0}
    got = defaultdict(set)
    for r in forest.nearest(table, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert sum(len(want[i] & got[i]) for i in want) / (5 * len(want)) >= 0.9


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(7)
    ruled_out = 0
    for _ in range(400):
        n = int(rng.integers(4, 700))
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        kept = x[: int(n * rng.uniform(0.5, 1.0))]
        y = np.concatenate([kept, rng.integers(0, 1 << 63, int(rng.integers(0, n // 3 + 1))).astype(np.uint64)])
        x, y = np.unique(x), np.unique(y)
        common = len(np.intersect1d(x, y))
        links = 100 * common >= 80 * (len(x) + len(y) - common)
        gone = setjoin._cannot_link(*(np.frombuffer(setjoin._bitmap(s), np.uint8) for s in (x, y)), len(x), len(y))
        assert not (links and gone)
        ruled_out += gone
    assert ruled_out > 150
