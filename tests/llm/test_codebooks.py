"""Vector codes against plain k-means, and the balls against comparing all entries."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boreline.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, codes string, error int, sums int, ints int, _label int"


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "c", 1, 2, 3, 4) for r in rows], SCHEMA).repartition(partitions)


def plain(rows, parts=16, entries=64, rounds=2):
    """Codes and errors by comparing every part with every entry."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) and abs(x) <= codebooks.LARGEST / 256 for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[row[p] for row in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(part, entry, strict=True)), e) for e, entry in enumerate(books[p])) for p, part in enumerate(row)] for row in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [row[p] for row, near in zip(cut, found, strict=True) if near[p][1] == e]
                if own:
                    books[p][e] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = assign()
    coded = [(i, label, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near)) for (i, _, label), near in zip(kept, found, strict=True)]
    return sorted(coded, key=str), np.array(books)


def vectors(count, width, seed=1):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(9)]
    return [(i * 3, [m + rng.gauss(0, 0.1) for m in rng.choice(middles)], rng.choice([1, 2, None])) for i in range(count)]


ODD = [
    (None, [0.25] * 32, 1), (5000, None, 1), (5001, [], 1), (5002, [0.5] * 31 + [None], 1), (5003, [math.nan] * 32, 1), (5004, [math.inf] * 32, 2),
    (5005, [0.0] * 32, None), (5006, [-0.001] * 32, 1), (5007, [1e30] * 32, 1), (5008, [0.5] * 20, 1), (5009, [65536.0] * 32, 1), (9, [0.125] * 32, 7), (9, [0.125] * 32, 7),
]


@pytest.mark.parametrize(("rows", "entries"), [(vectors(400, 32) + ODD, 64), (vectors(20, 32) * 2, 64), (vectors(150, 30), 7), (vectors(30, 16) + [(7, [0.5], 1)], 64)])
def test_codes(spark, rows, entries, monkeypatch):
    monkeypatch.setattr(codebooks, "CELLS", 1000)
    want, books = plain(rows, entries=entries)
    found, got_books = codebooks.compress(frame(spark, rows), entries=entries)
    assert sorted(map(tuple, found.select("vec_id", "label", "code", "error").collect()), key=str) == want
    assert (got_books == books).all()


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1), (2, [math.nan], 2)]):
        found, books = codebooks.compress(frame(spark, rows, 1))
        assert found.columns == ["vec_id", "label", "code", "error"] and found.count() == 0 and books.shape[1] == 0


def test_query(spark, tmp_path):
    rows = vectors(120, 64) + [(4000 + i, [0.5] * 64, 3) for i in range(50)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, books = plain(rows)
    sums = {label: sum(r[3] for r in want if r[1] == label) for label in {r[1] for r in want}}
    got = codebooks.op11_vector_codes(spark, str(tmp_path)).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == sorted(((i, c, e, sums[label]) for i, label, c, e in want), key=str)
    assert {r["codebooks_sha256"] for r in got} == {codebooks.codebooks_sha256(books)}


def test_balls_meet_few_entries():
    """Equal to comparing all, ties to the lower index, from any first guess."""
    rng = np.random.default_rng(4)
    entries = rng.integers(-6, 6, (40, 3))
    entries[7] = entries[30]
    parts = rng.integers(-8, 8, (3000, 3))
    ball = codebooks.Ball(entries)
    every = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    for own in (np.zeros(3000, np.int64), ball.guess(parts), every.argmin(axis=1), np.full(3000, 39)):
        best, distance = ball.nearest(parts, own)
        assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert not ball.nearest(entries[:0], np.zeros(0, np.int64))[0].size


def test_large_sums_are_exact(spark):
    rows = [(i, [65535.99609375 - (i % 2)] * 16, 1) for i in range(3000)]
    found, _ = codebooks.compress(frame(spark, rows), entries=1)
    want, _ = plain(rows, entries=1)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert found.agg(F.sum("error")).first()[0] == sum(r[3] for r in want)
