"""Blocks of large wells hold a bounded number of rows wherever the positions lie."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from boreline.functions import blocks as B
from boreline.functions import joins


@pytest.mark.parametrize("broadcast", [B.CUTS_TO_BROADCAST, 0])
def test_blocks_are_bounded_by_count(spark, monkeypatch, broadcast):
    monkeypatch.setattr(B, "CUTS_TO_BROADCAST", broadcast)
    rows = [(1, k) for k in range(1000)] + [(2, 10**9)] + [(3, 10**6 + k * k) for k in range(333)] + [(4, k) for k in range(9)]
    rows += [(5, 10**12)] + [(5, k) for k in range(700)]
    df = spark.createDataFrame(rows, "bore_id long, seq long")
    split = B.split_large_wells(df, ["bore_id"], "seq", 10)
    assert split.count() == len(rows)
    assert split.groupBy("bore_id", B.BLOCK).count().agg(F.max("count")).first()[0] <= 10
    # blocks follow each other
    edges = split.groupBy("bore_id", B.BLOCK).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).toPandas()
    for _, well in edges.sort_values(B.BLOCK).groupby("bore_id"):
        assert (well.lo.to_numpy()[1:] > well.hi.to_numpy()[:-1]).all()
    assert not B.is_split(B.split_large_wells(df, ["bore_id"], "seq", 1000))


def test_climb_goes_on_until_every_path_is_closed(spark):
    chain = spark.createDataFrame([(k, k + 1 if k < 1500 else None) for k in range(1501)], "id long, up long")
    longest = joins.climb(chain, "id", "up").agg(F.max(F.size("path")), F.bool_or("cyclic")).first()
    assert tuple(longest) == (1501, False)
