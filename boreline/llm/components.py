"""Connected components of a graph of links, as joins and aggregations over the table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreline.functions.blocks import durable


def components(links: DataFrame) -> DataFrame:
    """node and its root, the least node it is linked with, over all nodes of ``links`` (a, b) but the roots themselves.

    Large and small stars in turn: each node's larger neighbours, then its smaller ones, are linked to the least of them
    all, until every node hangs on its root.  The number of rounds grows with the logarithm of the longest path.
    """
    stars = durable(links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).filter("node <> root").distinct())
    mark = None
    while True:
        both = stars.unionByName(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("least"))
        least = least.select("node", F.least("node", "least").alias("least"))
        large = both.join(least, "node").filter("root > node").select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(least, "node").filter("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        stars = durable(small.unionByName(least.withColumnRenamed("least", "root")).distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == mark:
            return stars
        mark = now
