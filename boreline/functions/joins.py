"""Depth joins: bracket a depth between two stations, match a depth to intervals, climb a parent chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreline.functions import blocks as B


def bracket(points: DataFrame, segments: DataFrame, keys: Sequence[str], md: str = "md") -> DataFrame:
    """Attach to each point the segment of its well with the greatest start depth at or above it.

    ``segments`` has columns ``a_*`` and ``b_*``.  Points and segments are unioned and carried forward in depth order:
    one shuffle on the well, linear work, no range join.  Points above the first segment get nulls; the caller checks
    the end depth.
    """
    fields = [c for c in segments.columns if c[:2] in ("a_", "b_")]
    rest = [c for c in points.columns if c not in keys and c != B.BLOCK]
    carried = F.struct(*[F.col(c) for c in fields])
    types = points.schema
    left = points.select(
        *keys, F.col(md).alias("_at"), F.lit(1).alias("_side"), F.struct(*rest).alias("_point"),
        F.lit(None).cast(segments.select(carried).schema[0].dataType).alias("_seg"),
    )
    right = segments.select(
        *keys, F.col("a_md").alias("_at"), F.lit(0).alias("_side"),
        F.lit(None).cast(points.select(F.struct(*rest)).schema[0].dataType).alias("_point"), carried.alias("_seg"),
    )
    both = left.unionByName(right)
    order = ["_at", "_side"]
    if B.is_split(points) or B.is_split(segments):
        both = B.durable(both.withColumn("_metre", F.floor("_at").cast("bigint")))
        both = B.split_large_wells(both, keys, "_metre").drop("_metre")
    both = B.stack(keys, both)
    both = with_last(both, keys, order, "_seg", "_found")
    hit = both.filter("_side = 1")
    out = hit.select(*keys, *[F.col("_point")[c].alias(c) for c in rest], *[F.col("_found")[c].alias(c) for c in fields])
    return out.select(*[c for c in types.names if c != B.BLOCK], *fields)


def with_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """Carry forward the last non-null ``column``, this row included."""
    block = [B.BLOCK] if B.is_split(df) else []
    window = Window.partitionBy(*keys, *block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn(name, F.last(column, ignorenulls=True).over(window))
    if not block:
        return local
    rank = F.when(F.col(column).isNotNull(), F.struct(*order))
    across = Window.partitionBy(*keys).orderBy(B.BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        df.groupBy(*keys, B.BLOCK)
        .agg(F.max_by(column, rank).alias("_end"))
        .select(*keys, B.BLOCK, F.last("_end", ignorenulls=True).over(across).alias("_carry"))
    )
    joined = local.join(carry, [*keys, B.BLOCK])
    return joined.select(*df.columns, F.coalesce(name, "_carry").alias(name))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    bin_length: float = 500.0,
    tolerance: float = 0.0,
    how: str = "inner",
) -> DataFrame:
    """Join points (column md) to the intervals (start_md, end_md, both ends included) that hold them.

    Both sides meet on the well and a depth bin, so a large well spreads over its bins and each point meets only the
    intervals that reach its bin.
    """

    def bin_of(c: Column) -> Column:
        return F.floor(c / bin_length)

    spread = intervals.withColumn(
        "_bin",
        F.explode(F.sequence(bin_of(F.col("start_md") - tolerance), bin_of(F.col("end_md") + tolerance))),
    )
    inside = (F.col("md") >= F.col("start_md") - tolerance) & (F.col("md") <= F.col("end_md") + tolerance)
    binned = points.withColumn("_bin", bin_of(F.col("md"))).alias("p")
    match = F.col("p._bin") == F.col("i._bin")
    for k in keys:
        match = match & (F.col(f"p.{k}") == F.col(f"i.{k}"))
    joined = binned.join(spread.alias("i"), match & inside, how)
    other = [F.col(f"i.{c}") for c in intervals.columns if c not in keys]
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *other)


def climb(nodes: DataFrame, node: str, parent: str, follow_unknown: bool = False) -> DataFrame:
    """Path of ids from every node up its parents, by pointer doubling.

    Each round joins every open path to the path of its end, so a chain of n levels takes log2(n) rounds; they go on
    until every path is closed.  A path that meets itself is cut before the first repeated id.  Returns ``node, path, cyclic, closes`` where ``closes`` says
    that the cycle runs through the node itself.  A parent absent from ``nodes`` ends the path; it is part of it only
    with ``follow_unknown``.
    """
    ids = nodes.select(F.col(node).alias("_node"), F.col(parent).alias("_up"))
    known = ids.select(F.col("_node").alias("_up"), F.lit(True).alias("_known"))
    state = ids.join(known, "_up", "left").select(
        "_node",
        F.when((F.col("_up").isNotNull()) & F.coalesce("_known", F.lit(False)), F.col("_up")).alias("_next"),
        F.when(
            F.lit(follow_unknown) & F.col("_up").isNotNull() & F.col("_known").isNull(), F.array("_node", "_up")
        ).otherwise(F.array("_node")).alias("_path"),
        F.lit(False).alias("_cyclic"),
        F.lit(False).alias("_closes"),
    )
    while True:
        state = B.durable(state)
        if state.filter("_next IS NOT NULL").isEmpty():
            break
        done = state.filter("_next IS NULL")
        upper = state.select(
            F.col("_node").alias("_next"),
            F.col("_next").alias("_u_next"),
            F.col("_path").alias("_u_path"),
            F.col("_cyclic").alias("_u_cyclic"),
        )
        grown = state.filter("_next IS NOT NULL").join(upper, "_next")
        whole = F.concat("_path", "_u_path")
        met = F.size(F.array_distinct(whole)) < F.size(whole)
        over = met | F.col("_u_cyclic")
        grown = grown.select(
            "_node",
            F.when(~over, F.col("_u_next")).alias("_next"),
            F.array_distinct(whole).alias("_path"),
            over.alias("_cyclic"),
            F.array_contains("_u_path", F.col("_node")).alias("_closes"),
        )
        state = done.unionByName(grown)
    return state.select(
        F.col("_node").alias(node),
        F.col("_path").alias("path"),
        F.col("_cyclic").alias("cyclic"),
        F.col("_closes").alias("closes"),
    )
