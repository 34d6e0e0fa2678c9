"""Hole sizes along a wellbore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreline.functions import blocks as B
from boreline.functions import geometry as G
from boreline.functions.joins import interval_join

DEPTH_TOLERANCE = 1e-6
INCH = 0.0254


def hole_intervals(parts: DataFrame, wellheads: DataFrame) -> DataFrame:
    """Depth intervals of constant hole radius from the wellbore architecture.

    ``parts``: bore_id, section, kind, pos, top_md, length, diameter with kinds ``surface`` (stacked upward from the
    wellhead), ``casing`` (one row per casing section: its top and length), ``size`` (hole sizes from the casing top
    down), ``element`` (casing elements) and ``open`` (hole sizes below the section).  ``wellheads``: bore_id,
    wellhead_md.  A lone size without length takes the length of its casing section.
    """
    defined = F.when(G.is_defined("length") & (F.col("length") > 0), F.col("length"))
    parts = parts.withColumn("length", defined).withColumn("_radius", G.radius_from_diameter("diameter"))

    surface = parts.filter((F.col("kind") == "surface") & F.col("length").isNotNull()).join(wellheads, "bore_id")
    down = Window.partitionBy("bore_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("bore_id")
    surface = surface.withColumn(
        "end_md", F.col("wellhead_md") - F.sum("length").over(whole) + F.sum("length").over(down)
    )

    section = ["bore_id", "section"]
    casing = parts.filter(F.col("kind") == "casing").select(
        *section, F.col("top_md").alias("_top"), F.col("length").alias("_section_length")
    )
    casing = casing.filter(G.is_defined("_top"))
    sizes = parts.filter(F.col("kind") == "size").join(casing, section)
    alone = F.count(F.lit(1)).over(Window.partitionBy(*section)) == 1
    sizes = sizes.withColumn("length", F.coalesce("length", F.when(alone, F.col("_section_length"))))
    sizes = sizes.filter("length IS NOT NULL")
    down = Window.partitionBy(*section).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("end_md", F.col("_top") + F.sum("length").over(down))

    elements = parts.filter(F.col("kind") == "element").groupBy(*section).agg(F.sum("length").alias("_element_length"))
    sized = sizes.groupBy(*section).agg(F.max("end_md").alias("_sized_end"))
    start = casing.join(elements, section, "left").join(sized, section, "left").select(
        *section,
        F.coalesce(
            F.col("_top") + F.col("_element_length"),
            F.col("_top") + F.col("_section_length"),
            F.col("_sized_end"),
            F.col("_top"),
        ).alias("_open_top"),
    )
    hole = parts.filter((F.col("kind") == "open") & F.col("length").isNotNull() & F.col("_radius").isNotNull())
    hole = hole.join(start, section).withColumn("end_md", F.col("_open_top") + F.sum("length").over(down))

    def interval(df: DataFrame) -> DataFrame:
        return df.select(
            "bore_id", "kind", (F.col("end_md") - F.col("length")).alias("start_md"), "end_md",
            F.col("_radius").alias("radius"),
        )

    every = B.stack(["bore_id"], interval(surface), interval(sizes), interval(hole))
    return every.filter("radius IS NOT NULL AND end_md > start_md")


def fill_hole_radius(stations: DataFrame, intervals: DataFrame, key: str = "bore_id") -> DataFrame:
    """Add ``hole_radius``: the widest interval holding the station's depth, null outside all of them."""
    points = stations.select(key, "seq", "md")
    hit = interval_join(points, intervals.select(key, "start_md", "end_md", "radius"), [key], tolerance=DEPTH_TOLERANCE)
    widest = hit.groupBy(key, "seq").agg(F.max("radius").alias("hole_radius"))
    return stations.join(widest, [key, "seq"], "left")


def hole_radius_coverage(stations: DataFrame, key: str = "bore_id") -> DataFrame:
    return stations.groupBy(key).agg(
        F.count_if(G.is_defined("hole_radius")).alias("filled"), F.count(F.lit(1)).alias("total")
    )


def similar_name_key(name: str = "name"):
    """Name without the tokens that mark variants of one well: separators dropped, upper case."""
    tokens = F.split(F.col(name), "[ _-]+")
    kept = F.filter(tokens, lambda t: ~F.upper(t).isin("MIA", "EXTRAPOLATED") & (F.trim(t) != ""))
    return F.upper(F.array_join(F.transform(kept, lambda t: F.trim(t)), ""))


def radius_by_similar_name(paths: DataFrame, architectures: DataFrame) -> DataFrame:
    """The wellbore whose architecture each path uses: its own, else that of the first path of a similar name.

    ``paths``: traj_id, bore_id, name.  ``architectures``: bore_id of wellbores that have one.
    """
    have = architectures.select("bore_id").distinct().withColumn("_has", F.lit(True))
    df = paths.withColumn("_key", similar_name_key()).join(have, "bore_id", "left")
    donors = df.filter("_has AND _key <> ''").groupBy("_key").agg(
        F.min(F.struct("traj_id", "bore_id")).alias("_donor")
    )
    df = df.join(donors, "_key", "left")
    borrowed = F.when(F.col("_donor.traj_id") != F.col("traj_id"), F.col("_donor"))
    own = F.col("_has")
    return df.select(
        "traj_id",
        "bore_id",
        F.when(own, F.col("bore_id")).otherwise(borrowed["bore_id"]).alias("architecture_bore_id"),
        F.when(own, F.lit(None)).otherwise(borrowed["traj_id"]).alias("borrowed_from"),
    )


def casing_size(od: Column) -> Column:
    return F.concat(F.format_number(od / INCH, 3), F.lit(" in"))


def casing_annotation(prefix: str, od: Column) -> Column:
    """``prefix`` with the casing size in inches where it is known."""
    return F.concat_ws(" ", F.lit(prefix), casing_size(od))


def internal_depths(parts: DataFrame, wellheads: DataFrame, first_and_last: DataFrame) -> DataFrame:
    """Depths that deserve a station of their own: bore_id, depth, annotation.

    First and last survey, every casing shoe, the casing hanger (named after the section whose top is nearest) and
    every change of outer diameter between casing elements.  Depths that agree to 1e-6 are one row with the first
    annotation given.  ``wellheads``: bore_id, hanger_md.  ``first_and_last``: bore_id, start_md, end_md.
    """
    section = ["bore_id", "section"]
    plain = F.lit(None).cast("string")
    ends = first_and_last.select(
        "bore_id", F.inline(F.array(
            F.struct(F.col("start_md").alias("depth"), plain.alias("annotation"), F.lit(0).alias("rank")),
            F.struct(F.col("end_md").alias("depth"), plain.alias("annotation"), F.lit(1).alias("rank")),
        ))
    )
    elements = parts.filter(F.col("kind") == "element")
    od = elements.filter("diameter IS NOT NULL").groupBy(*section).agg(F.min_by("diameter", "pos").alias("_od"))
    casing = parts.filter(F.col("kind") == "casing").select(*section, "top_md", "length").join(od, section, "left")
    shoes = casing.select(
        "bore_id",
        (F.col("top_md") + F.col("length")).alias("depth"),
        casing_annotation("Casing shoe", F.col("_od")).alias("annotation"),
        F.lit(2).alias("rank"),
    )
    near = F.struct(F.abs(F.col("top_md") - F.col("hanger_md")), F.col("section"))
    hangers = (
        wellheads.filter("hanger_md IS NOT NULL")
        .join(casing, "bore_id", "left")
        .groupBy("bore_id", F.col("hanger_md").alias("depth"))
        .agg(F.min_by(F.struct("_od"), near).alias("_nearest"))
        .select("bore_id", "depth", casing_annotation("Casing hanger", F.col("_nearest._od")).alias("annotation"),
                F.lit(3).alias("rank"))
    )
    down = Window.partitionBy(*section).orderBy("pos")
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    stack = elements.join(casing.select(*section, F.col("top_md").alias("_top")), section, "left")
    stack = stack.select(
        "bore_id",
        (F.coalesce("_top", F.lit(0.0)) + F.coalesce(F.sum("length").over(above), F.lit(0.0))).alias("depth"),
        F.last("diameter", ignorenulls=True).over(above).alias("_before"),
        F.col("diameter").alias("_here"),
    )
    changes = stack.filter(F.abs(F.col("_before") - F.col("_here")) >= 1e-9).select(
        "bore_id", "depth",
        F.concat(F.lit("Casing size "), casing_size(F.col("_before")), F.lit(" x "), casing_size(F.col("_here"))).alias(
            "annotation"
        ),
        F.lit(4).alias("rank"),
    )
    every = B.stack(["bore_id"], ends, shoes, hangers, changes).filter(G.is_defined("depth"))
    given = F.when(F.trim("annotation") != "", F.col("rank"))
    return (
        every.groupBy("bore_id", F.round(F.col("depth") / DEPTH_TOLERANCE).alias("_q"))
        .agg(F.min_by("depth", "rank").alias("depth"), F.min_by("annotation", given).alias("annotation"))
        .select("bore_id", "depth", "annotation")
    )
