"""Wellbore hierarchy, reference points and the offsets of depth and position references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreline.functions import geometry as G
from boreline.functions.joins import climb


def root_wellbore(bores: DataFrame) -> DataFrame:
    """Topmost wellbore reached by climbing parents while the bore is a sidetrack."""
    up = F.when(F.col("is_sidetrack"), F.col("parent_bore_id")).alias("_parent")
    chains = climb(bores.select("bore_id", up), "bore_id", "_parent")
    root = F.when(F.col("closes"), F.col("bore_id")).otherwise(F.element_at("path", -1))
    return chains.select("bore_id", root.alias("root_bore_id"))


def wellbore_depth_path(bores: DataFrame) -> DataFrame:
    """Number of ancestors and the ``/``-joined names from the root down."""
    chains = climb(bores.select("bore_id", "parent_bore_id"), "bore_id", "parent_bore_id", follow_unknown=True)
    named = (
        chains.select("bore_id", "cyclic", F.posexplode("path").alias("_pos", "_id"))
        .join(bores.select(F.col("bore_id").alias("_id"), F.col("name").alias("_name")), "_id", "left")
        .groupBy("bore_id", "cyclic")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct((-F.col("_pos")).alias("p"), F.coalesce("_name", F.col("_id").cast("string")).alias("n"))
                )
            ).alias("_names")
        )
    )
    depth = F.size("_names") - F.when(F.col("cyclic"), 0).otherwise(1)
    return named.select("bore_id", depth.alias("depth"), F.array_join(F.col("_names.n"), "/").alias("path"))


def slot_table(clusters: DataFrame) -> DataFrame:
    """One row per slot of the cluster's slot map."""
    return clusters.select("cluster_id", F.explode("slots").alias("slot_id", "slot")).select(
        "cluster_id",
        "slot_id",
        F.col("slot.lat.mean").alias("slot_lat"),
        F.col("slot.lat.std").alias("slot_lat_std"),
        F.col("slot.lon.mean").alias("slot_lon"),
        F.col("slot.lon.std").alias("slot_lon_std"),
    )


def wellhead_reference(bores: DataFrame, wells: DataFrame, clusters: DataFrame) -> DataFrame:
    """Reference station of every wellbore through its well, cluster and slot.

    A missing link gives a row with nulls and the ``reason``; a complete chain gives latitude, longitude and the
    reference depth as both measured and vertical depth, with zero inclination and azimuth.
    """
    w = wells.select("well_id", "cluster_id", "slot_id", F.lit(True).alias("_well"))
    c = clusters.select("cluster_id", "field_id", "ref_depth", "slots", F.lit(True).alias("_cluster"))
    df = bores.select("bore_id", "well_id").join(w, "well_id", "left").join(c, "cluster_id", "left")
    df = df.withColumn("_slot", F.try_element_at("slots", F.col("slot_id"))).drop("slots")
    lat, lon, depth = F.col("_slot.lat"), F.col("_slot.lon"), F.col("ref_depth")
    complete = lat["mean"].isNotNull() & lat["std"].isNotNull() & lon["mean"].isNotNull() & lon["std"].isNotNull()
    complete = complete & depth["mean"].isNotNull() & depth["std"].isNotNull()
    reason = (
        F.when(F.col("well_id").isNull(), F.lit("wellbore without well"))
        .when(F.col("_well").isNull() | F.col("cluster_id").isNull() | F.col("slot_id").isNull(),
              F.lit("well missing or without cluster or slot"))
        .when(F.col("_cluster").isNull() | F.col("_slot").isNull() | F.col("field_id").isNull(),
              F.lit("cluster missing or without the slot"))
        .when(~complete, F.lit("slot coordinates not set"))
    )
    df = df.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return df.select(
        "bore_id",
        F.when(good, lat["mean"]).alias("lat"),
        F.when(good, lon["mean"]).alias("lon"),
        F.when(good, lat["std"]).alias("lat_std"),
        F.when(good, lon["std"]).alias("lon_std"),
        F.when(good, depth["mean"]).alias("md"),
        F.when(good, depth["mean"]).alias("tvd"),
        F.when(good, depth["std"]).alias("tvd_std"),
        F.when(good, F.lit(0.0)).alias("inc"),
        F.when(good, F.lit(0.0)).alias("az"),
        "reason",
    )


def wellhead_covariance(reference: DataFrame) -> DataFrame:
    """Diagonal covariance of the wellhead from the deviations of latitude, longitude and depth."""
    lat, lon = F.col("lat"), F.col("lon")
    north = G.north_of(lat + F.col("lat_std")) - G.north_of(lat)
    east = G.east_of(lat, lon + F.col("lon_std")) - G.east_of(lat, lon)
    down = F.col("tvd_std")
    return reference.filter("lat IS NOT NULL").select(
        "bore_id", (north * north).alias("c00"), (east * east).alias("c11"), (down * down).alias("c22")
    )


def slot_lookup(wells: DataFrame, clusters: DataFrame) -> DataFrame:
    """Slot position of every well that names one: in its own cluster, or in any cluster where that is unknown."""
    slots = slot_table(clusters)
    ours = wells.filter("slot_id IS NOT NULL").select("well_id", "cluster_id", "slot_id")
    known = clusters.select("cluster_id", F.lit(True).alias("_known"))
    ours = ours.join(known, "cluster_id", "left")
    own = slots.select("cluster_id", "slot_id", F.col("slot_lat").alias("own_lat"), F.col("slot_lon").alias("own_lon"))
    anywhere = slots.groupBy("slot_id").agg(
        F.min("cluster_id").alias("any_cluster"),
        F.min_by("slot_lat", "cluster_id").alias("any_lat"),
        F.min_by("slot_lon", "cluster_id").alias("any_lon"),
    )
    df = ours.join(own, ["cluster_id", "slot_id"], "left").join(anywhere, "slot_id", "left")

    def pick(a: str, b: str) -> Column:
        return F.when(F.col("_known"), F.col(a)).otherwise(F.col(b))

    return df.select(
        "well_id",
        "slot_id",
        pick("cluster_id", "any_cluster").alias("cluster_id"),
        pick("own_lat", "any_lat").alias("lat"),
        pick("own_lon", "any_lon").alias("lon"),
    )


def reference_location(bores: DataFrame, wells: DataFrame, clusters: DataFrame) -> DataFrame:
    """Latitude, longitude and depth of a wellbore: its slot's position, else its cluster's; depth default 0."""
    roots = root_wellbore(bores).join(
        bores.select(F.col("bore_id").alias("root_bore_id"), "well_id"), "root_bore_id", "left"
    )
    slot = slot_lookup(wells, clusters).select("well_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    own = wells.select("well_id", "cluster_id")
    c = clusters.select("cluster_id", F.col("lat").alias("_c_lat"), F.col("lon").alias("_c_lon"), "field_id", "ref_depth")
    df = roots.join(own, "well_id", "left").join(slot, "well_id", "left").join(c, "cluster_id", "left")
    return df.select(
        "bore_id",
        F.coalesce("_lat", "_c_lat").alias("lat"),
        F.coalesce("_lon", "_c_lon").alias("lon"),
        F.coalesce(F.col("ref_depth.mean"), F.lit(0.0)).alias("ref_depth"),
        "field_id",
    ).filter("lat IS NOT NULL AND lon IS NOT NULL")


def reference_offsets(bores: DataFrame, wells: DataFrame, clusters: DataFrame, rigs: DataFrame) -> DataFrame:
    """Offsets of the depth and position references of every wellbore.

    The rig is the wellbore's, or the cluster's on a fixed platform.  The slot is the first one found climbing the
    wellbore's ancestors; a wellbore without well takes the well that owns that slot.
    """
    chains = climb(bores.select("bore_id", "parent_bore_id"), "bore_id", "parent_bore_id")
    bore_slot = bores.select(F.col("bore_id").alias("_id"), "well_id").join(
        wells.select("well_id", "slot_id"), "well_id", "left"
    )
    slot = (
        chains.select("bore_id", F.posexplode("path").alias("_pos", "_id"))
        .join(bore_slot.select("_id", "slot_id"), "_id")
        .filter("slot_id IS NOT NULL")
        .groupBy("bore_id")
        .agg(F.min_by("slot_id", "_pos").alias("slot_id"))
    )
    w = wells.select("well_id", "cluster_id", F.lit(True).alias("_well"))
    by_slot = wells.filter("slot_id IS NOT NULL").groupBy("slot_id").agg(
        F.min_by("cluster_id", "well_id").alias("_slot_cluster")
    )
    df = bores.select("bore_id", "well_id", "rig_id").join(w, "well_id", "left").join(slot, "bore_id", "left")
    df = df.join(by_slot, "slot_id", "left").withColumn(
        "cluster_id", F.when(F.col("_well"), F.col("cluster_id")).otherwise(F.col("_slot_cluster"))
    )
    c = clusters.select(
        "cluster_id",
        "ground_depth",
        "sea_depth",
        F.when(F.col("is_fixed"), F.col("rig_id")).alias("_cluster_rig"),
        F.col("lat").alias("_c_lat"),
        F.col("lon").alias("_c_lon"),
    )
    df = df.join(c, "cluster_id", "left").join(slot_table(clusters), ["cluster_id", "slot_id"], "left")
    own = rigs.select(F.col("rig_id"), F.col("drill_floor").alias("_own_floor"), F.lit(True).alias("_rig"))
    spare = rigs.select(F.col("rig_id").alias("_cluster_rig"), F.col("drill_floor").alias("_cluster_floor"))
    df = df.join(own, "rig_id", "left").join(spare, "_cluster_rig", "left")
    floor = F.when(F.col("_rig"), F.col("_own_floor")).otherwise(F.col("_cluster_floor"))

    def zero(x: Column) -> Column:
        return F.coalesce(-x, F.lit(0.0))

    return df.select(
        "bore_id",
        zero(F.col("ground_depth")).alias("ground_offset"),
        zero(F.col("sea_depth")).alias("sea_offset"),
        zero(floor).alias("rotary_offset"),
        zero(G.north_of("slot_lat")).alias("wellhead_north"),
        zero(G.east_of("slot_lat", "slot_lon")).alias("wellhead_east"),
        zero(G.north_of("_c_lat")).alias("cluster_north"),
        zero(G.east_of("_c_lat", "_c_lon")).alias("cluster_east"),
    )


def depth_offset(kind: Column, ground: Column, sea_level: Column, water: Column, rotary: Column) -> Column:
    """Offset of a named depth reference to the vertical datum; any other name means the rotary table."""
    return (
        F.when(kind == "Ground/Mud line", ground)
        .when(kind.isin("MSL", "Mean sea level"), sea_level)
        .when(kind == "Sea water level", water)
        .otherwise(rotary)
    )


def resolve_depth_offset(requests: DataFrame, bores: DataFrame, wells: DataFrame, clusters: DataFrame,
                         rigs: DataFrame) -> DataFrame:
    """Add ``offset`` for rows (bore_id, depth_reference, sea_level_offset)."""
    c = clusters.select("cluster_id", "ground_depth", "sea_depth", F.col("rig_id").alias("_cluster_rig"))
    df = requests.join(bores.select("bore_id", "well_id", "rig_id"), "bore_id", "left")
    df = df.join(wells.select("well_id", "cluster_id"), "well_id", "left").join(c, "cluster_id", "left")
    df = df.withColumn("_rig", F.coalesce("rig_id", "_cluster_rig"))
    df = df.join(rigs.select(F.col("rig_id").alias("_rig"), "drill_floor"), "_rig", "left")
    offset = depth_offset(
        F.col("depth_reference"),
        F.coalesce(-F.col("ground_depth"), F.lit(0.0)),
        F.coalesce("sea_level_offset", F.lit(0.0)),
        F.coalesce(-F.col("sea_depth"), F.lit(0.0)),
        F.coalesce(-F.col("drill_floor"), F.lit(0.0)),
    )
    return df.select(*requests.columns, offset.alias("offset"))


def sidetrack_pairs(pairs: DataFrame, bores: DataFrame, ranges: DataFrame) -> DataFrame:
    """Minimum depths to respect when one bore of a pair is a sidetrack of the other; nulls otherwise.

    ``ranges`` holds the surveyed depth range per bore (bore_id, start_md, end_md).  A sidetrack counts from its
    parent's tie-in depth where that lies in its own range, else from its first depth.
    """
    info = bores.select("bore_id", "is_sidetrack", "parent_bore_id", "tie_in_md").join(ranges, "bore_id", "left")

    def side(prefix: str, key: str) -> DataFrame:
        return info.select(F.col("bore_id").alias(key), *[F.col(c).alias(prefix + c) for c in info.columns[1:]])

    df = pairs.join(side("r_", "ref_id"), "ref_id", "left").join(side("c_", "cmp_id"), "cmp_id", "left")

    def is_side_of(p: str, other: str) -> Column:
        tie = F.col(p + "tie_in_md")
        test = F.col(p + "is_sidetrack") & (F.col(p + "parent_bore_id") == F.col(other)) & G.is_defined(tie) & (tie >= 0)
        return F.coalesce(test, F.lit(False))

    def own_minimum(p: str) -> Column:
        tie, start, end = F.col(p + "tie_in_md"), F.col(p + "start_md"), F.col(p + "end_md")
        return F.when(start.isNull() | ((tie >= start) & (tie <= end)), tie).otherwise(start)

    ref_side, cmp_side = is_side_of("r_", "cmp_id"), is_side_of("c_", "ref_id")
    return df.select(
        *pairs.columns,
        F.when(ref_side, own_minimum("r_")).when(cmp_side, F.col("c_tie_in_md")).alias("ref_min_md"),
        F.when(ref_side, F.col("r_tie_in_md")).when(cmp_side, own_minimum("c_")).alias("cmp_min_md"),
    )


def parent_run_candidates(rows: DataFrame, bores: DataFrame, runs: DataFrame, max_gap: float = 10.0) -> DataFrame:
    """Runs that may serve as parent of an imported survey.

    ``rows``: row_id, bore_id, first_md.  ``runs``: run_id, bore_id, first_md, last_md.  A candidate covers the tie-in
    depth, or ends at most ``max_gap`` above it.  A sidetrack looks on its parent wellbore, any other row on its own.
    """
    info = bores.select("bore_id", "is_sidetrack", "parent_bore_id", "tie_in_md")
    want = rows.join(info, "bore_id").select(
        "row_id",
        F.when(F.col("is_sidetrack"), F.col("parent_bore_id")).otherwise(F.col("bore_id")).alias("_bore"),
        F.when(F.col("is_sidetrack"), F.coalesce("tie_in_md", "first_md")).otherwise(F.col("first_md")).alias("_tie"),
    )
    have = runs.select("run_id", F.col("bore_id").alias("_bore"), F.col("first_md").alias("_lo"), F.col("last_md").alias("_hi"))
    tie, lo, hi = F.col("_tie"), F.col("_lo"), F.col("_hi")
    fits = ((lo <= tie) & (tie <= hi)) | ((hi <= tie) & (tie - hi <= max_gap))
    return want.join(have, "_bore").filter(fits).select("row_id", "run_id", tie.alias("tie_in_md"))
