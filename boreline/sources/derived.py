"""Wells, surveys and dimensions derived from the analytic test tables.

The test tables hold no wells, so each well is a deterministic function of the rows of ``events`` (one survey
measurement per event, one wellbore per user) or ``lineitem`` (one wellbore per supplier); wells, clusters and rigs
come from ``customer``, ``nation`` and ``supplier``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreline.functions import blocks as B
from boreline.functions import geometry as G
from boreline.operators import survey

SLOTS_PER_CLUSTER = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _block(df: DataFrame) -> list[str]:
    return [B.BLOCK] if B.is_split(df) else []


def _by_well(df: DataFrame) -> DataFrame:
    """The one exchange every window below shares; rows are few bytes but much trigonometry."""
    return B.spread(df, ["bore_id", *_block(df)])


def _angles(df: DataFrame) -> DataFrame:
    md, bore = F.col("md"), F.col("bore_id")
    return df.withColumn("inc", F.round(0.6 + 0.5 * F.sin(md / 400.0 + bore), 6)).withColumn(
        "az", F.round(G.wrap_positive(bore * 0.37 + 0.3 * F.sin(md / 700.0)), 6)
    )


def _wellhead(df: DataFrame) -> DataFrame:
    first = F.col("seq") == 0
    return (
        df.withColumn("north", F.when(first, (F.col("bore_id") % 15) * 8.0))
        .withColumn("east", F.when(first, F.floor(F.col("bore_id") / 15) * 8.0))
        .withColumn("tvd", F.when(first, F.lit(0.0)))
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bore_id, event_id, seq, md, inc, az, north, east, tvd); the position is set on the first row only."""
    step = F.expr("CAST(5 + value AS DECIMAL(12,2))")
    raw = table(spark, sf_dir, "events").select(F.col("user_id").alias("bore_id"), "event_id", step.alias("step"))
    raw = _by_well(B.split_large_wells(raw, ["bore_id"], "event_id"))
    raw = B.with_running_sum(raw, ["bore_id"], ["event_id"], {"md": "step", "seq": F.lit(1)})
    rows = raw.select(
        "bore_id", "event_id", *_block(raw), (F.col("seq") - 1).cast("bigint").alias("seq"), F.col("md").cast("double").alias("md")
    )
    return _wellhead(_angles(rows))


def large_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shape from ``lineitem``: few wells of many stations."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    step = F.expr("CAST(5 + l_quantity AS DECIMAL(12,2))")
    raw = table(spark, sf_dir, "lineitem").select(*order, step.alias("step")).withColumn("bore_id", F.col("l_suppkey"))
    raw = _by_well(B.split_large_wells(raw, ["bore_id"], "l_orderkey"))
    raw = B.with_running_sum(raw, ["bore_id"], order, {"md": "step", "seq": F.lit(1)})
    rows = raw.select(
        "bore_id", *_block(raw), (F.col("seq") - 1).cast("bigint").alias("seq"), F.col("md").cast("double").alias("md")
    )
    return _wellhead(_angles(rows))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements completed by minimum curvature, with rates."""
    return survey.complete_survey(measurements(spark, sf_dir).drop("event_id"))


def large_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.complete_survey(large_measurements(spark, sf_dir))


def wellbores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five bores per well: two roots and a chain of three sidetracks below the second."""
    bore, pos = F.col("bore_id"), F.col("bore_id") % 5
    side = pos >= 2
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("bore_id"))
        .distinct()
        .select(
            "bore_id",
            F.concat(F.lit("Bore "), bore.cast("string")).alias("name"),
            (bore - pos).alias("well_id"),
            side.alias("is_sidetrack"),
            F.when(side, bore - 1).alias("parent_bore_id"),
            F.when(side, 150.0 + (bore % 7) * 25.0).alias("tie_in_md"),
            F.when(pos != 3, bore % 10).alias("rig_id"),
        )
    )


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("well_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 11 != 3, F.col("c_nationkey")).alias("cluster_id"),
        F.concat(F.lit("S"), (F.col("c_custkey") % 7).cast("string")).alias("slot_id"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with a map of slots, each with a Gaussian latitude and longitude (radians)."""
    n = F.col("n_nationkey")
    entries = []
    for k in range(SLOTS_PER_CLUSTER):
        entries += [
            F.lit(f"S{k}"),
            F.struct(
                F.struct((0.9 + n * 0.001 + k * 1e-6).alias("mean"), F.lit(1e-7).alias("std")).alias("lat"),
                F.struct((0.05 + n * 0.002 + k * 2e-6).alias("mean"), F.lit(2e-7).alias("std")).alias("lon"),
            ),
        ]
    return table(spark, sf_dir, "nation").select(
        n.alias("cluster_id"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").alias("field_id"),
        F.struct((n * 1.5 - 20.0).alias("mean"), F.lit(0.5).alias("std")).alias("ref_depth"),
        (0.9 + n * 0.001).alias("lat"),
        (0.05 + n * 0.002).alias("lon"),
        (n % 2 == 0).alias("is_fixed"),
        n.cast("bigint").alias("rig_id"),
        (n * 2.0).alias("ground_depth"),
        (n * 0.5).alias("sea_depth"),
        F.create_map(*entries).alias("slots"),
    )


def rigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("rig_id"), (20.0 + F.col("s_nationkey") * 0.25).alias("drill_floor")
    )


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path record per order: its wellbore is the customer, its type and dates come from the order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("traj_id"),
        F.col("o_custkey").alias("bore_id"),
        F.element_at(F.array(F.lit("Planned"), F.lit("Measured")), (F.col("o_orderkey") % 2 + 1).cast("int")).alias(
            "type"
        ),
        (F.col("o_orderstatus") == "F").alias("is_definitive"),
        F.col("o_orderdate").alias("modified"),
        F.concat(F.lit("Path "), F.col("o_orderpriority")).alias("name"),
        F.concat(F.col("o_orderpriority"), F.lit(" order")).alias("description"),
    )


def hole_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Architecture per wellbore: two surface sections, a casing of two sizes and three elements, one open hole."""
    bore = F.col("bore_id")

    def item(kind, section, pos, top, length, diameter):
        number = [None if v is None else (v if hasattr(v, "cast") else F.lit(v)) for v in (top, length, diameter)]
        number = [(F.lit(None) if v is None else v).cast("double") for v in number]
        return F.struct(
            F.lit(section).cast("int").alias("section"),
            F.lit(kind).alias("kind"),
            F.lit(pos).alias("pos"),
            number[0].alias("top_md"),
            number[1].alias("length"),
            number[2].alias("diameter"),
        )

    items = F.array(
        item("surface", None, 0, None, 10.0 + bore % 5, 0.9),
        item("surface", None, 1, None, 20.0 + bore % 3, 0.75),
        item("casing", 0, 0, 40.0 + (bore % 4) * 1.0, 950.0, None),
        item("size", 0, 0, None, 500.0, 0.5),
        item("size", 0, 1, None, 450.0, 0.3 + (bore % 6) * 0.01),
        item("element", 0, 0, None, 300.0, 0.339725),
        item("element", 0, 1, None, 400.0, 0.339725),
        item("element", 0, 2, None, 250.0 + bore % 3, 0.244475),
        item("open", 0, 0, None, 1500.0, 0.2159),
        item("open", 0, 1, None, 1500.0, 0.1524),
    )
    return wellbores(spark, sf_dir).select("bore_id", F.inline(items))


def wellheads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wellhead depth and casing hanger depth per wellbore."""
    return wellbores(spark, sf_dir).select(
        "bore_id",
        (30.0 + F.col("bore_id") % 9).cast("double").alias("wellhead_md"),
        F.when(F.col("bore_id") % 3 != 0, 42.0 + F.col("bore_id") % 2).cast("double").alias("hanger_md"),
    )


def comparison_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wellbore as reference with the other bores of its well (at most four) as comparisons."""
    b = wellbores(spark, sf_dir).select("bore_id", "well_id")
    mates = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("well_id") + i)
    wanted = b.select(F.col("bore_id").alias("ref_id"), F.explode(mates).alias("cmp_id"))
    return wanted.join(b.select(F.col("bore_id").alias("cmp_id")), "cmp_id", "left_semi").select("ref_id", "cmp_id")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One survey instrument per supplier; magnitudes and the local field vary with its key and nation."""
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    models = F.array(*[F.lit(m) for m in ("MWD_WolffDeWardt", "Gyro_WolffDeWardt", "MWD_ISCWSA", "Gyro_WolffDeWardt", "Other")])
    gyro = k % 5 == 1
    return table(spark, sf_dir, "supplier").select(
        k.alias("tool_id"),
        F.element_at(models, (k % 5 + 1).cast("int")).alias("model"),
        F.lit(0.0005).alias("rel_depth"),
        (0.0004 + (k % 3) * 0.0001).alias("misalignment"),
        F.when(~gyro, 0.001).alias("true_inc"),
        (0.0012 + (k % 4) * 0.0002).alias("reference"),
        F.when(~gyro, 0.0005).alias("magnetisation"),
        F.when(gyro, 0.0006).alias("gyro"),
        (1.2 + n * 0.002).alias("dip"),
        (n * 0.004 - 0.05).alias("declination"),
        F.lit(9.80665).alias("gravity"),
        (48000.0 + n * 100.0).alias("bfield"),
        (0.9 + n * 0.001).alias("latitude"),
    )


def error_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error sources of every ISCWSA instrument; those of every other have a code without weighting function."""
    rows = [
        ("DRFR", 0.35, False, True), ("DSFS", 0.00056, True, False), ("DSTG", 2.5e-7, True, False),
        ("SAG", 0.0035, True, False), ("XYM1", 0.001, True, False), ("XYM2", 0.001, True, False),
        ("XYM3", 0.001, True, False), ("XYM4", 0.001, True, False), ("DEC_U", 0.0063, True, False),
        ("DBH_U", 3000.0 * 0.0174533, True, False), ("AMID", 0.0061, True, False), ("ABZ", 0.004, True, False),
        ("MBZ", 70.0, True, False), ("XCLA", 0.167, True, False),
    ]
    items = F.array(*[
        F.struct(F.lit(c).alias("code"), F.lit(m).alias("magnitude"), F.lit(s).alias("systematic"),
                 F.lit(r).alias("random"), F.lit(False).alias("global")) for c, m, s, r in rows
    ])
    tools = instruments(spark, sf_dir).filter(F.col("model") == "MWD_ISCWSA")
    found = tools.select("tool_id", F.inline(items))
    return found.filter((F.col("code") != "XCLA") | (F.col("tool_id") % 10 == 2))


def gyro_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments with what the gyro error model needs beside the field: running speed, canted accelerometers, noise."""
    return instruments(spark, sf_dir).withColumns({
        "running_speed": (0.5 + (F.col("tool_id") % 4) * 0.1), "cant": F.lit(0.3), "switching": F.lit(0.9),
        "noise_reduction": F.lit(0.8),
    })


def gyro_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error sources of a gyro tool for every instrument: at rest below an inclination of 0.35, running above 0.3."""
    drift, rest, run = 4.8e-7, (0.0, 0.35), (0.3, 1.5)
    rows = [
        ("DRFR", 0.35, True, None), ("AXYZ_XYB", 0.005, False, None), ("AXYZ_SF", 0.0005, False, None), ("AXY_B", 0.004, False, rest),
        ("AXY_SF", 0.0005, False, (0.0, 1.2)), ("GXYZ_XYB1", drift, False, rest), ("GXYZ_XYRN", drift, True, rest),
        ("GXYZ_XYG4", drift, False, rest), ("GXYZ_ZB", drift, False, rest), ("GXY_B1", drift, False, rest), ("GXY_G2", drift, False, rest),
        ("GXY_SF", 0.001, False, rest), ("GXY_MIS", 0.0009, False, rest), ("EXT_REF", 0.0087, False, None),
        ("EXT_MIS", 0.001, False, None), ("GXYZ_GD", 2.4e-6, False, run), ("GXYZ_RW", 1.5e-5, False, run), ("GXY_GD", 2.4e-6, False, run),
        ("GXY_RW", 1.5e-5, False, run), ("GZ_RW", 1.5e-5, False, (0.0, 0.8)),
    ]
    items = F.array(*[
        F.struct(F.lit(c).alias("code"), F.lit(m).alias("magnitude"), F.lit(not r).alias("systematic"), F.lit(r).alias("random"),
                 F.lit(False).alias("global"), F.lit(ends[0] if ends else None).cast("double").alias("start_inc"),
                 F.lit(ends[1] if ends else None).cast("double").alias("end_inc")) for c, m, r, ends in rows
    ])
    return instruments(spark, sf_dir).select("tool_id", F.inline(items))


def with_tools(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instrument of every station: one per wellbore, all instruments in turn."""
    count = table(spark, sf_dir, "supplier").count()
    return df.withColumn("tool_id", F.col("bore_id") % max(1, count))
