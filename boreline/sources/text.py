"""Survey text: lines to measurements, as column expressions over all files of a batch at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boreline.functions import blocks as B

# Fixed names and defaults of the import settings.
SEPARATORS = {"Semicolon (;)": ";", "Tab": "\t", "Space": r"\s+"}
SETTINGS = {
    "format": "Separated",
    "separator": "Semicolon (;)",
    "decimal": "Auto",
    "md_unit": "metre",
    "inc_unit": "degree",
    "az_unit": "degree",
    "md_column": 1,
    "inc_column": 2,
    "az_column": 3,
    "md_start": 1,
    "md_width": 12,
    "inc_start": 13,
    "inc_width": 12,
    "az_start": 25,
    "az_width": 12,
}
# Fixed factors to SI.
UNITS = {
    "metre": 1.0,
    "foot": 0.3048,
    "kilometre": 1000.0,
    "decimetre": 0.1,
    "radian": 1.0,
    "degree": 0.017453292519943295,
    "gradian": 0.015707963267948967,
}
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(token: Column, marker: Column) -> Column:
    """Number of a token with a decimal dot, a decimal comma, or whichever mark comes last; null when it is none."""
    t = F.trim(token)
    dot = F.replace(t, F.lit(","), F.lit(""))
    comma = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    back = F.reverse(t)
    comma_at, dot_at = F.instr(back, ","), F.instr(back, ".")
    auto = (
        F.when((comma_at > 0) & (dot_at > 0), F.when(comma_at < dot_at, comma).otherwise(dot))
        .when(comma_at > 0, F.replace(t, F.lit(","), F.lit(".")))
        .otherwise(t)
    )
    text = F.when(marker == "Dot (.)", dot).when(marker == "Comma (,)", comma).otherwise(auto)
    return F.when(F.regexp_like(text, F.lit(NUMBER)), text.try_cast("double"))


def split_columns(line: Column, separator: Column, needed: Column) -> Column:
    """Tokens of a line; with too few of them the other separators are tried in their listed order."""
    ways = {
        "Semicolon (;)": F.transform(F.split(line, ";"), lambda v: F.trim(v)),
        "Tab": F.transform(F.split(line, "\t"), lambda v: F.trim(v)),
        "Space": F.filter(F.split(F.trim(line), r"\s+"), lambda v: F.trim(v) != ""),
    }
    chosen = F.when(separator == "Tab", ways["Tab"]).when(separator == "Space", ways["Space"]).otherwise(ways["Semicolon (;)"])
    enough = [F.when(F.size(w) >= needed, w) for w in ways.values()]
    return F.coalesce(F.when(F.size(chosen) >= needed, chosen), *enough, chosen)


def fixed_width_token(line: Column, start: Column, width: Column) -> Column:
    """Trimmed text of a field; null when the line ends before it."""
    there = (start >= 1) & (width >= 1) & (F.length(line) >= start)
    return F.when(there, F.trim(F.substring(line, start, width)))


def unit_factor(unit: Column) -> Column:
    factor = None
    for name, value in UNITS.items():
        factor = F.when(F.lower(unit) == name, F.lit(value)) if factor is None else factor.when(F.lower(unit) == name, F.lit(value))
    return factor.otherwise(F.lit(1.0))


def with_settings(df: DataFrame, settings: Mapping | None = None) -> DataFrame:
    """Add the setting columns; those already present stay, nulls take the default."""
    values = {**SETTINGS, **(settings or {})}
    return df.withColumns({
        k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in values.items()
    })


def measure_lines(lines: DataFrame, keys: list[str], order: list[str], settings: Mapping | None = None) -> DataFrame:
    """Measurement of every line: md, inc, az in SI and whether the line was ``accepted``.

    ``lines``: keys, order columns, line and any setting columns, optionally ``offset`` (datum offset subtracted from
    depth).  A line counts when its three numbers parse and its depth exceeds every depth accepted before, which is
    the largest depth parsed so far.
    """
    df = with_settings(lines, settings)
    blank = F.trim("line") == ""
    needed = F.greatest("md_column", "inc_column", "az_column")
    df = df.withColumn("_tokens", split_columns(F.col("line"), F.col("separator"), needed))
    fixed = F.col("format") == "Fixed width"
    raw = {}
    for name in ("md", "inc", "az"):
        by_column = F.when(F.col(f"{name}_column") >= 1, F.get("_tokens", F.col(f"{name}_column") - 1))
        token = F.when(fixed, fixed_width_token(F.col("line"), F.col(f"{name}_start"), F.col(f"{name}_width"))).otherwise(by_column)
        raw["_" + name] = F.when(~blank, parse_number(token, F.col("decimal")))
    df = df.withColumns(raw)
    good = F.col("_md").isNotNull() & F.col("_inc").isNotNull() & F.col("_az").isNotNull()
    offset = F.coalesce("offset", F.lit(0.0)) if "offset" in lines.columns else F.lit(0.0)
    df = df.withColumns({
        "md": F.when(good, F.col("_md") * unit_factor(F.col("md_unit")) - offset),
        "inc": F.when(good, F.col("_inc") * unit_factor(F.col("inc_unit"))),
        "az": F.when(good, F.col("_az") * unit_factor(F.col("az_unit"))),
    })
    block = [B.BLOCK] if B.is_split(df) else []
    df = df.select(*keys, *order, *block, "md", "inc", "az")
    df = B.with_running_max_before(df, keys, order, "md", "_deepest")
    rising = F.col("md").isNotNull() & (F.col("_deepest").isNull() | (F.col("md") > F.col("_deepest")))
    return df.withColumn("accepted", rising).drop("_deepest")


def accepted_measurements(measured: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Accepted lines numbered from 0: keys, seq, md, inc, az."""
    kept = B.with_position(measured.filter("accepted"), keys, order, "seq")
    block = [B.BLOCK] if B.is_split(kept) else []
    return kept.select(*keys, "seq", *block, "md", "inc", "az")


def skipped_lines(measured: DataFrame, keys: list[str]) -> DataFrame:
    return measured.groupBy(*keys).agg(
        F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_skipped")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all text files under a path: file, block, line_no, line.

    A large file is read in splits; lines are ordered by the split's start, then by their place in it, and ``_block``
    lets the scans work split by split.
    """
    df = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias(B.BLOCK),
        F.monotonically_increasing_id().alias("line_no"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    several = df.select(B.BLOCK).filter(F.col(B.BLOCK) > 0).limit(1)
    return df.drop(B.BLOCK) if several.isEmpty() else df


def read_surveys(spark: SparkSession, path: str, settings: Mapping | None = None) -> DataFrame:
    """Measurements of all delimited or fixed-width survey files under a path: file, seq, md, inc, az."""
    measured = measure_lines(read_lines(spark, path), ["file"], ["line_no"], settings)
    return accepted_measurements(measured, ["file"], ["line_no"])


def read_well_listing(spark: SparkSession, path: str) -> DataFrame:
    """Ten-column well listings (MD inc az TVD N E DLS BUR TR VS), tab separated; -999.25 and blanks are null.

    Angles come out in radians, rates in radians per metre (the listing has degrees per 30 m).
    """
    fields = ["md", "inc", "az", "tvd", "north", "east", "dls", "bur", "tur", "vsect"]
    df = spark.read.csv(path, sep="\t", schema=", ".join(f"{c} string" for c in fields))
    df = df.withColumn("file", F.col("_metadata.file_path"))
    values = {}
    for c in fields:
        v = F.trim(F.col(c)).try_cast("double")
        v = F.when(F.abs(v + 999.25) < 1e-6, None).otherwise(v)
        values[c] = F.radians(v) if c in ("inc", "az") else F.radians(v) / 30.0 if c in ("dls", "bur", "tur") else v
    return df.select("file", *[v.alias(c) for c, v in values.items()])


def read_angle_table(spark: SparkSession, path: str, depth_factor: float = 1.0) -> DataFrame:
    """Four-column tab files (MD inc az TVD, degrees, decimal comma or dot); ``depth_factor`` 0.3048 reads feet."""
    df = spark.read.csv(path, sep="\t", schema="md string, inc string, az string, tvd string")
    df = df.withColumn("file", F.col("_metadata.file_path"))
    auto = F.lit("Auto")
    v = {c: parse_number(F.col(c), auto) for c in ("md", "inc", "az", "tvd")}
    return df.select(
        "file", (v["md"] * depth_factor).alias("md"), F.radians(v["inc"]).alias("inc"), F.radians(v["az"]).alias("az"),
        (v["tvd"] * depth_factor).alias("tvd"),
    ).filter("md IS NOT NULL")
