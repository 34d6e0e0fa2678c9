"""Tables for display and exchange, and the writers of paged results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreline.operators import catalog

# Fixed page sizes of stored lists.
PAGE_ROWS = {"station": 1000, "result": 1000, "measurement": 5000, "realization": 25}


def sanitize_field(c: Column) -> Column:
    """Text fit for one cell of a tab-separated file."""
    return F.trim(F.translate(c, "\t\r\n", "   "))


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    """Rows dealt out by range, so a file holds a run of rows in order and a large wellbore fills several, and texts
    made fit for a cell."""
    texts = {f.name: sanitize_field(F.col(f.name)) for f in df.schema.fields if f.dataType.typeName() == "string"}
    return df.withColumns(texts).repartitionByRange(*order).sortWithinPartitions(*order)


def export_station_table(stations: DataFrame, depth_factor: float = 1.0, angle: str = "degree") -> DataFrame:
    """Station listing in display units: depths divided by ``depth_factor``, rates per 30 m."""
    turn = F.degrees if angle == "degree" else (lambda c: F.col(c) if isinstance(c, str) else c)
    length = {n: F.col(c) / depth_factor for n, c in (("tvd", "tvd"), ("north", "north"), ("east", "east"), ("vsect", "vsect"))}
    rate = {n: turn(F.col(n)) * 30.0 for n in ("dls", "bur", "tur")}
    return stations.select(
        "bore_id", "seq", (F.col("md") / depth_factor).alias("md"), turn("inc").alias("inc"), turn("az").alias("az"),
        *[v.alias(n) for n, v in length.items()], *[v.alias(n) for n, v in rate.items()],
    )


def write_station_table(stations: DataFrame, path: str, **units) -> None:
    """One tab-separated folder per wellbore, rows in order within a file and from file to file."""
    table = _in_order(export_station_table(stations, **units), "bore_id", "seq")
    table.write.mode("overwrite").partitionBy("bore_id").csv(path, sep="\t", header=True)


def export_realizations_long(points: DataFrame, path: str) -> None:
    """All realizations stacked, the realization as a column."""
    ordered = _in_order(points, "case_id", "realization", "seq")
    ordered.write.mode("overwrite").partitionBy("case_id").csv(path, sep="\t", header=True)


def export_realizations_wide(points: DataFrame, realizations: list[int], values: tuple[str, ...] = ("md", "north", "east", "tvd")) -> DataFrame:
    """Side by side: one row per point number, cells past the end of a realization empty.

    Points of a realization that is not listed are an error, not left out.
    """
    listed = F.coalesce(F.col("realization").isin(*realizations), F.lit(False))
    checked = F.when(listed, F.col("realization")).otherwise(F.raise_error(F.concat(F.lit("realization not listed: "), F.col("realization").cast("string"))))
    points = points.withColumn("realization", checked.cast(points.schema["realization"].dataType))
    return (
        points.groupBy("case_id", "seq")
        .pivot("realization", realizations)
        .agg(*[F.first(v).alias(v) for v in values])
    )


def export_covariance(stations: DataFrame, path: str) -> None:
    columns = ["md", "c00", "c11", "c22", "c01", "c02", "c12"]
    table = _in_order(stations.select("bore_id", "seq", *columns), "bore_id", "seq").drop("seq")
    table.write.mode("overwrite").partitionBy("bore_id").csv(path, sep=";", header=True)


def write_pages(rows: DataFrame, path: str, owner: str, order: str = "seq", kind: str = "station", buckets: int = 256) -> None:
    """Replace the stored pages of the given owners.

    Owners are spread over ``buckets`` folders, always the same for one table, so rewriting some of them rewrites only
    their folders; rows of other owners in the same folder are kept.  A folder is written by as many tasks as its rows
    need.
    """
    spark = rows.sparkSession
    paged = catalog.page_index(rows, [owner], [order], PAGE_ROWS[kind])
    bucket = F.pmod(F.xxhash64(owner), F.lit(buckets)).cast("int")
    fresh = paged.withColumn("bucket", bucket)
    try:
        stored = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001 - no such table yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
            raise
        stored = None
    if stored is not None:
        from boreline.functions.blocks import durable

        touched = fresh.select("bucket").distinct()
        kept = stored.join(touched, "bucket", "left_semi").join(fresh.select(owner).distinct(), owner, "left_anti")
        fresh = durable(fresh.unionByName(kept.select(*fresh.columns)))
    fresh.repartitionByRange("bucket", owner, order).sortWithinPartitions("bucket", owner, order).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
