"""Catalogue filters, lookups, naming and the maintenance of stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreline.functions import blocks as B

NO_ID = "00000000-0000-0000-0000-000000000000"


def _matches(filters: dict[str, object]) -> Column:
    wanted = [F.col(c) == F.lit(v) for c, v in filters.items() if v is not None and v != NO_ID and v != ""]
    return reduce(lambda a, b: a & b, wanted, F.lit(True))


def filter_catalog(paths: DataFrame, field_id=None, cluster_id=None, well_id=None, bore_id=None, type=None,  # noqa: A002
                   is_definitive=None) -> DataFrame:
    """Rows equal to every given value; null and the empty id mean no filter.  The predicates reach the scan."""
    given = {"field_id": field_id, "cluster_id": cluster_id, "well_id": well_id, "bore_id": bore_id, "type": type,
             "is_definitive": is_definitive}
    return paths.filter(_matches({k: v for k, v in given.items() if k in paths.columns or v not in (None, NO_ID)}))


def filter_survey_runs(runs: DataFrame, instrument_id=None, run_type=None, **hierarchy) -> DataFrame:
    """As ``filter_catalog`` plus survey instrument and run type."""
    return filter_catalog(runs, **hierarchy).filter(_matches({"instrument_id": instrument_id, "run_type": run_type}))


def filter_and_sort_by_name(paths: DataFrame, **filters) -> DataFrame:
    return filter_catalog(paths, **filters).orderBy("name")


def search_text(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows where any of the columns contains the text, ignoring case; blank text keeps everything."""
    if not text or not text.strip():
        return rows
    needle = F.lower(F.lit(text))
    return rows.filter(
        reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False)) for c in columns])
    )


def project_light(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The small columns of an entity; a columnar scan then reads nothing else."""
    return rows.select(*columns)


def list_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key)


def scan_by_id(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.col(key) == F.lit(value)) if value not in (None, NO_ID) else rows.filter(F.lit(False))


def scan_by_ids(rows: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Rows of the requested ids with their request position; unknown and empty ids are left out.

    ``requested``: pos, key.  The position gives the request order to whoever writes the result.
    """
    asked = requested.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != NO_ID))
    return rows.join(asked.select(key, "pos"), key)


def scan_by_wellbore(paths: DataFrame) -> DataFrame:
    """One path per wellbore: the definitive one, else the last modified, else the lowest id."""
    best = F.struct(~F.coalesce("is_definitive", F.lit(False)), -F.unix_micros(F.col("modified").cast("timestamp")), F.col("traj_id"))
    columns = [c for c in paths.columns if c != "bore_id"]
    return (
        paths.groupBy("bore_id")
        .agg(F.min_by(F.struct(*columns), best).alias("_row"))
        .select("bore_id", *[F.col("_row")[c].alias(c) for c in columns])
    )


def restrict_to_requested(rows: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Only requested ids, or every row when nothing is requested."""
    if requested.isEmpty():
        return rows
    return rows.join(requested.select(key), key, "left_semi")


def select_comparisons(pairs: DataFrame) -> DataFrame:
    """Distinct comparisons of each reference, without empty ids and the reference itself."""
    return pairs.filter(F.col("cmp_id").isNotNull() & (F.col("ref_id") != F.col("cmp_id"))).distinct()


def stale_ids(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Stored ids that are no longer current."""
    return stored.select(key).distinct().join(current.select(key), key, "left_anti")


def unique_name(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """A free name for every requested base name: the base, else ``base (n)`` with the least free n >= 2.

    Names compare without case.  ``wanted``: base.  ``taken``: name.  The numbers in use are ranked per base, and the
    first gap in 2, 3, 4, ... is the answer.
    """
    bases = wanted.select("base", F.lower("base").alias("_base")).distinct()
    used = taken.select(F.lower("name").alias("_name")).distinct()
    numbered = used.select(
        F.regexp_extract("_name", r"^(.*) \(([1-9][0-9]{0,17})\)$", 1).alias("_base"),
        F.regexp_extract("_name", r"^(.*) \(([1-9][0-9]{0,17})\)$", 2).try_cast("bigint").alias("_n"),
    ).filter("_n >= 2")
    asked = numbered.join(bases.select("_base").distinct(), "_base", "left_semi")
    # n is free from the front as long as the k-th number in use is k + 1
    rank = F.row_number().over(Window.partitionBy("_base").orderBy("_n")).cast("bigint")
    run = asked.withColumn("_k", rank).filter("_n = _k + 1").groupBy("_base").agg(F.max("_n").alias("_last"))
    base_used = used.select(F.col("_name").alias("_base"), F.lit(True).alias("_taken"))
    df = bases.join(base_used, "_base", "left").join(run, "_base", "left")
    number = F.coalesce(F.col("_last") + 1, F.lit(2))
    name = F.when(F.col("_taken"), F.concat(F.col("base"), F.lit(" ("), number.cast("string"), F.lit(")")))
    return df.select("base", name.alias("_n")).select("base", F.coalesce("_n", "base").alias("name"))


def enforce_single_definitive(paths: DataFrame) -> DataFrame:
    """Per wellbore and type only the last modified definitive path stays definitive."""
    claimed = F.coalesce("is_definitive", F.lit(False))
    best = (
        paths.filter(claimed)
        .groupBy("bore_id", "type")
        .agg(F.max_by("traj_id", F.struct("modified", "traj_id")).alias("_winner"))
    )
    joined = paths.join(best, ["bore_id", "type"], "left")
    keep = claimed & (F.col("traj_id") == F.col("_winner"))
    return joined.withColumn("is_definitive", F.coalesce(keep, F.lit(False))).select(*paths.columns)


def upsert_table(current: DataFrame, changes: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The newest version of every id over stored rows and changes."""
    rows = B.stack([key], current, changes)
    columns = [c for c in rows.columns if c != key]
    return (
        rows.groupBy(key)
        .agg(F.max_by(F.struct(*columns), version).alias("_row"))
        .select(*[F.col(key) if c == key else F.col("_row")[c].alias(c) for c in rows.columns])
    )


def delete_by_owner(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows left after their owners and all they own are deleted."""
    return rows.join(owners.select(key), key, "left_anti")


def expire_older_than(rows: DataFrame, modified: str, cutoff: Column) -> DataFrame:
    """Rows modified at or after the cutoff; rows without a date stay."""
    return rows.filter(F.col(modified).isNull() | (F.col(modified) >= cutoff))


def page_index(rows: DataFrame, keys: list[str], order: list[str], page_rows: int = 1000) -> DataFrame:
    """Add the page number of each row in its owner's list."""
    numbered = B.with_position(rows, keys, order, "_position")
    return numbered.withColumn("page", F.floor(F.col("_position") / page_rows)).drop("_position")


def chunk_metadata(paged: DataFrame, owner: str, order: str = "seq") -> DataFrame:
    """Row count and first and last depth of every page."""
    return paged.groupBy(owner, "page").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min_by("md", order).alias("start_md"),
        F.max_by("md", order).alias("end_md"),
    )


def chunk_count(paged: DataFrame, owner: str) -> DataFrame:
    return paged.groupBy(owner).agg((F.max("page") + 1).alias("n_pages"))


def chunk_lookup(paged: DataFrame, page: int) -> DataFrame:
    return paged.filter(F.col("page") == page)


def read_chunks(chunks: DataFrame, owner: str) -> DataFrame:
    """Rows of chunked lists: owner, chunk_index, items array of structs, one row per item in list order."""
    return chunks.select(owner, "chunk_index", F.posexplode("items").alias("pos", "item")).select(
        owner, "chunk_index", "pos", "item.*"
    )


def enrich_names(rows: DataFrame, names: DataFrame, key: str, alias: str) -> DataFrame:
    """Add the display name of an id; a missing name stays null."""
    return rows.join(names.select(key, F.col("name").alias(alias)), key, "left")


def usage_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("operation").agg(F.sum("count").alias("total"))


def case_status_rollup(children: DataFrame, case: str = "case_id") -> DataFrame:
    """A case is complete when all of its parts are."""
    return children.groupBy(case).agg(
        F.bool_and(F.coalesce("ok", F.lit(False))).alias("complete"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed")
    )
