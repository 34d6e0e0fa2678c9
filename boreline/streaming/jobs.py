"""Structured Streaming jobs: usage counters, chunked ingest, commits.

Every sink writes one folder per micro-batch, so a repeated batch after a failure overwrites itself.  Readers take the
newest value per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boreline.operators import survey

#: Folders over which the runs of stored chunks are spread.
CHUNK_BUCKETS = 64


def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_latest(spark: SparkSession, path: str, keys: list[str], version: str = "batch") -> DataFrame:
    """Newest row per key over all batches."""
    return newest(spark.read.parquet(path), keys, version)


def newest(df: DataFrame, keys: list[str], version: str = "batch") -> DataFrame:
    columns = [c for c in df.columns if c not in keys and c != "batch"]
    order = F.struct(version, "batch") if version != "batch" else F.col("batch")
    rows = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return rows.select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def usage_daily(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Count of every operation per UTC day.  ``events``: ts, operation.

    Each micro-batch adds its own counts, which ``read_usage`` sums up, so an event counts however late it comes, and no
    state is kept.
    """

    def count(df: DataFrame, batch: int) -> None:
        _write_batch(df.groupBy(F.to_date("ts").alias("day"), "operation").count(), path, batch)

    return (
        events.writeStream.outputMode("append")
        .foreachBatch(count)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """day, operation and count over all batches."""
    return spark.read.parquet(path).groupBy("day", "operation").agg(F.sum("count").alias("count"))


def _bucket(run: str, buckets: int):
    return F.pmod(F.xxhash64(run), F.lit(buckets)).cast("int")


def chunk_problem(df: DataFrame) -> DataFrame:
    """Add ``reason`` to chunks that cannot be stored: no run, negative index, no rows, undefined or falling depths."""
    items = F.col("items")
    undefined = F.exists(items, lambda r: r["md"].isNull() | r["inc"].isNull() | r["az"].isNull() | F.isnan(r["md"]))
    pairs = F.arrays_zip(
        F.slice(items["md"], F.lit(1), F.greatest(F.lit(0), F.size(items) - 1)).alias("a"),
        F.slice(items["md"], F.lit(2), F.greatest(F.lit(0), F.size(items) - 1)).alias("b"),
    )
    falling = F.exists(pairs, lambda p: p["b"] <= p["a"])
    reason = (
        F.when(F.col("run_id").isNull(), F.lit("missing run id"))
        .when(F.col("chunk_index") < 0, F.lit("negative chunk index"))
        .when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit("empty chunk"))
        .when(undefined, F.lit("undefined value"))
        .when(falling, F.lit("depth not increasing"))
    )
    return df.withColumn("reason", reason)


def ingest_chunks(chunks: DataFrame, path: str, checkpoint: str, buckets: int = CHUNK_BUCKETS) -> StreamingQuery:
    """Store uploaded chunks, however late they come; of several uploads of one chunk the last counts.

    ``chunks``: ts, upload_id, run_id, chunk_index, items array<struct<md, inc, az>>.  Bad chunks go to
    ``<path>_rejects``.  Stored chunks lie in folders by a hash of their run, always as many for one table.  No state is
    kept between batches: a retry of an upload is one more row of its chunk, and readers take the newest (``newest``),
    so no watermark has to drop what comes after it.  ``chunks_after_commit`` lists what a commit came too early for.
    """

    def store(df: DataFrame, batch: int) -> None:
        checked = chunk_problem(df).persist()
        try:
            good = checked.filter("reason IS NULL").drop("reason")
            last = good.groupBy("run_id", "chunk_index").agg(
                F.max_by(F.struct("ts", "upload_id", "items"), F.struct("ts", "upload_id")).alias("_c")
            )
            stored = last.select("run_id", "chunk_index", "_c.*", _bucket("run_id", buckets).alias("bucket"))
            stored.repartition("bucket", "run_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch}")
            _write_batch(checked.filter("reason IS NOT NULL"), path + "_rejects", batch)
        finally:
            checked.unpersist()

    return (
        chunks.writeStream.outputMode("append")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_measurements(chunks: DataFrame) -> DataFrame:
    """Rows of stored chunks in order: run_id, seq, md, inc, az.

    The position of a row is that of its chunk plus its place in it, so only chunk lengths are summed.
    """
    from boreline.functions import blocks as B

    sized = chunks.withColumn("_size", F.size("items"))
    summed = B.with_running_sum(sized, ["run_id"], ["chunk_index"], {"_end": F.col("_size").cast("bigint")})
    return summed.select(
        "run_id", (F.col("_end") - F.col("_size")).alias("_skip"), F.posexplode("items").alias("_pos", "_item")
    ).select("run_id", (F.col("_skip") + F.col("_pos")).alias("seq"), "_item.md", "_item.inc", "_item.az")


def committed_chunks(commits: DataFrame, chunk_path: str, buckets: int = CHUNK_BUCKETS) -> DataFrame:
    """The newest chunks of the runs in ``commits``; only the folders of these runs are read, at most ``buckets``."""
    runs = commits.select("run_id").distinct()
    folders = [r[0] for r in runs.select(_bucket("run_id", buckets)).distinct().collect()]
    stored = commits.sparkSession.read.parquet(chunk_path).filter(F.col("bucket").isin(folders)).drop("bucket")
    return newest(stored.join(runs, "run_id", "left_semi"), ["run_id", "chunk_index"], "ts")


def chunks_after_commit(commits: DataFrame, chunk_path: str, buckets: int = CHUNK_BUCKETS) -> DataFrame:
    """run_id, chunk_index, ts and committed of the newest chunks that are later than the last commit of their run."""
    last = commits.groupBy("run_id").agg(F.max("ts").alias("committed"))
    found = committed_chunks(commits, chunk_path, buckets).join(last, "run_id").filter(F.col("ts") > F.col("committed"))
    return found.select("run_id", "chunk_index", "ts", "committed")


def commit_runs(commits: DataFrame, chunk_path: str, path: str, checkpoint: str, buckets: int = CHUNK_BUCKETS) -> StreamingQuery:
    """Calculate every run whose commit marker arrives, from the chunks stored by then.

    ``commits``: ts, run_id.  A repeated commit calculates the run again; readers take the newest result.
    """

    def calculate(df: DataFrame, batch: int) -> None:
        ready = committed_chunks(df, chunk_path, buckets)
        done = survey.complete_survey(run_measurements(ready), key="run_id")
        _write_batch(done, path, batch)

    return (
        commits.writeStream.outputMode("append")
        .foreachBatch(calculate)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
