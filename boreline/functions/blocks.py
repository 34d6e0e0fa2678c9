"""Window functions along one well that still hold when one well has a large share of all rows.

A plain ``Window.partitionBy(well)`` puts every row of a well in one task.  That is the best plan while wells are
small (one shuffle, shared by every window), so it is used unless a source found a well of more than
``ROWS_PER_BLOCK`` rows.  In that case ``split_large_wells`` adds the column ``_block``, a coarse bucket of the row's
position, and every helper here works in two levels: rows are windowed inside ``(well, _block)``, one summary row
per block is windowed per well, and the carry is joined back.  Results do not depend on the split.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS_PER_BLOCK = 1 << 20
#: Block edges that are sent to every task; there is at least half a block of rows for each.
CUTS_TO_BROADCAST = 1 << 18
BLOCK = "_block"
#: Rows that a function on whole groups gets at a time.
ROWS_AT_ONCE = 1 << 16


def is_split(df: DataFrame) -> bool:
    return BLOCK in df.columns


def split_large_wells(
    df: DataFrame, keys: Sequence[str], position: str, rows_per_block: int | None = None
) -> DataFrame:
    """Add ``_block`` when the largest well exceeds a block; otherwise return ``df`` as it is.

    ``position`` is an integer column that orders each well.  Larger wells are cut at their own quantiles, so a block
    holds at most ``rows_per_block`` rows wherever the positions lie; only rows of one position stay together.  The
    quantiles are approximate, and twice as many as needed, with an error of a quarter of a block at most.  The check is
    one aggregation over the key column, the cut one more; call it on a stored table, not on a long computation.
    """
    limit = rows_per_block or ROWS_PER_BLOCK
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > limit).select(*keys)
    top, wells = sizes.filter(F.col("_n") > limit).agg(F.max("_n"), F.count(F.lit(1))).first()
    if not wells:
        return df
    blocks = 2 * -(-top // limit)
    at = F.percentile_approx(position, [k / blocks for k in range(1, blocks)], 4 * blocks)
    cuts = df.join(large, [*keys], "left_semi").groupBy(*keys).agg(at.alias("_cuts"))
    if wells * blocks <= CUTS_TO_BROADCAST:
        cuts = F.broadcast(cuts)
    found = F.size(F.filter("_cuts", lambda cut: cut < F.col(position)))
    return df.join(cuts, [*keys], "left").withColumn(BLOCK, F.coalesce(found, F.lit(0)).cast("bigint")).select(*df.columns, BLOCK)


def block_column(df: DataFrame) -> list[str]:
    """``["_block"]`` for a split table, else nothing: to be selected beside the other columns."""
    return [BLOCK] if is_split(df) else []


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share: the session's ``spark.checkpoint.dir``.  Only a local session may go without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and read it back.

    The written table survives the loss of executors, cuts the lineage of loops, and gives readers column pruning and
    true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/boreline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def forget(*tables: DataFrame) -> None:
    """Delete what ``durable`` wrote, once nothing that is still to be computed reads it."""
    for df in tables:
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(df._kept_at)
        place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="boreline-checkpoint-")


def stack(keys: Sequence[str], first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name, hashed afresh on the keys, for use by operators on these keys.

    Spark 4.1 takes a union of equally hashed inputs for hashed and plans no exchange above it, while adaptive
    execution may coalesce the inputs differently; the exchange of ``spread`` keeps the rows of a key together.
    """
    for other in others:
        first = first.unionByName(other)
    return spread(first, [*keys, *block_column(first)])


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash on the keys into all shuffle partitions.

    Adaptive execution merges partitions by their bytes.  Where a small row carries much work (a Python kernel, a
    search) that would leave most cores idle; a stated number of partitions is kept.  It is one more than the number
    the planner uses itself: with the same number an exchange of the planner below would count as this one, and be
    merged all the same.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    return df.repartition(count, *keys)


def in_whole_groups(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], work: Callable, schema: str, at_once: int = ROWS_AT_ONCE
) -> DataFrame:
    """Rows made by ``work`` from many whole groups at a time: a Python call for each of many small groups would cost
    more than the work itself.

    ``work(rows, begins)`` gets a pandas table of ``columns`` in the order of the group and of ``columns[0]``, with
    the group's number ``_group``, and the places at which groups begin and, last, end.  It returns a table of
    ``_group`` and the columns of ``schema``, before which the keys are put.  Groups are added up to ``at_once`` rows.
    """
    one_row = spread(df.select(*keys, *columns), keys).groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    made = StructType.fromDDL(schema)
    count, order = len(keys), columns[0]

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = list(to_arrow_schema(made))
        for whole in batches:
            sizes = np.diff(whole.column(count).offsets.to_numpy())
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // at_once)) + 1
            for at, to in zip([0, *cuts], [*cuts, whole.num_rows], strict=True):
                batch = whole.slice(at, to - at)
                flat = batch.column(count).flatten()
                rows = pd.DataFrame({c: flat.field(c).to_numpy(zero_copy_only=False) for c in columns})
                rows["_group"] = np.repeat(np.arange(to - at), sizes[at:to])
                rows = rows.iloc[np.lexsort((rows[order].to_numpy(), rows["_group"].to_numpy()))].reset_index(drop=True)
                out = work(rows, np.concatenate([[0], np.cumsum(sizes[at:to])]))
                owner = pa.array(out["_group"].to_numpy(dtype=np.int64))
                arrays = [batch.column(k).take(owner) for k in range(count)]
                arrays += [pa.array(out[f.name], type=f.type, from_pandas=True) for f in fields]
                yield pa.RecordBatch.from_arrays(arrays, [*keys, *(f.name for f in fields)])

    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return one_row.mapInArrow(run, f"{head}, {schema}")


def _along(df: DataFrame, keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, *([BLOCK] if is_split(df) else [])).orderBy(*order)


def _across(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(BLOCK)


def _neighbour(df, keys, order, columns, prefix, forward):
    step = F.lead if forward else F.lag
    if not is_split(df):
        window = _along(df, keys, order)
        return df.select(*df.columns, *[step(c).over(window).alias(prefix + c) for c in columns])
    value = F.struct(*[F.col(c) for c in columns])
    rank = F.struct(*[F.col(c) for c in order])
    edge = F.min_by(value, rank) if forward else F.max_by(value, rank)
    carry = (
        df.groupBy(*keys, BLOCK)
        .agg(edge.alias("_edge"))
        .select(*keys, BLOCK, step("_edge").over(_across(keys)).alias("_carry"))
        .filter("_carry IS NOT NULL")
    )
    near = df.withColumn("_near", step(value).over(_along(df, keys, order)))
    joined = near.join(carry, [*keys, BLOCK], "left")
    pick = F.coalesce("_near", "_carry")
    return joined.select(*df.columns, *[pick.getField(c).alias(prefix + c) for c in columns])


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    """Add the previous row's ``columns``; null on the first row of a well."""
    return _neighbour(df, keys, order, columns, prefix, forward=False)


def with_next(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], prefix: str = "next_"
) -> DataFrame:
    """Add the next row's ``columns``; null on the last row of a well."""
    return _neighbour(df, keys, order, columns, prefix, forward=True)


def with_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str | Column]
) -> DataFrame:
    """Add inclusive running sums ``{new column: summed expression}``."""
    exprs = {name: F.col(e) if isinstance(e, str) else e for name, e in sums.items()}
    local = _along(df, keys, order).rowsBetween(Window.unboundedPreceding, 0)
    kept = [c for c in df.columns if c not in exprs]
    if not is_split(df):
        return df.select(*kept, *[F.sum(e).over(local).alias(n) for n, e in exprs.items()])
    across = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, BLOCK).agg(*[F.sum(e).alias(n) for n, e in exprs.items()])
    carry = totals.select(*keys, BLOCK, *[F.sum(n).over(across).alias("_carry_" + n) for n in exprs])
    out = df.select(*kept, *[F.sum(e).over(local).alias("_here_" + n) for n, e in exprs.items()])
    joined = out.join(carry, [*keys, BLOCK])
    return joined.select(
        *kept,
        *[
            F.when(F.col("_carry_" + n).isNull(), F.col("_here_" + n))
            .otherwise(F.col("_carry_" + n) + F.coalesce(F.col("_here_" + n), F.lit(0)))
            .alias(n)
            for n in exprs
        ],
    )


def with_running_max_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str | Column, name: str
) -> DataFrame:
    """Add the maximum of ``column`` over all earlier rows of the well (null on the first)."""
    expr = F.col(column) if isinstance(column, str) else column
    before = Window.unboundedPreceding, -1
    local = df.withColumn(name, F.max(expr).over(_along(df, keys, order).rowsBetween(*before)))
    if not is_split(df):
        return local
    carry = (
        df.groupBy(*keys, BLOCK)
        .agg(F.max(expr).alias("_top"))
        .select(*keys, BLOCK, F.max("_top").over(_across(keys).rowsBetween(*before)).alias("_carry"))
    )
    joined = local.join(carry, [*keys, BLOCK])
    return joined.select(*df.columns, F.greatest(name, "_carry").alias(name))


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "seq", total: str | None = None
) -> DataFrame:
    """Add a zero-based dense position per well, and optionally the number of rows of the well."""
    kept = [c for c in df.columns if c != name]
    here = (F.row_number().over(_along(df, keys, order)) - 1).cast("bigint")
    if not is_split(df):
        extra = [F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias(total)] if total else []
        return df.select(*kept, here.alias(name), *extra)
    counts = df.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    carry = counts.select(
        *keys,
        BLOCK,
        F.coalesce(F.sum("_n").over(_across(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_skip"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"),
    )
    joined = df.withColumn("_here", here).join(carry, [*keys, BLOCK])
    extra = [F.col("_all").alias(total)] if total else []
    return joined.select(*kept, (F.col("_here") + F.col("_skip")).cast("bigint").alias(name), *extra)
