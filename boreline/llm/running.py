"""Running totals over a whole table without a window that one task would have to hold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boreline.functions.blocks import durable


def before(df: DataFrame, order: Sequence[Column], value: str, into: str) -> DataFrame:
    """Adds ``into``: the sum of the whole numbers in ``value`` over all rows that come earlier in ``order``.

    Rows are dealt out by range and sorted; every task adds up its own rows, and the totals of the tasks (as many rows
    as tasks) shift the later ones.  ``order`` must tell rows apart, or tied rows may share their places in any way.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField(into, T.LongType())])

    def add(batches):
        task, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(value)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            run = total + np.cumsum(values)
            total = int(run[-1]) if len(run) else total
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(run), task, np.int32)), pa.array(run - values)],
                names=[*batch.schema.names, "_task", into])

    local = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema))
    totals = local.groupBy("_task").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_task", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    # As many rows as tasks of one stage, so their size is bounded.
    return local.join(F.broadcast(shift), "_task").withColumn(into, F.col(into) + F.col("_shift")).drop("_task", "_shift")
