"""A filter of one bit per hashed value, of fixed size, that spares work and never decides a result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: at most 8 MB are sent to a task, and at most a million words to the driver, however many values.
BITS = 1 << 26


def bit_filter(values: DataFrame, value: Column) -> np.ndarray:
    """The filter of all ``value`` (long) in ``values``."""
    places = values.select(F.pmod(value, F.lit(BITS)).alias("bit"))
    words = places.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """True for every value that is in the filter, and for some others."""
    place = values.view(np.int64) % BITS
    return (bits[place >> 6] >> (place & 63) & 1).astype(bool)
