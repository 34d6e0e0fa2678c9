"""Texts as bytes: words, hashes of words, and slices of Arrow batches that bound the memory of a task."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a kernel holds at once; a longer text is held alone.
SLICE_BYTES = 1 << 20

#: Java and RE2 pattern of a word that ends at white space.
SPACED = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column) -> Column:
    """A column whose crc32 of the text form decides the held-out rows; null counts as the text ``null``."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("null")).cast("binary"))


def _class(*ranges: tuple[int, int], outside: bool) -> np.ndarray:
    table = np.full(256, outside)
    for low, high in ranges:
        table[low : high + 1] = not outside
    return table


#: Bytes inside a word, for words that end at white space and for words of letters, digits and non-ASCII.
SPACE_WORDS = _class((0x20, 0x20), (0x09, 0x0D), outside=True)
LETTER_WORDS = _class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), outside=True)

#: Lower case of A to Z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    _, starts, body = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1] if starts else np.zeros(1, np.int64)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def release() -> None:
    """Gives back to the system what Arrow and the C library hold for later use, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than that of GNU
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of at most ``limit`` bytes of text, or of one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    release()


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the number of words before each text (one entry more than texts)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    is_in = inside[data]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = False, is_in[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, is_in[1:]
    after[edge - 1] = False
    starts = np.flatnonzero(is_in & ~before)
    ends = np.flatnonzero(is_in & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit number over all others."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


@functools.cache
def letters(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * seed)) * np.uint64(_BASE))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base modulo 2**64, and their inverses."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _POWERS[name] = np.multiply.accumulate(run)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every span of bytes, equal for equal spans wherever they stand."""
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters(seed)[data] * up[: len(data)], out=run[1:])
        return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def row_key() -> Column:
    """A number that tells rows of documents apart, but for those that agree in doc_id and text."""
    return F.xxhash64("doc_id", "text")


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """Each row of ``docs`` as one struct, ``_doc``, beside ``columns``, so that names in it cannot clash with others."""
    return docs.select(F.struct("*").alias("_doc"), *columns)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` packed, with its row key, ``_row``, and the number from 1 of each row among those of its key, ``_nth``."""
    keyed = packed(docs, row_key().alias("_row"))
    return keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("_row").orderBy("_row")))


def texts_only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns of any name cannot clash with those that an operator adds."""
    return df.select(*[F.col(c) for c in columns])
