"""Values that occur more than once in a corpus, and documents without the parts that do."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreline.functions.blocks import durable
from boreline.llm import text

#: A place in a document: a hash of its text above, the place below.  Rows of one doc_id with different texts so stay apart.
PLACE_BITS = 40


def places(column: pa.Array, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``place`` in the texts number ``doc`` of ``column``, as one number each."""
    return (_marks(column)[doc] << PLACE_BITS) | place


def _marks(column: pa.Array) -> np.ndarray:
    data, offsets = text.flat(column)
    body = memoryview(np.ascontiguousarray(data))
    return np.array([zlib.crc32(body[a:b]) & 0x7FFFFF for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)


def repeated(rows: DataFrame) -> DataFrame:
    """The rows whose ``h`` other rows have too.

    Counts are summed up before the shuffle.  The found ones are written, so that both sides of the join are plain
    shuffles, whose rows adaptive execution can split where one ``h`` holds many of them.
    """
    twice = durable(rows.groupBy("h").agg(F.count("*").alias("_n")).filter("_n > 1").select("h"))
    return rows.join(twice.hint("shuffle_hash"), "h", "left_semi")


def later(rows: DataFrame) -> DataFrame:
    """doc_id and place of the rows (h, doc_id, place) that are not the first of their ``h``: by doc_id, null last, then
    by place."""
    where = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("place"))
    first = rows.groupBy("h").agg(F.min(where).alias("_first"))
    return rows.join(first, "h").filter(where != F.col("_first")).select("doc_id", "place")


def without(docs: DataFrame, places: DataFrame, cover: Callable) -> DataFrame:
    """doc_id and text of ``docs`` with the bytes taken out that ``cover`` marks: n_bytes, n_removed, n_spans, kept.

    ``places``: doc_id and place.  ``cover(data, places)`` gets the bytes of one text and its places, ascending, and
    returns ranges of bytes; a document without places stays whole.  ``kept`` is binary, as a range may cut a character.
    """
    marked = places.groupBy("doc_id").agg(F.array_sort(F.collect_set("place")).alias("_places")).withColumnRenamed("doc_id", "_doc")
    joined = docs.select("doc_id", "text").join(marked, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", "text", "_places")

    def cut(batches):
        for batch in text.slices(batches):
            column, own = batch.column(1), batch.column(2)
            data, offsets = text.flat(column)
            marks = _marks(column)
            at, listed = np.diff(own.offsets.to_numpy()), own.flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(np.where(own.is_valid().to_numpy(zero_copy_only=False), at, 0))])
            removed, runs, kept = np.zeros(len(marks), np.int64), np.zeros(len(marks), np.int64), []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                found = listed[at[i] : at[i + 1]]
                found = found[found >> PLACE_BITS == marks[i]] & ((1 << PLACE_BITS) - 1)
                if not len(found):
                    kept.append(data[a:b].tobytes())
                    continue
                change = np.zeros(b - a + 1, np.int32)
                ranges = cover(data[a:b], found)
                np.add.at(change, ranges[:, 0], 1)
                np.add.at(change, ranges[:, 1], -1)
                out = np.cumsum(change[:-1]) > 0
                removed[i] = out.sum()
                runs[i] = out[:1].sum() + (out[1:] & ~out[:-1]).sum()
                kept.append(data[a:b][~out].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
