"""Compression of vectors to one codebook index per part, by ball k-means in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boreline.functions.blocks import durable
from boreline.llm import text

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: A component x is the whole number floor(SCALE * x).
SCALE = 256
#: Components of at most so much, times SCALE, keep every squared distance of parts of up to 1024 within 64 bits.
LARGEST = 1 << 24
#: Components that a kernel holds at once.
CELLS = 1 << 20


class Ball:
    """The entries of one part position, and the distances between them.

    All distances are squares of whole numbers, so bounds and ties are exact.  With d(x, own) <= rho, the triangle
    inequality leaves as nearest entries, ties included, only those with d(own, other) <= 2 rho.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        difference = entries[:, None, :] - entries[None, :, :]
        apart = (difference * difference).sum(axis=2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        # The axis along which entries differ most gives a first guess.
        axis = int(np.argmax(entries.max(axis=0) - entries.min(axis=0)))
        along = np.argsort(entries[:, axis], kind="stable")
        self.axis, self.along, self.steps = axis, along, entries[along, axis]

    def guess(self, parts: np.ndarray) -> np.ndarray:
        """An entry near each part along one axis."""
        at = np.searchsorted(self.steps, parts[:, self.axis])
        return self.along[np.minimum(at, len(self.along) - 1)]

    def nearest(self, parts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, ties to the lower index, and the squared distance, from any entry ``own``.

        The parts of one ball are sorted into rings by how many neighbour entries, nearest first, may be as near as
        their own; those in no ring are the stable core, and the t-th neighbour meets the rings that reach it only.
        The widest ring is that of the ball's radius, so entries that are no neighbours of the ball are never met.
        """
        own = own.astype(np.int64)
        offset = parts - self.entries[own]
        best_distance = (offset * offset).sum(axis=1)
        best = own.copy()
        by_ball = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[by_ball], np.arange(len(self.entries) + 1))
        for ball in range(len(self.entries)):
            members = by_ball[edges[ball] : edges[ball + 1]]
            if not len(members):
                continue
            rings = np.searchsorted(self.apart[ball], 4 * best_distance[members], side="right")
            out = np.argsort(-rings, kind="stable")
            members, rings = members[out], rings[out]
            # How many parts lie in a ring that reaches the t-th entry in order of distance.
            reach = np.searchsorted(-rings, -np.arange(1, int(rings[0]) + 1), side="right")
            for t, count in enumerate(reach.tolist()):
                other = int(self.order[ball, t])
                if other == ball:
                    continue
                some = members[:count]
                offset = parts[some] - self.entries[other]
                distance = (offset * offset).sum(axis=1)
                closer = (distance < best_distance[some]) | ((distance == best_distance[some]) & (other < best[some]))
                best[some[closer]] = other
                best_distance[some[closer]] = distance[closer]
        return best, best_distance


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and ``ints``, floor(256 * x) of each component, of the rows of ``vectors`` that have a vector.

    Out go vectors that are null or empty, or hold a component that is null, not finite or beyond ``LARGEST / SCALE``.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST / SCALE))
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).filter(finite & (F.size("embedding") > 0))
    return kept.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * SCALE).cast("int")).alias("ints"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows, those of fewer components filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _round(rows: DataFrame, books: np.ndarray, last: bool) -> DataFrame:
    """``rows`` with the index of the nearest entry of each part as ``codes``, and behind them, for the next round, the
    count and the sum of each task's parts by entry, in one row; in the ``last`` round the ``error`` of each row."""
    parts, _, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast([Ball(book) for book in books])  # PARTS * ENTRIES entries
    names = ["vec_id", "label", "ints", "codes", "error", "sums"]
    kinds = [rows.schema["vec_id"].dataType, rows.schema["label"].dataType, T.ArrayType(T.IntegerType()), T.BinaryType(), T.LongType(), T.BinaryType()]
    at_once = max(1, CELLS // (parts * width))

    def assign(batches):
        sums, types = np.zeros((parts, books.shape[1], width + 1), np.int64), []
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                batch = whole.slice(at, at_once)
                types = [column.type for column in batch.columns[:3]]
                matrix = _matrix(batch.column(2), parts * width).reshape(-1, parts, width)
                known = batch.schema.get_field_index("codes")
                before = None
                if known >= 0:
                    before = np.frombuffer(b"".join(batch.column(known).to_pylist()), np.uint8).reshape(-1, parts)
                codes = np.empty((len(matrix), parts), np.uint8)
                error = np.zeros(len(matrix), np.int64)
                for p, ball in enumerate(shared.value):
                    own = np.ascontiguousarray(matrix[:, p])
                    codes[:, p], distance = ball.nearest(own, ball.guess(own) if before is None else before[:, p])
                    error += distance
                    if not last:
                        for c in range(width):
                            # Below 2**53, so the sums of a kernel are exact in double precision.
                            sums[p, :, c] += np.bincount(codes[:, p], own[:, c], books.shape[1]).astype(np.int64)
                        sums[p, :, width] += np.bincount(codes[:, p], minlength=books.shape[1])
                yield pa.RecordBatch.from_arrays([
                    *(pa.nulls(len(matrix), batch.column(2).type) if last and k == 2 else batch.column(k) for k in range(3)),
                    pa.array([row.tobytes() for row in codes], pa.binary()), pa.array(error), pa.nulls(len(matrix), pa.binary())], names)
        if types and not last:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, kind) for kind in (*types, pa.binary(), pa.int64())), pa.array([sums.tobytes()], pa.binary())], names)

    return rows.mapInArrow(assign, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries at floor(sum / count) of the parts assigned to them; unused entries stay."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * entries * (width + 1), object)
        for batch in batches:
            for part in batch.column(0):
                total = total + np.frombuffer(part.as_buffer(), np.int64).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, total))], pa.string())], ["total"])

    # A row of fixed size for each task of the round, added up by one group as they stream by.
    found = rows.filter("sums IS NOT NULL").select("sums").groupBy().applyInArrow(add, "total string").first()
    if found is None:
        return books
    total = np.array([int(x) for x in found["total"].split(",")], object).reshape(parts, entries, width + 1)
    moved = books.copy()
    used = total[:, :, width] > 0
    moved[used] = (total[:, :, :width][used] // total[:, :, width:][used]).astype(np.int64)
    return moved


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (two hex digits a part) and error of every row of ``vectors`` (vec_id, embedding, label) that
    ``whole_vectors`` keeps, and the codebooks: parts x entries x width whole numbers.

    Vectors are cut into ``parts`` equal consecutive parts; shorter ones, and all if the longest can't be cut so, are
    filled up with zeros.  A codebook starts as that part of the first ``entries`` (at most 256) rows by vec_id, nulls
    last, equal ids by vector; with fewer rows it has fewer entries.  Repeated rows count as often as they occur.
    Each of ``rounds`` rounds assigns all parts and moves the entries to floor(sum / count); parts are assigned once
    more at the end.  From the second assignment on, the balls are those of the one before.  An empty table gives an
    empty one and codebooks without entries.
    """
    rows = durable(whole_vectors(vectors).select("vec_id", "label", "ints"))
    longest = rows.agg(F.max(F.size("ints"))).first()[0] or 0
    width = -(-longest // parts)
    first = [r["ints"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()]
    if not first:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    books = np.array([r + [0] * (parts * width - len(r)) for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds):
        found = durable(_round(rows, books, last=False))
        books = _moved(found, books)
        rows = found.filter("sums IS NULL").select("vec_id", "label", "ints", "codes")
    coded = _round(rows, books, last=True)
    return coded.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error"), books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir):
    """The codes of all embeddings, with the error summed over equal labels, nulls together."""
    coded, books = compress(text.table(spark, sf_dir, "embeddings"))
    coded = durable(coded)
    # Written, so that the join is a plain one, which may be split where one label holds many rows.
    sums = durable(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "_label")
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _assigned(books: str) -> str:
    return f"""
        SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
            SELECT c.vec_id, c.p, b.e, list_sum(list_transform(list_zip(c.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
            FROM cut c JOIN {books} b USING (p)) GROUP BY vec_id, p"""


def _updated(books: str, assigned: str) -> str:
    return f"""
        SELECT b.p, b.e, CASE WHEN s.part IS NULL THEN b.part ELSE s.part END AS part
        FROM {books} b LEFT JOIN (
            SELECT p, e, list(CAST(floor(s::DOUBLE / n) AS BIGINT) ORDER BY i) AS part FROM (
                SELECT a.p, a.e, i, sum(c.part[i]) AS s, count(*) AS n
                FROM {assigned} a JOIN cut c USING (vec_id, p), (SELECT unnest(range(1, 5)) AS i) GROUP BY ALL)
            GROUP BY p, e) s ON s.p = b.p AND s.e = b.e"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
#: For vectors of 64 components with different ids; sums are far below 2**53.
ORACLES = {"op11_vector_codes": f"""
    WITH kept AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    cut AS MATERIALIZED (SELECT vec_id, p, v[p * 4 + 1 : p * 4 + 4] AS part FROM kept, (SELECT unnest(range(16)) AS p)),
    book0 AS MATERIALIZED (
        SELECT p, e, part FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < 64),
    near0 AS MATERIALIZED ({_assigned("book0")}),
    book1 AS MATERIALIZED ({_updated("book0", "near0")}),
    near1 AS MATERIALIZED ({_assigned("book1")}),
    book2 AS MATERIALIZED ({_updated("book1", "near1")}),
    near2 AS MATERIALIZED ({_assigned("book2")}),
    coded AS MATERIALIZED (
        SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY vec_id),
    digest AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM coded JOIN kept USING (vec_id), digest"""}
