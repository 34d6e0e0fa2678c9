"""Dedup of repeated byte strings by column-wise construction over a collection of pieces.

Symbols are inserted one per piece and round, from the last column to the first; after every round the pieces are in the
order of their suffixes from that column on, with the length of the common prefix of each and the one before it.  A
string that stands in two places is a common prefix of the asked length in one of the rounds.

The rounds are as many as the longest member of the collection, so whole documents (a hundred thousand rounds, each a
pass over all of the corpus) are not its members.  Members are the surroundings of anchors: of the 32-byte seeds in a
string of 100 bytes the one with the least hash.  Equal strings have equal anchors at equal places, so each string is
looked for among the pieces of one seed, in one column, and a piece has 168 columns at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreline.functions.blocks import durable
from boreline.llm import repeats, text
from boreline.llm.bits import bit_filter, passes

#: Bytes of a string that counts as repeated, and of the seeds in it.
LENGTH = 100
SEED = 32
#: Seeds in a string; also the starts that one anchor can have, and the column of the anchor in a piece.
SEEDS = LENGTH - SEED + 1
LEAD = SEEDS - 1
COLUMNS = LEAD + LENGTH
#: Pieces whose columns a task holds at once, and pieces of one seed from which on strings are told apart by hashes.
PIECES = 100_000
HOT = 500_000
_ABSENT = 0xFF
#: A run of starts: the first, then their number in the low bits.
_COUNT_BITS = 8
_POSITION = np.int64((1 << 30) - 1)


def _seeds(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place on, by doubling."""
    h, width = text.letters(2)[data], 1
    with np.errstate(over="ignore"):
        while width < SEED:
            h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 * (2 * width + 1) % (1 << 64) | 1) + (h[width:] ^ h[width:] >> np.uint64(31))
            width *= 2
        h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each anchor: its seed's hash, its text, its place, the first start of a string it is the anchor of, and their
    number, which are all in a row.  Places are in the bytes of all texts."""
    if len(data) < LENGTH:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4)))
    seeds = _seeds(data)
    # The place below the hash's upper bits makes the least one the first of equal ones, and says where it is.
    marked = (seeds >> np.uint64(31)).astype(np.int64) << 30 | np.arange(len(seeds))
    least, width = marked, 1
    while 2 * width <= SEEDS:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = SEEDS - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) & _POSITION
    starts = len(least)
    valid = np.ones(starts, bool)
    for a, b in zip(offsets[1:] - LENGTH + 1, offsets[1:], strict=True):
        valid[max(0, a) : b] = False
    edge = np.ones(starts, bool)
    edge[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(edge)
    count = np.diff(np.append(first, starts))
    first, count = first[valid[first]], count[valid[first]]
    at = least[first]
    return seeds[at], np.searchsorted(offsets, first, side="right") - 1, at, first, count


def _rows(batch: pa.RecordBatch):
    """The anchors of a batch of doc_id and text: bytes, anchors, their places in the documents, hashes of their pieces."""
    data, offsets = text.flat(batch.column(1))
    seed, doc, at, first, count = anchors(data, offsets)
    runs = (first - offsets[doc]) << _COUNT_BITS | count
    pieces = text.span_hashes(data, first, first + count - 1 + LENGTH, seed=3) ^ text.mix((at - first).astype(np.uint64))
    return data, seed, doc, at, first, count, repeats.places(batch.column(1), doc, runs), pieces


def _pieces(data: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.Array:
    sizes = count - 1 + LENGTH
    stops = np.concatenate([[0], np.cumsum(sizes)])
    body = data[np.arange(stops[-1]) + np.repeat(first - stops[:-1], sizes)]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(body)])


def insert_columns(groups: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """For every piece and start, whether an earlier piece of its group has the same string there.

    ``groups`` ascends, and pieces of one group are in order; ``matrix`` has their symbols, ``_ABSENT`` where a piece has
    none.  Each round takes one column: a stable sort by its symbol, then by group, turns the order of the suffixes from
    the next column on into that from this one on.  The common prefix of neighbours that begin with the same symbol is
    one more than the least one between them before.
    """
    n = len(groups)
    hit = np.zeros((n, SEEDS), bool)
    order = np.arange(n)
    prefix = np.zeros(n, np.uint8)
    small = (groups - groups[0]).astype(np.uint16 if groups[-1] - groups[0] < 1 << 16 else np.int64)
    for column in range(COLUMNS - 1, -1, -1):
        symbol = matrix[order, column]
        by_symbol = np.argsort(symbol, kind="stable")
        turn = by_symbol[np.argsort(small[order[by_symbol]], kind="stable")]
        before = prefix
        order, symbol = order[turn], symbol[turn]
        group = small[order]
        same = np.zeros(n, bool)
        same[1:] = (symbol[1:] == symbol[:-1]) & (group[1:] == group[:-1]) & (symbol[1:] != _ABSENT)
        prefix = np.zeros(n, np.uint8)
        at = np.flatnonzero(same)
        low, high = turn[at - 1] + 1, turn[at]
        near = low == high
        prefix[at[near]] = before[high[near]] + 1
        far = at[~near]
        if len(far):
            edges = np.stack([low[~near], high[~near] + 1], axis=1).ravel()
            prefix[far] = np.minimum.reduceat(np.append(before, np.uint8(255)), edges)[::2] + 1
        if column < SEEDS:
            equal = prefix >= LENGTH
            if equal.any():
                runs = np.flatnonzero(~equal)
                first = np.repeat(np.minimum.reduceat(order, runs), np.diff(np.append(runs, n)))
                hit[order, column] = order != first
    return hit


def _matrix(pieces: pa.Array, lead: np.ndarray) -> np.ndarray:
    data, offsets = text.flat(pieces)
    sizes = np.diff(offsets)
    matrix = np.full(len(sizes) * COLUMNS, _ABSENT, np.uint8)
    matrix[np.arange(len(data)) + np.repeat(COLUMNS * np.arange(len(sizes)) + LEAD - lead - offsets[:-1], sizes)] = data
    return matrix.reshape(-1, COLUMNS)


def _repeated_starts(table: pa.Table) -> pa.Table:
    """doc_id and place of the runs of starts whose strings stand in earlier pieces of the same seed."""
    table = table.combine_chunks()
    ids = table.column("doc_id")
    none = ids.is_null().to_numpy(zero_copy_only=False)
    key, seed, place = ids.fill_null(0).to_numpy(), table.column("h").to_numpy(), table.column("place").to_numpy()
    order = np.lexsort((place, key, none, seed))
    edge = np.ones(len(order), bool)
    edge[1:] = seed[order][1:] != seed[order][:-1]
    group = np.cumsum(edge) - 1
    several = np.bincount(group)[group] > 1
    order, group = order[several], group[several]
    rows, runs = [], []
    at = 0
    while at < len(order):
        # Whole groups, about so many pieces.
        to = int(np.searchsorted(group, group[min(at + PIECES, len(group)) - 1], side="right"))
        own = order[at:to]
        lead = table.column("lead").to_numpy()[own].astype(np.int64)
        pieces = table.column("piece").take(pa.array(own)).combine_chunks()
        hit = insert_columns(group[at:to], _matrix(pieces, lead))
        step = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, begin = np.nonzero(step == 1)
        _, end = np.nonzero(step == -1)
        first = (place[own] >> _COUNT_BITS)[row] + begin - (LEAD - lead[row])
        rows.append(own[row])
        runs.append(first << _COUNT_BITS | end - begin)
        at = to
    found = np.concatenate(rows) if rows else np.empty(0, np.int64)
    runs = np.concatenate(runs) if runs else np.empty(0, np.int64)
    return pa.table({"doc_id": table.column("doc_id").take(pa.array(found)).cast(pa.int64()), "place": pa.array(runs, pa.int64())})


def _owners(ids: pa.Array) -> np.ndarray:
    """The part that a doc_id has in the key of the filter: its bits folded into those that the filter reads."""
    ids = ids.fill_null(-1).to_numpy(zero_copy_only=False)
    return ids ^ ids >> 26 ^ ids >> 52


def _where_key():
    """The key of the filter for ``name``, ``place`` and ``doc_id``: copies of one piece have different ones."""
    ids = F.coalesce("doc_id", F.lit(-1).cast("long"))
    return F.col("name").bitwiseXOR(F.col("place")).bitwiseXOR(ids).bitwiseXOR(F.shiftright(ids, 26)).bitwiseXOR(F.shiftright(ids, 52))


def _cover(data: np.ndarray, found: np.ndarray) -> np.ndarray:
    first = found >> _COUNT_BITS
    return np.stack([first, first + (found & ((1 << _COUNT_BITS) - 1)) - 1 + LENGTH], axis=1)


def _single_starts(batches):
    """h, doc_id and place of each string of the pieces, for seeds with too many pieces for one task."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text.flat(batch.column(2))
        count = np.diff(offsets) - LENGTH + 1
        row = np.repeat(np.arange(batch.num_rows), count)
        start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        h = text.span_hashes(data, offsets[row] + start, offsets[row] + start + LENGTH, seed=4)
        place = ((batch.column(1).to_numpy() >> _COUNT_BITS)[row] + start) << _COUNT_BITS | 1
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(place)], ["h", "doc_id", "place"])


def remove_repeated_strings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of ``docs`` (doc_id, text): every byte goes that a string of
    100 bytes covers which also starts earlier, in a document of smaller doc_id (null is the largest) or before in its own.

    Texts are whole UTF-8 bytes, matches never cross documents, and strings are judged on the input.  A null text is
    empty.  Rows that agree in doc_id and text are one document; texts of under 100 bytes stay.

    1. The seeds of all anchors are counted; those that occur once are done.
    2. Anchors of the others are compared by a hash of their piece: of equal pieces all but the first are hit.
    3. The first of each different piece of a seed that has several, and no other copy, goes into the column-wise
       construction, which compares bytes.  Pieces of one seed meet in one task, many seeds in each; a seed with more than ``HOT`` different
       pieces has its strings joined by hash instead.
    """
    source = docs.select("doc_id", "text")
    context = docs.sparkSession.sparkContext

    def count(batches):
        for batch in text.slices(batches):
            seed = anchors(*text.flat(batch.column(0)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64))], ["h"])

    counted = source.select("text").mapInArrow(count, "h long").groupBy("h").agg(F.count("*").alias("n"))
    twice = context.broadcast(bit_filter(counted.filter("n > 1"), F.col("h")))

    def name(batches):
        for batch in text.slices(batches):
            _, seed, doc, _, _, _, place, piece = _rows(batch)
            keep = np.flatnonzero(passes(twice.value, seed))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed[keep].view(np.int64)), pa.array(piece[keep].view(np.int64)), batch.column(0).take(pa.array(doc[keep])), pa.array(place[keep])],
                ["h", "piece", "doc_id", "place"])

    named = durable(source.mapInArrow(name, "h long, piece long, doc_id long, place long"))
    where = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("place"))
    # Equal pieces have equal seeds at equal places, so the hash of the piece is enough.
    first = durable(named.groupBy("piece").agg(F.min("h").alias("h"), F.min(where).alias("first"), F.count("*").alias("n")))
    copied = first.filter("n > 1").select("piece", "first")
    copies = named.select("piece", "doc_id", "place").join(copied, "piece").filter(where != F.col("first")).select("doc_id", "place")
    several = first.groupBy("h").agg(F.count("*").alias("pieces")).filter("pieces > 1")
    several = durable(first.join(several, "h").select("h", F.col("piece").alias("name"), "first.doc_id", "first.place", "pieces"))
    wanted = context.broadcast(bit_filter(several, _where_key()))

    def fetch(batches):
        for batch in text.slices(batches):
            data, seed, doc, at, begin, number, place, piece = _rows(batch)
            keep = np.flatnonzero(passes(wanted.value, piece.view(np.int64) ^ place ^ _owners(batch.column(0))[doc]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed[keep].view(np.int64)), pa.array(piece[keep].view(np.int64)), batch.column(0).take(pa.array(doc[keep])), pa.array(place[keep]),
                 pa.array((at - begin)[keep].astype(np.int32)), _pieces(data, begin[keep], number[keep])],
                ["h", "name", "doc_id", "place", "lead", "piece"])

    # The filter lets others through, and rows that agree in doc_id and text come more than once.
    exact = ["name", "place", "owner", "none"]
    whose = (F.coalesce("doc_id", F.lit(0)).alias("owner"), F.col("doc_id").isNull().alias("none"))
    fetched = source.mapInArrow(fetch, "h long, name long, doc_id long, place long, lead int, piece binary").select("*", *whose)
    fetched = fetched.join(several.select("name", "place", *whose), exact, "left_semi").dropDuplicates(exact)
    warm = fetched = fetched.select("h", "doc_id", "place", "lead", "piece")
    hot = several.filter(F.col("pieces") > HOT).select("h").distinct()
    hits = copies
    if hot.limit(1).count():
        fetched = durable(fetched)
        warm = fetched.join(hot, "h", "left_anti")
        strings = fetched.join(hot, "h", "left_semi").select("doc_id", "place", "piece").mapInArrow(_single_starts, "h long, doc_id long, place long")
        hits = hits.unionByName(repeats.later(durable(strings)))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-several.count() // PIECES))
    warm = warm.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    hits = hits.unionByName(warm.groupBy("bucket").applyInArrow(_repeated_starts, "doc_id long, place long"))
    return repeats.without(docs, hits, _cover)


def op2_repeated_strings(spark, sf_dir):
    return repeats.digest(remove_repeated_strings(text.table(spark, sf_dir, "documents")))


QUERIES = {"op2_repeated_strings": op2_repeated_strings}
ORACLES: dict[str, str] = {}
