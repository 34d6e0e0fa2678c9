"""MinHash near-duplicates by SuperMinHash signatures: banding, verification on whole sets, and union-find."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreline.functions.blocks import durable
from boreline.llm import text
from boreline.llm.bits import bit_filter, passes
from boreline.llm.components import components
from boreline.llm.setjoin import COUNTERS, _counters, _levels, _summaries, shingles
from boreline.llm.setjoin import _name as set_name

#: Two sets link if this many hundredths of their union are common.
PERCENT = 85
BANDS = 32
BAND_ROWS = 6
#: Bits of a value below its round.
_FRACTION = 56
#: Sets that one union-find holds before it gives out what it has.
_UNITED = 1 << 18


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A SuperMinHash signature of ``size`` (at most 256) numbers for each set of 64-bit hashes, equal for equal sets.

    Every element draws a random permutation of the places and, in round j, offers j plus a random fraction at its j-th
    place; a place keeps its least offer.  One element's ranks so differ at all places, which lowers the variance of the
    share of equal places.  Offers of a round are all below those of the next, so a set is done with the round that fills
    its last place: about size * ln(size) offers in all, however large the set.  Empty sets have all bits set.
    """
    out = np.full((len(sets), size), ~np.uint64(0))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if len(owner) else np.empty(0, np.uint64)
    places, permuted = None, out.ravel()
    for j in range(size):
        if not len(owner):
            break
        with np.errstate(over="ignore"):
            draw = text.mix(elements + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        swap = j + ((draw >> np.uint64(32)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
        if places is None:
            at = swap
        else:
            rows = np.arange(len(owner))
            at = places[rows, swap].astype(np.int64)
            places[rows, swap] = places[rows, j]
        offer = text.mix(draw) >> np.uint64(64 - _FRACTION) | np.uint64(j << _FRACTION)
        np.minimum.at(permuted, owner * size + at, offer)
        open_ = (out == ~np.uint64(0)).any(axis=1)[owner]
        if places is None:
            owner, elements, swap = owner[open_], elements[open_], swap[open_]
            places = np.tile(np.arange(size, dtype=np.uint8), (len(owner), 1))
            places[np.arange(len(owner)), swap] = 0
        else:
            owner, elements, places = owner[open_], elements[open_], places[open_]
    return out


def _bands(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """band (a hash of its number and its values), set and n: so many rows for each set with words, copies too."""

    def make(batches):
        step = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1 for k in range(rows)], np.uint64)
        for batch in text.slices(batches, limit=text.SLICE_BYTES // 2):
            sets = [s for s in shingles(batch.column(0)) if len(s)]
            if not sets:
                continue
            signed = signatures(sets, bands * rows).reshape(len(sets), bands, rows)
            with np.errstate(over="ignore"):
                hashed = text.mix((text.mix(signed) * step).sum(axis=2) + np.arange(bands, dtype=np.uint64))
            names = np.array([set_name(s) for s in sets], np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashed.ravel().view(np.int64)), pa.array(np.repeat(names, bands)), pa.array(np.repeat(sizes, bands))], ["band", "set", "n"])

    return docs.select("text").mapInArrow(make, "band long, set long, n long")


def _shared(docs: DataFrame, *arrays: np.ndarray) -> list[Broadcast]:
    """Arrays of fixed size for all tasks, as little as they take: most are nearly empty for small tables."""
    return [docs.sparkSession.sparkContext.broadcast((zlib.compress(a.tobytes(), 1), a.dtype.str)) for a in arrays]


def _opened(shared: Broadcast) -> np.ndarray:
    body, kind = shared.value
    return np.frombuffer(zlib.decompress(body), kind)


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set and its shingles for the sets in ``wanted``, from one document each."""
    (shared,) = _shared(docs, bit_filter(wanted, F.col("set")))

    def make(batches):
        bits = _opened(shared)
        for batch in text.slices(batches):
            sets = shingles(batch.column(0))
            names = np.array([set_name(s) for s in sets], np.int64)
            keep = np.flatnonzero(passes(bits, names))
            yield pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["set", "shingles"])

    found = docs.select("text").mapInArrow(make, "set long, shingles binary").join(wanted, "set", "left_semi")
    return found.dropDuplicates(["set"])


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that link, judged on all their shingles."""
    wanted = durable(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct())
    sets = durable(_whole_sets(docs, wanted))

    def judge(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("set").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("set").alias("b"), F.col("shingles").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(judge, "a long, b long")


def _joined(links: DataFrame) -> DataFrame:
    """node and root over ``links``: every task first joins its own links by union-find, which leaves it one link a node,
    and stars join what the tasks found."""

    def unite(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def found() -> pa.RecordBatch:
            nodes = [x for x in parent if find(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
                if low != high:
                    parent[max(low, high)] = min(low, high)
            if len(parent) > _UNITED:
                yield found()
                parent.clear()
        yield found()

    return components(links.select("a", "b").mapInArrow(unite, "a long, b long"))


def group_documents(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, row (a key), n_shingles, set, root and component_id of every row of ``docs`` (doc_id, text).

    Two rows link if their sets of five-word shingles have a Jaccard similarity of ``percent`` hundredths or more;
    component_id is the smallest doc_id that a row reaches by links.

    1. Equal sets are one set from here on, known by a 64-bit hash of its shingles, which are 64-bit hashes themselves.
    2. Sets meet that agree in all rows of a band.  With 32 bands of 6 rows a pair of similarity 0.85 agrees in none with
       a chance of 3 in 10 million, a closer one with less.  That chance aside, no link is lost.
    3. In each band all sets are first compared with one head, that of most bands in common for each, so a large group of
       near copies costs a row for each set and band.  These links make components.
    4. Bands that still hold several components may hold crowds of sets that share a passage and don't link.  Their sets
       are told apart by their rarest shingles, see ``_apart``, so those that can't link don't meet; the others are
       compared by whole sets, each pair once.

    Null, empty and blank texts have no words and link with nothing.  Rows of one doc_id are documents of their own;
    component_id is null only where no row of the group has a doc_id.  Other columns of ``docs`` take no part.
    """
    source = docs.select("doc_id", "text")
    summaries = durable(_summaries(source))
    own = summaries.filter("piece IS NULL").select("doc_id", "row", "set", "n")
    signed = durable(_bands(source, bands, rows))
    twice = durable(signed.groupBy("band").agg(F.count("*").alias("_n")).filter("_n > 1").select("band"))
    met = durable(signed.join(twice.hint("shuffle_hash"), "band", "left_semi").distinct())

    heads = durable(met.groupBy("band").agg(F.min(F.struct("n", "set")).alias("head"), F.count("*").alias("_n")).filter("_n > 1").select("band", F.col("head.set").alias("head"), F.col("head.n").alias("head_n")))
    star = met.join(heads, "band").filter("set <> head").filter(F.expr(f"100 * head_n >= {percent} * n"))
    star = star.groupBy("set", "head").agg(F.count("*").alias("common")).groupBy("set").agg(F.max(F.struct("common", "head")).alias("best"))
    star = durable(star.select(F.col("best.head").alias("a"), F.col("set").alias("b")))
    links = durable(_verified(star, source, percent))
    roots = _joined(links)

    placed = met.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    # Bands whose sets are all of one component are closed.
    still = durable(placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band"))
    left = durable(placed.join(still, "band", "left_semi").select("set", "n", "root").distinct())
    pairs = durable(_apart(left, source, _levels(_counters(summaries)), percent))
    pairs = durable(pairs.join(star, ["a", "b"], "left_anti").join(star.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"))
    if pairs.limit(1).count():
        roots = _joined(links.unionByName(_verified(pairs, source, percent)))

    whole = own.join(roots.withColumnRenamed("node", "set"), "set", "left")
    whole = whole.withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "set")))
    lowest = durable(whole.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("lowest")))
    whole = whole.join(lowest, "root", "left")
    return whole.select("doc_id", "row", F.col("n").alias("n_shingles"), "set", "root", F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"))


def _apart(left: DataFrame, docs: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """Pairs (a, b) of the sets in ``left`` (set, n, root) that have different roots and may link, each once.

    In any one order of all shingles, sets that link share one of their first n - ceil(p n / 100) + 1 shingles, and the
    first that they share leaves both enough shingles for p hundredths of their union.  The rarest come first, by
    estimates of a fixed size, so what a crowd has in common is seldom among the first.
    """
    shared = _shared(docs, bit_filter(left, F.col("set")), levels)

    def make(batches):
        bits, level = map(_opened, shared)
        shift = np.uint64(64 - COUNTERS.bit_length() + 1)
        for batch in text.slices(batches):
            sets = [s for s in shingles(batch.column(0)) if len(s)]
            named = np.array([set_name(s) for s in sets], np.int64)
            lists, names, places = [], [], []
            for i in np.flatnonzero(passes(bits, named)) if len(sets) else ():
                found = sets[i]
                order = np.argsort(level[(found >> shift).astype(np.int64)], kind="stable")
                own = found[order[: len(found) - -(-percent * len(found) // 100) + 1]]
                lists.append(own)
                names.append(np.full(len(own), named[i]))
                places.append(np.arange(len(own)))
            if lists:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(lists).view(np.int64)), pa.array(np.concatenate(names)), pa.array(np.concatenate(places))], ["shingle", "set", "at"])

    listed = docs.select("text").mapInArrow(make, "shingle long, set long, at long").distinct().join(left, "set")
    # An entry can only be the first in common with a set of this size at most, and lists of one component join nothing.
    room = F.floor((F.lit(100 + percent) * (F.col("n") - F.col("at")) - F.lit(percent) * F.col("n")) / percent)
    listed = durable(listed.filter(room >= F.ceil(F.col("n") * percent / 100)))
    open_ = durable(listed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle"))
    listed = durable(listed.join(open_, "shingle", "left_semi"))
    x, y = listed.alias("x"), listed.alias("y")
    may = F.expr(
        f"x.shingle = y.shingle AND x.set < y.set AND x.root <> y.root AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) "
        f"AND {100 + percent} * least(x.n - x.at, y.n - y.at) >= {percent} * (x.n + y.n)")
    return x.join(y, may).select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct()


def op12_near_copies(spark, sf_dir):
    found = group_documents(text.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op12_near_copies": op12_near_copies}
ORACLES = {"op12_near_copies": r"""
    WITH RECURSIVE words AS MATERIALIZED (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS MATERIALIZED (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached AS (
        SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON e.a = r.other),
    lowest AS (SELECT doc_id, min(other) AS low FROM reached GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
    FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)"""}
