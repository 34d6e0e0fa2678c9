"""N-gram Jaccard join by a size-aware heavy-light method: subsets of small sets, inverted lists of large ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreline.functions.blocks import durable
from boreline.llm import text
from boreline.llm.bits import bit_filter, passes
from boreline.llm.components import components

SHINGLE = 5
#: Two sets link if this many hundredths of their union are common.
PERCENT = 80
#: Shingles in a subset of a small set.
SUBSET = 2
#: Sets of more shingles are never small: their subsets outnumber any saving.
SMALL_AT_MOST = 64
#: Counters that estimate how common a shingle is.  Fixed, so they may be broadcast; they order shingles, and no result
#: depends on them.
COUNTERS = 1 << 20
_PIECES = 256
#: Sizes of one band are at most so many times each other.
BAND = 1.02
_AT_BITS = 24


def shingles(column: pa.Array) -> list[np.ndarray]:
    """Per text the sorted hashes of its different shingles: five words in a row, all words of a text with fewer."""
    data, offsets = text.flat(column)
    lowered = text.LOWER[data]
    starts, ends, first = text.spans(lowered, offsets, text.SPACE_WORDS)
    words = text.span_hashes(lowered, starts, ends)
    counts = np.diff(first)
    step = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1 for k in range(SHINGLE)], np.uint64)
    n = max(0, len(words) - SHINGLE + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        runs += text.mix(words[k : k + n] + np.uint64(k)) * step[k]
    runs = text.mix(runs)
    sets = []
    for a, size in zip(first[:-1].tolist(), counts.tolist(), strict=True):
        if size >= SHINGLE:
            sets.append(np.unique(runs[a : a + size - SHINGLE + 1]))
        elif size:
            whole = sum(int(w) * int(s) for w, s in zip(text.mix(words[a : a + size] + np.uint64(size << 8)), step, strict=False))
            sets.append(text.mix(np.array([whole % (1 << 64)], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def _name(found: np.ndarray) -> int:
    """A 64-bit name of a set, the same for equal sets; 0 for the empty one."""
    if not len(found):
        return 0
    return int(text.mix(np.array([text.mix(found + np.uint64(len(found))).sum()], np.uint64)).view(np.int64)[0]) or 1


def _required(n: int) -> int:
    """Common shingles that a set of ``n`` has at least with any set it links with."""
    return -(-PERCENT * n // 100)


def _prefix(n: int, common: int) -> int:
    """Two linked sets share ``common`` of their so many first shingles, in any one order of all shingles."""
    return min(n, n - _required(n) + common)


def _summaries(docs: DataFrame) -> DataFrame:
    """doc_id, row, set and n of every row, and at the end of each task its counters, in pieces."""

    def make(batches):
        counters = np.zeros(COUNTERS, np.int32)
        for batch in text.slices(batches):
            sets = shingles(batch.column(2))
            for found in sets:
                if len(found):
                    # Shingles of one set that fall on one counter count once, which only lowers an estimate.
                    counters[(found >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)] += 1
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
        if counters.any():
            pieces = counters.reshape(_PIECES, -1)
            yield pa.RecordBatch.from_arrays([
                *(pa.nulls(_PIECES, pa.int64()) for _ in range(4)),
                pa.array(np.arange(_PIECES, dtype=np.int32)), pa.array([p.astype("<i4").tobytes() for p in pieces], pa.binary())], names)

    names = ["doc_id", "row", "set", "n", "piece", "counters"]
    layout = "doc_id long, row long, set long, n long, piece int, counters binary"
    return docs.select("doc_id", text.row_key().alias("row"), "text").mapInArrow(make, layout)


def _counters(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters; each group of pieces is added up as it streams by."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, piece = np.zeros(COUNTERS // _PIECES, np.int64), None
        for batch in batches:
            for number, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                piece = number
                total += np.frombuffer(part.as_buffer(), "<i4")
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["piece", "counters"])

    pieces = rows.filter("piece IS NOT NULL").select("piece", "counters").groupBy("piece").applyInArrow(add, "piece int, counters binary")
    out = np.zeros(COUNTERS, np.int64)
    for row in pieces.collect():
        out.reshape(_PIECES, -1)[row["piece"]] = np.frombuffer(row["counters"], np.int64)
    return out


def _levels(counters: np.ndarray) -> np.ndarray:
    """How common the shingles on each counter are, in powers of two above what chance puts on a counter."""
    usual = np.median(counters)
    over = np.maximum(0, counters - usual - 4 * np.sqrt(usual + 1))
    return np.ceil(np.log2(1 + over)).astype(np.uint8)


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The largest size of a small set: where the rows of all subsets of the small sets, and all list entries of the
    others times the entries each of them meets, are fewest.  Sets near the boundary pay for both."""
    best, cost = 3, None
    large = {n: _prefix(n, 1) * list_length for n in sizes}
    everything = sum(sizes[n] * large[n] for n in sizes)
    for at in range(3, SMALL_AT_MOST + 1):
        subsets = sum(c * math.comb(_prefix(n, SUBSET), SUBSET) for n, c in sizes.items() if 3 < n <= at)
        lists = everything - sum(c * large[n] for n, c in sizes.items() if 100 * n <= PERCENT * at)
        if cost is None or subsets + lists < cost:
            best, cost = at, subsets + lists
    return best


def _signatures(docs: DataFrame, levels, most: int) -> DataFrame:
    """sig, set and size: of small sets the subsets of their first shingles, of large ones, and of those small ones that a
    large one may link with, the first shingles themselves.  The rarest shingles come first.  ``size`` is the set's, and
    below it, in ``_AT_BITS``, how many of its shingles come before (0 for a subset)."""
    pair_salt = np.uint64(0xD1B54A32D192ED03)

    def make(batches):
        shift = np.uint64(64 - COUNTERS.bit_length() + 1)
        level = levels.value
        for batch in text.slices(batches):
            sigs, names, sizes = [], [], []
            for found in shingles(batch.column(0)):
                n = len(found)
                if n <= 3:
                    continue  # these link with equal sets only
                order = np.argsort(level[(found >> shift).astype(np.int64)], kind="stable")
                if n <= most:
                    part = np.sort(found[order[: _prefix(n, SUBSET)]])
                    i, j = np.triu_indices(len(part), 1)
                    sigs.append(text.mix(part[i] * pair_salt + text.mix(part[j])))
                    sizes.append(np.full(len(i), n << _AT_BITS))
                    names.append(np.full(len(i), _name(found)))
                if 100 * n > PERCENT * most:
                    own = found[order[: _prefix(n, 1)]]
                    sigs.append(own)
                    sizes.append(n << _AT_BITS | np.arange(len(own)))
                    names.append(np.full(len(own), _name(found)))
            if names:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(names)), pa.array(np.concatenate(sizes))], ["sig", "set", "size"])

    return docs.select("text").mapInArrow(make, "sig long, set long, size long")


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set, n, bits (a bitmap, see ``_bitmap``) and shingles, for the sets in ``wanted``, from one document each.

    The filter only spares work: a set that passes it by chance goes in the semi join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, F.col("set")))

    def make(batches):
        bits = shared.value
        for batch in text.slices(batches):
            sets = shingles(batch.column(0))
            names = np.array([_name(s) for s in sets], np.int64)
            keep = np.flatnonzero(passes(bits, names))
            yield pa.RecordBatch.from_arrays([
                pa.array(names[keep]), pa.array([len(sets[i]) for i in keep], pa.int64()), pa.array([_bitmap(sets[i]) for i in keep], pa.binary()),
                pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["set", "n", "bits", "shingles"])

    found = docs.select("text").mapInArrow(make, "set long, n long, bits binary, shingles binary").join(wanted, "set", "left_semi")
    # Copies are put away by the first of each set in any task, then overall.
    return found.dropDuplicates(["set"])


def _bitmap(found: np.ndarray) -> bytes:
    """A bit for every shingle by its upper bits, four to eight times as many bits as shingles."""
    bits = np.zeros(1 << max(6, (4 * len(found) - 1).bit_length()), np.uint8)
    bits[(found >> np.uint64(65 - len(bits).bit_length())).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _cannot_link(x: np.ndarray, y: np.ndarray, n: int, m: int) -> bool:
    """Whether bitmaps show that sets of ``n`` and ``m`` shingles don't link: a bit that only one has is a shingle that
    only it has."""
    while len(x) != len(y):
        # Halve the larger one: neighbouring bits become one.
        large = np.unpackbits(max(x, y, key=len)).reshape(-1, 2).max(axis=1)
        x, y = (np.packbits(large), y) if len(x) > len(y) else (x, np.packbits(large))
    common = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return (100 + PERCENT) * common < PERCENT * (n + m)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, judged on all their shingles.

    Bitmaps, a sixteenth of the size, first rule out most of those that don't.
    """

    def rule_out(batches):
        for batch in batches:
            a, b, n, m = (batch.column(k).to_pylist() for k in range(4))
            x, y = ([np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column(k)] for k in (4, 5))
            keep = [not _cannot_link(x[i], y[i], n[i], m[i]) for i in range(len(a))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    small = [sets.select(F.col("set").alias(k), F.col("n").alias(k + "_n"), F.col("bits").alias(k + "_bits")) for k in "ab"]
    marked = pairs.select("a", "b").join(small[0], "a").join(small[1], "b").select("a", "b", "a_n", "b_n", "a_bits", "b_bits")
    pairs = durable(marked.mapInArrow(rule_out, "a long, b long"))

    def judge(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("set").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("set").alias("b"), F.col("shingles").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(judge, "a long, b long")


def _may_link(a: str, a_at: str, b: str, b_at: str):
    """Whether sets of these sizes whose first common shingle stands at these places can be similar enough.

    All common shingles come from there on, and a link takes 4/9 of the sum of the sizes in common.
    """
    fits = F.expr(f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})")
    return fits & F.expr(f"{100 + PERCENT} * least({a} - {a_at}, {b} - {b_at}) >= {PERCENT} * ({a} + {b})")


def _largest_partner() -> Column:
    """A bound to the size of the sets that a list entry (n, at) can link its set with, if it is their first in common."""
    return F.floor((F.lit(100 + PERCENT) * (F.col("n") - F.col("at")) - F.lit(PERCENT) * F.col("n")) / PERCENT)


def _band(size: Column) -> Column:
    return F.floor(F.log(size) / math.log(BAND))


def _first_in_common(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in lists (sig, set, n, at, root) that may link by their first common shingle and have
    different roots, each once.

    An entry asks for the bands of sizes it can link with, of those that its list holds; entries meet whose bands ask for
    each other.  Components of such a meeting are paired first, and only those of different ones opened, so members of
    one component never meet.
    """
    spread = lists.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.collect_set(_band(F.col("n"))).alias("bands"))
    asking = lists.join(spread.filter("low < high").select("sig", "bands"), "sig").withColumn("own", _band(F.col("n")))
    least, most = _band(F.col("n") * (PERCENT / 100)) - 1, _band(F.col("n") * (100 / PERCENT)) + 1
    wanted = F.filter("bands", lambda b: (b >= least) & (b <= most) & (F.floor(F.pow(F.lit(BAND), b)) <= _largest_partner()))
    asking = durable(asking.select("sig", "set", "n", "at", "root", "own", F.explode(wanted).alias("other")))
    groups = asking.select("sig", "own", "other", "root").distinct()
    x, y = groups.alias("x"), groups.alias("y")
    apart = x.join(y, F.expr("x.sig = y.sig AND x.own = y.other AND x.other = y.own AND x.root < y.root"))
    apart = apart.select(F.col("x.sig").alias("sig"), F.col("x.own").alias("own"), F.col("x.other").alias("other"), F.col("x.root").alias("low"), F.col("y.root").alias("high"))
    left = asking.select("sig", "own", "other", F.col("root").alias("low"), F.col("set").alias("a"), F.col("n").alias("a_n"), F.col("at").alias("a_at"))
    right = asking.select("sig", F.col("own").alias("other"), F.col("other").alias("own"), F.col("root").alias("high"), F.col("set").alias("b"), F.col("n").alias("b_n"), F.col("at").alias("b_at"))
    pairs = apart.join(left, ["sig", "own", "other", "low"]).join(right, ["sig", "own", "other", "high"])
    return pairs.filter(_may_link("a_n", "a_at", "b_n", "b_at")).select("a", "b").distinct()


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, row (a key), n_shingles, set, root and component_id of every row of ``docs`` (doc_id, text).

    Two rows link if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; component_id is the
    smallest doc_id that a row reaches by links.  Every pair that can link is either judged on its whole sets or already
    connected, so no link between components is lost:

    1. Equal sets are one set from here on, known by a 64-bit hash of its shingles, which are 64-bit hashes themselves.
    2. Sets of up to ``boundary`` shingles emit every 2-subset of a prefix, larger ones list a prefix; linked sets share a
       subset, or list entries of which the first leaves enough shingles to both.
    3. In each list all sets are first compared with its head only, so a large group of near copies costs a row per entry.
       These links make components.
    4. Then every pair of sets of *different* components that may link by its first common entry is judged.

    Rows with one doc_id are documents of their own.  A row without words is linked with nothing; so is one of a null
    doc_id if alone, its component_id being null.
    """
    source = docs.select("doc_id", "text")
    rows = durable(_summaries(source))
    own = rows.filter("piece IS NULL").select("doc_id", "row", "set", "n")
    named = own.filter("n > 0").select("set", "n").distinct()
    counters = _counters(rows)
    entries = float(counters.sum())
    # The mean number of sets that a shingle's list holds, less what chance puts on its counter.
    meets = float((counters.astype(np.float64) ** 2).sum() / entries - entries / COUNTERS) if entries else 1.0
    sizes = {r["n"]: r["count"] for r in named.filter(F.col("n") <= 2 * SMALL_AT_MOST).groupBy("n").count().collect()}
    most = boundary(sizes, max(1.0, meets))
    levels = docs.sparkSession.sparkContext.broadcast(_levels(counters))

    signatures = _signatures(source, levels, most)
    twice = durable(signatures.groupBy("sig").agg(F.count("*").alias("_n")).filter("_n > 1").select("sig"))
    met = signatures.join(twice.hint("shuffle_hash"), "sig", "left_semi").distinct()
    lists = durable(met.select("sig", "set", F.shiftright("size", _AT_BITS).alias("n"), F.col("size").bitwiseAND(F.lit((1 << _AT_BITS) - 1)).alias("at")))

    # The head of a list is the set that has the entry earliest, so the fewest shingles of its own.
    heads = lists.groupBy("sig").agg(F.min(F.struct("at", "set", "n")).alias("head"), F.min("n").alias("least"), F.count("*").alias("_n")).filter("_n > 1")
    lists = lists.join(heads.select("sig", "head", "least"), "sig").filter(_largest_partner() >= F.greatest(F.col("least"), F.ceil(F.col("n") * PERCENT / 100)))
    lists = durable(lists.select("sig", "set", "n", "at", F.col("head.set").alias("head"), F.col("head.n").alias("head_n"), F.col("head.at").alias("head_at")))
    star = lists.filter("set <> head").filter(_may_link("n", "at", "head_n", "head_at")).groupBy("set", "head").agg(F.count("*").alias("common"))
    # The head with most entries in common is judged now; other pairs are left to the last step, if still apart.
    star = star.groupBy("set").agg(F.max(F.struct("common", "head")).alias("best"))
    star = durable(star.select(F.col("best.head").alias("a"), F.col("set").alias("b")))

    def judged(pairs: DataFrame) -> DataFrame:
        wanted = durable(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct())
        return durable(_linked(pairs, durable(_fetch(source, wanted))))

    links = judged(star)
    roots = components(links)
    placed = lists.select("sig", "set", "n", "at").join(roots.withColumnRenamed("node", "set"), "set", "left")
    pairs = _first_in_common(placed.withColumn("root", F.coalesce("root", "set")))
    pairs = durable(pairs.join(star, ["a", "b"], "left_anti").join(star.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"))
    if pairs.limit(1).count():
        roots = components(links.unionByName(judged(pairs)))

    whole = own.join(roots.withColumnRenamed("node", "set"), "set", "left")
    whole = whole.withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "set")))
    lowest = whole.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("lowest"))
    whole = whole.join(lowest, "root", "left")
    return whole.select("doc_id", "row", F.col("n").alias("n_shingles"), "set", "root", F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each group of linked ones, that of the smallest doc_id (null is the largest), with all its
    columns; rows without words stay."""
    linked = durable(link_documents(docs).filter("n_shingles > 0").select("doc_id", "row", "root"))
    where = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    first = linked.groupBy("root").agg(F.min(where).alias("first")).select(F.col("first.row").alias("_kept"))
    marked = linked.select("row").distinct().join(first, F.col("row") == F.col("_kept"), "left")
    found = text.numbered(docs).join(marked, F.col("_row") == F.col("row"), "left")
    stays = F.col("row").isNull() | (F.col("_kept").isNotNull() & (F.col("_nth") == 1))
    return found.filter(stays).select("_doc.*")


def op8_set_join(spark, sf_dir):
    return link_documents(text.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op8_set_join": op8_set_join}
ORACLES: dict[str, str] = {}
