"""Language model scoring by context-tree weighting over binary-decomposed bytes.

A symbol is a byte of the lower-cased text or the end of the text, coded as eight binary choices.  Every choice has a tree
of contexts, the bytes before the symbol, nearest first.  A node's estimate is Krichevsky and Trofimov's, from the zeros
and ones that followed its context in training; the weighted probability of a node is half its own estimate and half the
product of its children's.  The chance of a symbol then is a mixture of all depths, whose weights the training counts fix.

Counts are gathered as arrays: a block of documents names each of its n-grams once, equal n-grams of all blocks meet in
a bucket, the trees are computed on the different n-grams of the corpus, and the chance of each goes back to the blocks
that hold it.  So no task holds the model, and what moves is proportional to the corpus.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreline.functions.blocks import durable, shared_folder
from boreline.llm import text

#: Bytes of context, seven at most, as a context and its symbol are one 64-bit number.
DEPTH = 6
#: Text of one block.  A longer document is a block of its own.
BLOCK_BYTES = 1 << 25

#: Bytes of text for each group of n-grams that one task holds.
PART_BYTES = 1 << 26
_SLICE = 1 << 20
#: The end of a text, and what stands before its beginning: a byte that UTF-8 never has.
END = 0xFF
#: Depth from which on subtrees are computed apart; the few nodes nearer to the root are put together at the driver.
CUT = 3
#: Logarithms are summed up over tasks as whole multiples of this, so that the order does not matter.
_GRAIN = 2.0**-20
GRAMS, WORDS = 0, 1
#: The word that stands for the end of a text.
_END_WORD = text.mix(np.array([END], np.uint64))[0]


def _pack(values: np.ndarray) -> bytes:
    """Numbers as bytes of equal rank side by side, compressed; ascending 64-bit ones as differences."""
    if values.dtype == np.uint64 and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    planes = np.frombuffer(values.tobytes(), np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    values = np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=np.uint64) if values.dtype == np.uint64 else values


def _part(keys: np.ndarray, kind: int, parts: int) -> np.ndarray:
    """Where equal keys meet; n-grams with the same first bytes do, as their differences then are small."""
    base = keys >> np.uint64(24) if kind == GRAMS else keys
    return (text.mix(base + np.uint64(1)) % np.uint64(parts)).astype(np.int64)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of every symbol of lower-cased texts, context above and symbol in the last byte, and where each text's
    begin (one more).  A text has one symbol more than bytes."""
    texts = len(offsets) - 1
    sizes = np.diff(offsets)
    stream = np.full(len(data) + DEPTH * (texts + 1), END, np.uint8)
    stream[np.arange(len(data)) + np.repeat(DEPTH * np.arange(1, texts + 1), sizes)] = data
    count = len(stream) - DEPTH
    keys = np.zeros(count, np.uint64)
    for k in range(DEPTH + 1):
        keys = keys << np.uint64(8) | stream[k : k + count]
    # After each text stand DEPTH ends: the first is its last symbol, the others part it from the next.
    keep = np.ones(count, bool)
    last = offsets[1:] + DEPTH * np.arange(texts)
    for k in range(1, DEPTH):
        keep[last + k] = False
    return keys[keep], np.concatenate([[0], np.cumsum(sizes + 1)])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of lower-cased texts and of the end of each, and where each text's begin (one more)."""
    starts, ends, first = text.spans(data, offsets, text.SPACE_WORDS)
    return np.insert(text.span_hashes(data, starts, ends), first[1:], _END_WORD), first + np.arange(len(first))


class _Tally:
    """Different keys of a block and how often each occurs in training.

    What slices add is merged whenever it is half as much as is held, so memory follows the different keys.
    """

    def __init__(self):
        self.keys, self.counts = [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
        self.new = 0

    def add(self, keys: np.ndarray, training: np.ndarray) -> None:
        for own, weight in ((keys[training], 1), (keys[~training], 0)):
            found, counts = np.unique(own, return_counts=True)
            self.keys.append(found)
            self.counts.append((counts * weight).astype(np.int32))
            self.new += len(found)
        if self.new > max(1 << 20, len(self.keys[0]) // 2):
            self.sum()

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        self.keys, self.counts = [], []
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
        self.keys, self.counts = [keys[first]], [np.add.reduceat(counts, first) if len(first) else counts]
        self.new = 0
        return self.keys[0], self.counts[0].astype(np.int64)


def _blocked(docs: DataFrame, training: Column) -> DataFrame:
    """The documents with the block each belongs to: rows of one task, one after the other."""

    def number(batches):
        task, block, size = TaskContext.get().partitionId(), 0, 0
        for batch in text.slices(batches, limit=_SLICE):
            _, offsets = text.flat(batch.column(2))
            if size and size + int(offsets[-1]) > BLOCK_BYTES:
                block, size = block + 1, 0
            size += int(offsets[-1])
            names = np.full(batch.num_rows, task << 32 | block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names)], ["doc_id", "training", "text", "block"])

    own = docs.select("doc_id", F.coalesce(training, F.lit(False)).alias("training"), "text")
    numbered = own.mapInArrow(number, "doc_id long, training boolean, text string, block long")
    # The largest table that is written here, so in the closer of the usual compressions.
    path = f"{shared_folder(docs.sparkSession)}/boreline-{uuid.uuid4().hex}"
    numbered.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(numbered.schema).parquet(path)


def _parts(blocked: DataFrame) -> int:
    """How many groups the n-grams are dealt to: one for each ``PART_BYTES`` of text, the session's number at least, so a
    group does not grow with the corpus."""
    size = blocked.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return max(int(blocked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def _by_block(batches, limit: int = _SLICE):
    """Slices of one block each; True with the last slice of a run of the block."""
    held = None
    for batch in text.slices(batches, limit=limit):
        names = batch.column(3).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(a, b - a)
            if held is not None:
                yield held, int(held.column(3)[0].as_py()) != int(names[a])
            held = part
    if held is not None:
        yield held, True


def _entries(blocked: DataFrame, parts: int) -> DataFrame:
    """kind, part, block, keys and counts: what each block holds of each part."""

    def make(batches):
        tallies = {GRAMS: _Tally(), WORDS: _Tally()}
        for batch, is_last in _by_block(batches):
            data, offsets = text.flat(batch.column(2))
            data = text.LOWER[data]
            training = batch.column(1).to_numpy(zero_copy_only=False)
            for kind, read in ((GRAMS, symbols), (WORDS, tokens)):
                keys, first = read(data, offsets)
                tallies[kind].add(keys, np.repeat(training, np.diff(first)))
            if not is_last:
                continue
            block = batch.column(3)[0].as_py()
            for kind, tally in tallies.items():
                keys, counts = tally.sum()
                part = _part(keys, kind, parts)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                rows = [(p, order[a:b]) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), kind, np.int32)), pa.array([p for p, _ in rows], pa.int64()), pa.array(np.full(len(rows), block)),
                    pa.array([_pack(keys[i]) for _, i in rows], pa.binary()), pa.array([_pack(counts[i]) for _, i in rows], pa.binary())],
                    ["kind", "part", "block", "keys", "counts"])
            tallies = {GRAMS: _Tally(), WORDS: _Tally()}

    return durable(blocked.mapInArrow(make, "kind int, part long, block long, keys binary, counts binary"))


def _summed(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys of each row, all different keys, and their counts over all rows."""
    each = [_unpack(k.as_py(), np.uint64) for k in table.column("keys")]
    counts = [_unpack(c.as_py(), np.int64) for c in table.column("counts")]
    keys, place = np.unique(np.concatenate(each), return_inverse=True)
    return each, keys, np.bincount(place, np.concatenate(counts), len(keys)).astype(np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for positive numbers, by Stirling's series from 8 on."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    moved = x.copy()
    for _ in range(8):
        small = moved < 8
        shift[small] += np.log(moved[small])
        moved[small] += 1
    square = 1 / (moved * moved)
    series = (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188)))) / moved
    return (moved - 0.5) * np.log(moved) - moved + 0.5 * math.log(2 * math.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The estimator's probability of so many zeros and ones, in any one order."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Nodes:
    """The nodes of one depth that training has met: for each its counts and its own weight in the mixture.

    A node is a context, nearest byte last, and the choices made within the symbol, behind a leading one.
    """

    def __init__(self, names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        """``below``: the log of the product of the children's weighted probabilities; none at the greatest depth."""
        self.names, self.zeros, self.ones = names, zeros, ones
        own = log_kt(zeros, ones)
        if below is None:
            self.log_weighted, self.weight = own, np.ones(len(names))
        else:
            self.log_weighted = np.logaddexp(own, below) - math.log(2)
            self.weight = np.exp(own - math.log(2) - self.log_weighted)

    def mix(self, names: np.ndarray, bits: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """The chance of ``bits`` at these nodes.  ``deeper``: what the children say, not a number where training never
        met the child; there, the node speaks alone, and a node that was never met says nothing."""
        if not len(self.names):
            return np.full(len(names), np.nan)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        zeros, ones, weight = self.zeros[at], self.ones[at], self.weight[at]
        own = (np.where(bits, ones, zeros) + 0.5) / (zeros + ones + 1.0)
        chance = np.where(np.isnan(deeper), own, weight * own + (1 - weight) * deeper)
        return np.where(self.names[at] == names, chance, np.nan)


def _choices(keys: np.ndarray, depth: int):
    """For each of the eight choices of the symbols: the nodes of ``depth`` and the bits chosen."""
    context = keys >> np.uint64(8) & np.uint64((1 << 8 * depth) - 1)
    symbol = keys & np.uint64(0xFF)
    for k in range(8):
        prefix = symbol >> np.uint64(8 - k) | np.uint64(1 << k)
        yield context << np.uint64(8) | prefix, (symbol >> np.uint64(7 - k) & np.uint64(1)).astype(bool)


def _parents(names: np.ndarray, depth: int) -> np.ndarray:
    """The nodes of ``depth`` above nodes of one more."""
    return names & np.uint64((1 << 8 * depth + 8) - 1)


def _grouped(names: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    found, place = np.unique(names, return_inverse=True)
    return (found, *(np.bincount(place, v, len(found)) for v in values))


def subtrees(keys: np.ndarray, counts: np.ndarray, top: int) -> list[Nodes]:
    """Nodes of all depths from ``DEPTH`` up to ``top``, of whole subtrees of ``top``."""
    met = counts > 0
    keys, counts = keys[met], counts[met].astype(np.float64)
    pairs = list(_choices(keys, DEPTH))
    bits = np.concatenate([b for _, b in pairs])
    weight = np.tile(counts, 8)
    names, zeros, ones = _grouped(np.concatenate([n for n, _ in pairs]), np.where(bits, 0, weight), np.where(bits, weight, 0))
    levels = [Nodes(names, zeros, ones, None)]
    for depth in range(DEPTH - 1, top - 1, -1):
        child = levels[-1]
        names, zeros, ones, below = _grouped(_parents(child.names, depth), child.zeros, child.ones, child.log_weighted)
        levels.append(Nodes(names, zeros, ones, below))
    return levels


def chances(keys: np.ndarray, levels: list[Nodes], first: int, deeper: np.ndarray) -> np.ndarray:
    """The chance of each choice (one row per choice) after mixing ``levels``, the deepest, of depth ``first``, first."""
    out = deeper
    for depth, level in zip(range(first, -1, -1), levels, strict=False):
        out = np.stack([level.mix(names, bits, out[k]) for k, (names, bits) in enumerate(_choices(keys, depth))])
    return out


def _trees(entries: DataFrame, parts: int) -> DataFrame:
    """part, keys and chances (below ``CUT``), and the nodes of depth ``CUT - 1`` with what stands below them here."""

    def gather(table: pa.Table) -> pa.Table:
        _, keys, counts = _summed(table)
        part = (text.mix((keys >> np.uint64(8) & np.uint64((1 << 8 * CUT) - 1)) + np.uint64(7)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, order[a:b]) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        return pa.table({
            "part": pa.array([p for p, _ in rows], pa.int64()), "keys": pa.array([_pack(keys[i]) for _, i in rows], pa.binary()),
            "counts": pa.array([_pack(counts[i]) for _, i in rows], pa.binary())})

    def grow(table: pa.Table) -> pa.Table:
        _, keys, counts = _summed(table)
        levels = subtrees(keys, counts, CUT)
        below = chances(keys, levels, DEPTH, np.full((8, len(keys)), np.nan)).astype(np.float32)
        top = levels[-1]
        names, zeros, ones, logs = _grouped(_parents(top.names, CUT - 1), top.zeros, top.ones, np.round(top.log_weighted / _GRAIN))
        packed = [_pack(keys), _pack(below.ravel()), _pack(names), _pack(zeros.astype(np.int64)), _pack(ones.astype(np.int64)), _pack(logs.astype(np.int64))]
        return pa.table({name: pa.array([value], pa.binary()) for name, value in zip(("keys", "chances", "names", "zeros", "ones", "logs"), packed, strict=True)})

    grams = entries.filter(F.col("kind") == GRAMS).select("part", "keys", "counts")
    met = grams.groupBy("part").applyInArrow(gather, "part long, keys binary, counts binary")
    return durable(met.groupBy("part").applyInArrow(grow, "keys binary, chances binary, names binary, zeros binary, ones binary, logs binary"))


def _top(trees: DataFrame) -> list[Nodes]:
    """The levels above ``CUT``, from the deepest to the root.  Their nodes are contexts of two bytes at most."""

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                arrays = [_unpack(row["names"], np.uint64).astype(np.int64), *(_unpack(row[c], np.int64) for c in ("zeros", "ones", "logs"))]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["name", "zeros", "ones", "logs"])

    nodes = trees.select("names", "zeros", "ones", "logs").mapInArrow(rows, "name long, zeros long, ones long, logs long")
    found = nodes.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "logs")]).toArrow()
    names = found.column("name").to_numpy().astype(np.uint64)
    order = np.argsort(names)
    zeros, ones, logs = (found.column(c).to_numpy()[order].astype(np.float64) for c in ("zeros", "ones", "logs"))
    levels = [Nodes(names[order], zeros, ones, logs * _GRAIN)]
    for depth in range(CUT - 2, -1, -1):
        child = levels[-1]
        names, zeros, ones, below = _grouped(_parents(child.names, depth), child.zeros, child.ones, child.log_weighted)
        levels.append(Nodes(names, zeros, ones, below))
    return levels


def _answers(entries: DataFrame, trees: DataFrame, top: list[Nodes], parts: int) -> DataFrame:
    """block, kind, keys and values: log10 of the chance of each n-gram, training count of each word."""
    shared = trees.sparkSession.sparkContext.broadcast(top)

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys = _unpack(row["keys"], np.uint64)
                below = _unpack(row["chances"], np.float32).reshape(8, -1).astype(np.float64)
                mixed = chances(keys, shared.value, CUT - 1, below)
                # Without any training each choice is even.
                logs = np.log10(np.where(np.isnan(mixed), 0.5, mixed)).sum(axis=0).astype(np.float32)
                part = _part(keys, GRAMS, parts)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                own = [(p, order[a:b]) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
                yield pa.RecordBatch.from_arrays([
                    pa.array([p for p, _ in own], pa.int64()), pa.array([_pack(keys[i]) for _, i in own], pa.binary()),
                    pa.array([_pack(logs[i]) for _, i in own], pa.binary())], ["part", "keys", "logs"])

    def back(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpack(k.as_py(), np.uint64) for k in known.column("keys")])
        logs = np.concatenate([_unpack(k.as_py(), np.float32) for k in known.column("logs")])
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        each = [logs[np.searchsorted(keys, _unpack(k.as_py(), np.uint64))] for k in asked.column("keys")]
        return _reply(asked, GRAMS, each)

    def count(asked: pa.Table) -> pa.Table:
        each, keys, counts = _summed(asked)
        return _reply(asked, WORDS, [counts[np.searchsorted(keys, own)] for own in each])

    layout = "block long, kind int, keys binary, values binary"
    asked = entries.filter(F.col("kind") == GRAMS).select("part", "block", "keys").groupBy("part")
    known = trees.select("keys", "chances").mapInArrow(finish, "part long, keys binary, logs binary").groupBy("part")
    words = entries.filter(F.col("kind") == WORDS).select("part", "block", "keys", "counts").groupBy("part")
    return asked.cogroup(known).applyInArrow(back, layout).unionByName(words.applyInArrow(count, layout))


def _reply(asked: pa.Table, kind: int, values: list[np.ndarray]) -> pa.Table:
    return pa.table({
        "block": asked.column("block"), "kind": pa.array(np.full(len(values), kind, np.int32)), "keys": asked.column("keys"),
        "values": pa.array([_pack(v) for v in values], pa.binary())})


class Lookup:
    """Values by 64-bit key, in an open table that is filled and read by whole arrays.  Every key asked for is there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        self.last = (1 << 64 - int(self.shift)) - 1
        taken = np.full(self.last + 1, -1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = taken[slot] < 0
            taken[slot[free]] = left[free]
            lost = taken[slot] != left
            left, slot = left[lost], slot[lost] + 1 & self.last
        self.keys, self.values = np.zeros(self.last + 1, np.uint64), np.zeros(self.last + 1, values.dtype)
        used = taken >= 0
        self.keys[used], self.values[used] = keys[taken[used]], values[taken[used]]
        self.used = used

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        wrong = np.flatnonzero((self.keys[slot] != keys) | ~self.used[slot])
        while len(wrong):
            slot[wrong] = slot[wrong] + 1 & self.last
            wrong = wrong[(self.keys[slot[wrong]] != keys[wrong]) | ~self.used[slot[wrong]]]
        return self.values[slot]


def _write_answers(answers: DataFrame, folder: str) -> None:
    """One file per block in the shared folder, moved to its name when whole, so a repeated task does no harm."""

    def write(table: pa.Table) -> pa.Table:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        block = table.column("block")[0].as_py()
        name = f"{root}/{uuid.uuid4().hex}.part"
        with store.open_output_stream(name) as out, pa.ipc.new_file(out, table.schema) as sink:
            sink.write_table(table)
        store.move(name, f"{root}/{block}.arrow")
        return pa.table({"block": pa.array([block], pa.int64())})

    answers.groupBy("block").applyInArrow(write, "block long").write.format("noop").mode("overwrite").save()


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _read_answers(folder: str, block: int) -> dict[int, Lookup]:
    store, root = _open(folder)
    with store.open_input_file(f"{root}/{block}.arrow") as source:
        table = pa.ipc.open_file(source).read_all()
    kinds = table.column("kind").to_numpy()
    out = {}
    for kind, dtype in ((GRAMS, np.float32), (WORDS, np.int64)):
        own = table.filter(pa.array(kinds == kind))
        out[kind] = Lookup(
            np.concatenate([_unpack(k.as_py(), np.uint64) for k in own.column("keys")]),
            np.concatenate([_unpack(v.as_py(), dtype) for v in own.column("values")]))
    return out


def score_documents(docs: DataFrame, training: Column) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score and
    bits_per_byte, learning from the rows that ``training`` holds for (null: not).

    ``score`` is the model's log10 probability of the whole lower-cased text and its end.  ``base_score`` is that of a
    smoothed unigram model of its words, split at white space, and of its end.  ``bits_per_byte`` is the code length by
    the first, per byte of text, null for an empty one.  Null texts are empty; a training row counts as often as it is
    repeated; without training rows each choice is even and each word unknown.
    """
    spark = docs.sparkSession
    blocked = _blocked(docs, training)
    parts = _parts(blocked)
    entries = _entries(blocked, parts)
    trees = _trees(entries, parts)
    top = _top(trees)

    def totals(table: pa.Table) -> pa.Table:
        _, _, counts = _summed(table)
        return pa.table({"n": pa.array([int(counts.sum())], pa.int64()), "v": pa.array([int((counts > 0).sum())], pa.int64())})

    words = entries.filter(F.col("kind") == WORDS).select("part", "keys", "counts").groupBy("part").applyInArrow(totals, "n long, v long")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    folder = f"{shared_folder(spark)}/boreline-contexts-{uuid.uuid4().hex}"
    _write_answers(_answers(entries, trees, top, parts), folder)

    def score(batches):
        block, found = None, {}
        for batch, _ in _by_block(batches):
            if block != (block := batch.column(3)[0].as_py()):
                found = _read_answers(folder, block)
            data, offsets = text.flat(batch.column(2))
            data = text.LOWER[data]
            keys, first = symbols(data, offsets)
            logs = np.add.reduceat(found[GRAMS](keys), first[:-1], dtype=np.float64)
            keys, first = tokens(data, offsets)
            counts = found[WORDS](keys)
            base = np.add.reduceat(np.log10((counts + 0.1) / (n + 0.1 * (v + 1))), first[:-1])
            known = np.add.reduceat((counts > 0).astype(np.int64), first[:-1])
            sizes = np.diff(offsets)
            bits = -logs * math.log2(10) / np.maximum(1, sizes)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(first)), pa.array(known), pa.array(np.full(len(sizes), n, np.int64)),
                pa.array(base), pa.array(logs), pa.array(bits, mask=sizes == 0)],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    layout = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return blocked.mapInArrow(score, layout)


def op3_context_trees(spark, sf_dir):
    held_out = text.fold(F.col("doc_id")) % 10 == 0
    found = score_documents(text.table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


QUERIES = {"op3_context_trees": op3_context_trees}
ORACLES: dict[str, str] = {}
