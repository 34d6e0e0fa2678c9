"""Token ids in binary shards whose document boundaries are Elias-Fano encoded."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boreline.functions.blocks import durable, shared_folder
from boreline.llm import text

#: Ids after which a shard is closed; a longer document has a shard of its own.
SHARD_IDS = 1 << 22
#: Pieces of text that the library encodes in one call.
PIECES_AT_ONCE = 4096
#: Different pieces of text whose ids a Python worker keeps, from task to task; the first ones, as common words come early.
KEPT_PIECES = 1 << 17
MAGIC = b"BLTOK\x00\x00\x01"
SAMPLE = 256


class EliasFano:
    """A non-decreasing run of whole numbers in about 2 + log2(universe / count) bits each, with random access.

    The low bits of each number stand in a packed array; the high bits are written in unary, number i as a one at
    ``high + i``.  Every 256th one's place is kept, so ``select`` scans a few bytes.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, width, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    def select(self, i: int) -> int:
        """Place of the i-th one."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return 8 * byte + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        high, first = self.select(i) - i, i * self.width
        part = int.from_bytes(self.low[first >> 3 : (first + self.width + 7) >> 3].tobytes(), "little")
        return high << self.width | (part >> (first & 7)) & ((1 << self.width) - 1)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width)
        return high | (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def pack(self) -> bytes:
        head = struct.pack("<QQQQQ", self.n, self.width, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def unpack(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, width, low, high, samples = struct.unpack_from("<QQQQQ", data, at)
        at += 40
        parts = []
        for size in (low, high, 8 * samples):
            parts.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        return cls(n, width, parts[0], parts[1], parts[2].view("<u8")), at


class Shard:
    """Documents one after the other: ids, the end of each, and their doc_ids (ascending, the last ones may be null).

    Layout: magic; documents, null doc_ids, bytes of an id, smallest doc_id (64-bit each); the Elias-Fano runs of the
    ends and of the doc_ids less the smallest; the ids in 16 or 32 bits.
    """

    def __init__(self, ends: EliasFano, keys: EliasFano, smallest: int, nulls: int, ids: np.ndarray):
        self.ends, self.keys, self.smallest, self.nulls, self.ids = ends, keys, smallest, nulls, ids

    def __len__(self) -> int:
        return self.ends.n

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i - 1] if i else 0 : self.ends[i]]

    def doc_ids(self) -> list[int | None]:
        return [self.smallest + int(k) for k in self.keys.all()] + [None] * self.nulls

    @staticmethod
    def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
        known = [k for k in doc_ids if k is not None]
        smallest = known[0] if known else 0
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        head = struct.pack("<QQQq", len(doc_ids), len(doc_ids) - len(known), width, smallest)
        keys = EliasFano.encode(np.array([k - smallest for k in known], np.uint64))
        return MAGIC + head + EliasFano.encode(np.cumsum(counts)).pack() + keys.pack() + ids.astype(f"<u{width}").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        view = memoryview(data)
        _, nulls, width, smallest = struct.unpack_from("<QQQq", data, 8)
        ends, at = EliasFano.unpack(view, 40)
        keys, at = EliasFano.unpack(view, at)
        return cls(ends, keys, smallest, nulls, np.frombuffer(data, f"<u{width}", offset=at))


def _kinds() -> np.ndarray:
    """Of ASCII: 1 letters, 2 digits, 3 other printable characters but the apostrophe, 4 that one; else 0."""
    kinds = np.zeros(256, np.uint8)
    for b in range(0x21, 0x7F):
        kinds[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 4 if chr(b) == "'" else 3
    return kinds


_KINDS = _kinds()


def _breaks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a text may be cut so that its parts encode to the ids of the whole.

    The vocabulary's pattern makes runs of letters, of digits and of other characters, each with one blank before it at
    most, runs of white space, and short forms after an apostrophe.  So a cut is safe before ASCII white space if the
    character before it surely isn't white space, and between ASCII characters of different kinds, the first no
    apostrophe.  Longer characters count as no white space if they begin with a byte under which Unicode has none, and
    the Latin letters among them as letters.  Other places are left uncut.
    """
    n = len(data)
    space = ~text.SPACE_WORDS[data]
    kind = _KINDS[data]
    sure = np.zeros(n, bool)
    sure[1:] = kind[:-1] > 0
    letter = np.zeros(n, bool)
    for back, (low, high) in ((2, (0xC3, 0xDF)), (3, (0xE4, 0xEF)), (4, (0xF0, 0xF4))):
        if n > back:
            lead, tail = data[: n - back], data[back - 1 : n - 1]
            ok = (lead >= low) & (lead <= high) & (tail >= 0x80)
            sure[back:] |= ok
            if back == 2:
                letter[2:] = ok & (lead == 0xC3) & (tail != 0x97) & (tail != 0xB7)
    cut = space & sure
    before = np.zeros(n, np.uint8)
    before[1:] = kind[:-1]
    before[letter] = 1
    cut |= (kind > 0) & (before > 0) & (before < 4) & (np.where(kind == 4, 3, kind) != before)
    cut[offsets[offsets < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts by the tokenizers library; a piece of text whose ids are kept isn't encoded again.

    The library takes the added tokens out of a text first, the leftmost and then the longest, and encodes what is between
    them for itself; so each is one piece.  Where they hang on the characters around them, or on a normalizer, texts are
    encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        plain = not any(t.lstrip or t.rstrip or t.single_word for t in added) and len({t.normalized for t in added}) < 2
        self.whole = not plain or self.tokenizer.normalizer is not None
        longest = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.marks = re.compile(b"|".join(map(re.escape, longest))) if added else None
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kept: dict[str, array] = {}

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin: at the safe breaks, before and after each added token, and nowhere in one."""
        if self.whole:
            return np.unique(offsets[offsets < len(data)])
        starts = _breaks(data, offsets)
        if self.marks is None:
            return starts
        body = memoryview(np.ascontiguousarray(data))
        found = [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.marks.finditer(body, a, b)]
        if not found:
            return starts
        spans = np.array(found)
        last = np.searchsorted(spans[:, 0], starts, side="left") - 1
        inside = (last >= 0) & (starts < spans[last, 1])
        edges = spans.ravel()
        return np.union1d(starts[~inside], edges[edges < len(data)])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many belong to each text."""
        data, offsets = text.flat(column)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts = self._starts(data, offsets)
        edges = np.append(starts, len(data)).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        kind = pa.StringArray if edges.dtype == np.int32 else pa.LargeStringArray
        pieces = kind.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        kept, rare = self.kept, {}
        into = kept if len(kept) < KEPT_PIECES and not self.whole else rare
        new = [w for w in words if w not in kept]
        for at in range(0, len(new), PIECES_AT_ONCE):
            part = new[at : at + PIECES_AT_ONCE]
            into.update(zip(part, (array("H" if self.small else "I", e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        found = [kept[w] if w in kept else rare[w] for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        pool = np.frombuffer(b"".join(found), np.uint16 if self.small else np.uint32).astype(np.uint32)
        code = pieces.indices.to_numpy()
        each = sizes[code]
        run = np.concatenate([[0], np.cumsum(each)])
        first = np.cumsum(sizes) - sizes
        ids = pool[np.repeat(first[code] - run[:-1], each) + np.arange(run[-1])]
        return ids, np.diff(run[np.searchsorted(starts, offsets)])


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the ids of every whole text, each document closed by ``end``, into shards under ``folder``.

    Documents go in ascending doc_id order, null doc_ids last, rows with one doc_id by a hash of their text.  Returns the
    manifest, written beside the shards: path, documents, ids, and the ids before the shard.  A task writes under a name
    of its own attempt and only the attempt that Spark accepts is in the manifest, so lost or doubled tasks do no harm.
    ``folder`` must be one that all executors share.  Null texts are empty: one end id.  No rows: no shards.
    """

    def write(batches):
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        encode, task = _encoder(vocabulary), TaskContext.get()
        held: list = []

        def close(number):
            keys = [k for part, _, _ in held for k in part]
            counts, ids = np.concatenate([c for _, c, _ in held]), np.concatenate([x for _, _, x in held])
            name = f"{task.partitionId():06d}-{number:06d}-{uuid.uuid4().hex}.tok"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(Shard.pack(keys, counts, ids))
            held.clear()
            return pa.RecordBatch.from_pylist([{"task": task.partitionId(), "number": number, "path": f"{folder}/{name}", "documents": len(keys), "ids": len(ids)}], schema)

        schema = pa.schema([("task", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])
        number = size = 0
        for part in text.slices(batches, limit=min(8 * text.SLICE_BYTES, 4 * shard_ids)):
            ids, counts = encode(part.column(1))
            stops = np.cumsum(counts)
            ids = np.insert(ids, stops, end)
            held.append((part.column(0).to_pylist(), counts + 1, ids))
            size += len(ids)
            if size >= shard_ids:
                yield close(number)
                number, size = number + 1, 0
        if held:
            yield close(number)

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    made = durable(ranged.mapInArrow(write, "task int, number int, path string, documents long, ids long"))
    tasks = made.groupBy("task").agg(F.sum("ids").alias("_ids"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = tasks.select("task", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_shift") + F.coalesce(F.sum("ids").over(within), F.lit(0))
    return made.join(shift, "task").select("path", "documents", "ids", start.alias("start"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document of the shards: doc_id, start (ids before it in all shards), ids (array of int)."""
    return _read(manifest, "doc_id long, start long, ids array<int>", _arrays)


def digest_shards(manifest: DataFrame) -> DataFrame:
    """One row per document of the shards: doc_id, start, n_tokens and the crc32 of its ids as 32-bit little-endian."""
    return _read(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", _digests)


def _arrays(shard: Shard, start: int) -> pa.RecordBatch:
    ends = shard.ends.all().astype(np.int64)
    first = np.concatenate([[0], ends[:-1]])
    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(shard.ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(), pa.int64()), pa.array(start + first), ids], ["doc_id", "start", "ids"])


def _digests(shard: Shard, start: int) -> pa.RecordBatch:
    ends = shard.ends.all().astype(np.int64)
    first = np.concatenate([[0], ends[:-1]])
    body = memoryview(shard.ids.astype("<u4").tobytes())
    sums = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(first, ends, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(shard.doc_ids(), pa.int64()), pa.array(start + first), pa.array(ends - first), pa.array(sums, pa.int64())],
        ["doc_id", "start", "n_tokens", "ids_crc32"])


def _read(manifest: DataFrame, schema: str, make) -> DataFrame:
    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _open(row["path"])
                with store.open_input_stream(path) as source:
                    yield make(Shard.unpack(source.read()), row["start"])

    count = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(count, "path").mapInArrow(read, schema)


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes the shards of ``docs`` into a new folder of the shared one and returns what reading them back gives."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"{shared_folder(spark)}/boreline-shards-{uuid.uuid4().hex}"
    return digest_shards(durable(write_shards(docs, folder, vocabulary)))


def op10_token_files(spark, sf_dir):
    return token_files(spark, text.table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_files": op10_token_files}
ORACLES: dict[str, str] = {}
