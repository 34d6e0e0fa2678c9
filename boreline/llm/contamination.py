"""Benchmark decontamination with a generalised suffix automaton of the test items' words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreline.functions.blocks import durable
from boreline.llm import running, text

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Hit spans of more words are cut out of texts that stay.
LONGEST = 50
#: Words of test items in one automaton; a larger benchmark takes one pass over the documents per so many words.
BLOCK_WORDS = 500_000
#: What documents carry from pass to pass: hit words as pairs of numbers, and the items met.
_HITS, _ITEMS, _WORDS = "_hit_spans", "_hit_items", "_n_words"


class Automaton:
    """All substrings of several sequences of words, with the items that hold a window of each.

    Every state stands for substrings that end at the same places; ``length`` is its longest.  Sequences are added one
    after the other from the root, and states are split where needed, so one automaton holds them all.  Reading a text
    keeps the longest suffix that is a substring of an item.  A window ends where that suffix has ``window`` words, or
    where an item shorter than that is a suffix of it.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = [self._add(words.tolist()) for _, words in items]
        self.long_items: list[set[int]] = [set() for _ in self.step]
        self.short_items: dict[int, list[int]] = {}
        for number, (_, words) in enumerate(items):
            if len(words) >= window:
                self._mark(number, words.tolist())
            else:
                self.short_items.setdefault(ends[number], []).append(number)
        self.shorts = [self._shorts(state) for state in range(len(self.step))]

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.step) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` for its suffixes of at most one word more than ``state``."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.step[target]))
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _add(self, words: list[int]) -> int:
        last = 0
        for word in words:
            target = self.step[last].get(word)
            if target is not None:
                last = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
                continue
            new, state = self._state(self.length[last] + 1, 0, {}), last
            while state >= 0 and word not in self.step[state]:
                self.step[state][word] = new
                state = self.link[state]
            if state >= 0:
                target = self.step[state][word]
                exact = self.length[target] == self.length[state] + 1
                self.link[new] = target if exact else self._split(state, word, target)
            last = new
        return last

    def _mark(self, item: int, words: list[int]) -> None:
        state = length = 0
        for word in words:
            state, length = self.follow(state, length, word)
            if length >= self.window:
                self.long_items[self.of_window(state)].add(item)

    def _shorts(self, state: int) -> tuple[tuple[int, tuple[int, ...]], ...]:
        found = []
        while state > 0:
            if state in self.short_items:
                found.append((self.length[state], tuple(self.short_items[state])))
            state = self.link[state]
        return tuple(found)

    def of_window(self, state: int) -> int:
        """The state that holds the last ``window`` words."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def follow(self, state: int, length: int, word: int) -> tuple[int, int]:
        while state and word not in self.step[state]:
            state = self.link[state]
            length = self.length[state]
        state = self.step[state].get(word, -1)
        return (state, length + 1) if state >= 0 else (0, 0)

    def scan(self, words: list[int]):
        """Yields (end, words covered, items) for windows in the text, the widest at each end."""
        state = length = 0
        for at, word in enumerate(words, 1):
            state, length = self.follow(state, length, word)
            if length >= self.window:
                yield at, self.window, self.long_items[self.of_window(state)]
            for size, items in self.shorts[state]:
                if size <= length:
                    yield at, size, items


class Scanner:
    """The windows of one block of items in the words of a batch of texts."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.items = [(name, np.array(words, np.uint64)) for name, words in items if words]
        self.shortest = min([window, *(len(w) for _, w in self.items)]) if self.items else 0
        self.vocabulary = np.unique(np.concatenate([w for _, w in self.items])) if self.items else np.empty(0, np.uint64)
        ids = [(name, np.searchsorted(self.vocabulary, w)) for name, w in self.items]
        pairs = [w[:-1] * len(self.vocabulary) + w[1:] for _, w in ids]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.automaton = Automaton(ids, window)

    def __call__(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Per text the spans of hit words, merged, and the items.  ``first``: where each text's words begin."""
        found: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in range(len(first) - 1)]
        if not self.items or not len(hashes):
            return found
        ids = np.searchsorted(self.vocabulary, hashes)
        ids[ids == len(self.vocabulary)] = 0
        # A word, or a pair of words, that no item holds takes the automaton back to its root, so only runs between
        # such places are read word by word.
        known = self.vocabulary[ids] == hashes
        joined = np.zeros(len(ids) + 1, bool)
        joined[1:-1] = known[:-1] & known[1:]
        joined[first] = False
        if len(self.pairs):
            near = np.flatnonzero(joined)
            keys = ids[near - 1] * len(self.vocabulary) + ids[near]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            joined[near] = self.pairs[at] == keys
        else:
            joined[:] = False
        starts = np.flatnonzero(known & ~joined[:-1])
        stops = np.flatnonzero(known & ~joined[1:]) + 1
        enough = stops - starts >= self.shortest
        starts, stops = starts[enough], stops[enough]
        for start, stop, doc in zip(starts.tolist(), stops.tolist(), (np.searchsorted(first, starts, side="right") - 1).tolist(), strict=True):
            spans, names = found[doc]
            base = start - int(first[doc])
            for end, size, items in self.automaton.scan(ids[start:stop].tolist()):
                low, high = base + end - size, base + end
                while spans and spans[-1][1] >= low:
                    low, high = min(low, spans[-1][0]), max(high, spans.pop()[1])
                spans.append((low, high))
                names.update(self.items[i][0] for i in items)
        return found


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text.flat(column)
    data = text.LOWER[data]
    starts, ends, first = text.spans(data, offsets, text.LETTER_WORDS)
    return text.span_hashes(data, starts, ends), first


_built: dict[str, Scanner] = {}


def _scanner(items: list[tuple[str, list[int]]], window: int) -> Scanner:
    """Built once in each Python worker, which keeps the last one."""
    key = hashlib.sha256(repr((window, items)).encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Scanner(items, window)
    return _built[key]


def _merged(spans: list[list[int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for low, high in sorted(map(tuple, spans)):
        if merged and merged[-1][1] >= low:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _blocks(benchmark: DataFrame, limit: int):
    """Yields the items in blocks of about ``limit`` words; a block is all that the driver and a task hold."""

    def words(batches):
        for batch in text.slices(batches):
            hashes, first = _words(batch.column(1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64))),
                pa.array(np.diff(first))], ["item_id", "words", "size"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    items = durable(named.mapInArrow(words, "item_id string, words array<long>, size long").distinct())
    if items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] <= limit:
        blocked = items.withColumn("block", F.lit(0).cast("long"))
        numbers = [0]
    else:
        placed = running.before(items, [F.col("item_id"), F.xxhash64("words")], "size", "_before")
        blocked = placed.withColumn("block", F.floor(F.col("_before") / limit).cast("long"))
        numbers = sorted(r[0] for r in blocked.select("block").distinct().collect())
    for number in numbers:
        rows = blocked.filter(F.col("block") == number).select("item_id", "words").collect()
        yield sorted((r["item_id"], [w % (1 << 64) for w in r["words"]]) for r in rows)


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds to ``docs``, in place of columns of these names: ``_n_words``, ``_hit_spans`` (pairs of word places, merged) and ``_hit_items`` (sorted).

    Words are runs of letters, digits and non-ASCII characters of the lower-cased text, told apart by 64-bit hashes.  A
    null or empty text has no words and no hits; an item without words is never met; items repeated under one id count
    once, and items of a null id under the empty name.  Without items nothing is hit.
    """
    docs = docs.drop(_WORDS, _HITS, _ITEMS)
    kept = docs.schema.fieldNames()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"{_WORDS} long", f"{_HITS} array<array<int>>", f"{_ITEMS} array<string>"])

    def scan(items, is_first):
        def run(batches):
            scanner = _scanner(items, window)
            for batch in text.slices(batches):
                hashes, first = _words(batch.column(batch.schema.get_field_index("text")))
                found = scanner(hashes, first)
                if not is_first:
                    earlier = zip(batch.column(batch.schema.get_field_index(_HITS)).to_pylist(), batch.column(batch.schema.get_field_index(_ITEMS)).to_pylist(), strict=True)
                    found = [(_merged([*old, *spans]), names | set(named)) for (spans, names), (old, named) in zip(found, earlier, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(kept))), pa.array(np.diff(first)),
                     pa.array([[list(s) for s in spans] for spans, _ in found], pa.list_(pa.list_(pa.int32()))),
                     pa.array([sorted(names) for _, names in found], pa.list_(pa.string()))],
                    names=[*kept, _WORDS, _HITS, _ITEMS])

        return run

    found, is_first = docs, True
    for items in _blocks(benchmark, block_words):
        found, is_first = found.mapInArrow(scan(items, is_first), schema), False
    return found


def _hit_words():
    return F.aggregate(_HITS, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def _contaminated(share: int):
    return (_hit_words() > 0) & (share * _hit_words() >= F.col(_WORDS))


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): words, hit words and their spans, items met, and the verdict."""
    found = find_items(text.texts_only(docs, "doc_id", "text"), benchmark, window, **options)
    return found.select(
        "doc_id", F.col(_WORDS).alias("n_words"), _hit_words().alias("n_hit"), F.col(_HITS).alias("hit_spans"),
        F.col(_ITEMS).alias("items"), _contaminated(share).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, longest: int | None = None, **options) -> DataFrame:
    """The rows of ``docs`` without those whose hit words are one in ``share`` or more, or that hold a hit span of more
    than ``longest`` words where that is given.  Other rows stay as they are, with all their columns."""
    found = find_items(text.packed(docs, F.col("text")), benchmark, window, **options)
    bad = _contaminated(share)
    if longest is not None:
        bad = bad | F.exists(_HITS, lambda s: s[1] - s[0] > longest)
    return found.filter(~bad).select("_doc.*")


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, longest: int = LONGEST, **options) -> DataFrame:
    """The rows of ``docs`` that ``decontaminate`` keeps, their texts without hit spans of more than ``longest`` words.

    A span goes from the first byte of its first word to the last byte of its last; what stands around it stays, so no
    two words grow together.  Spans are judged on the text as given.  Null and empty texts, shorter spans and all other
    columns stay as they are.
    """
    packed = text.packed(docs, F.col("text"))
    found = find_items(packed, benchmark, window, **options).filter(~_contaminated(share))
    long = F.filter(_HITS, lambda s: s[1] - s[0] > longest)
    found = found.select("_doc", "text", long.alias("_cut"))

    def cut(batches):
        for batch in text.slices(batches):
            column = batch.column(batch.schema.get_field_index("text"))
            data, offsets = text.flat(column)
            starts, ends, first = text.spans(text.LOWER[data], offsets, text.LETTER_WORDS)
            keep = np.ones(len(data), bool)
            for doc, spans in enumerate(batch.column(batch.schema.get_field_index("_cut")).to_pylist()):
                for low, high in spans:
                    keep[starts[first[doc] + low] : ends[first[doc] + high - 1]] = False
            at = np.concatenate([[0], np.cumsum(keep)])[offsets]
            body = pa.py_buffer(data[keep].tobytes())
            left = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(at.astype(np.int64).tobytes()), body)
            yield pa.RecordBatch.from_arrays([batch.column(0), left.cast(pa.string()), batch.column(2)], names=["_doc", "text", "_cut"])

    done = found.mapInArrow(cut, found.schema)
    whole = F.when(F.size("_cut") > 0, F.col("text")).otherwise(F.col("_doc.text"))
    return done.select(F.col("_doc").withField("text", whole).alias("_doc")).select("_doc.*")


def op6_decontamination(spark, sf_dir):
    found = contamination_report(text.table(spark, sf_dir, "documents"), text.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op6_decontamination": op6_decontamination}

ORACLES = {
    "op6_decontamination": r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
places AS (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS words FROM places),
doc_places AS (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM wins) WHERE len(w) >= m),
doc_wins AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS words FROM doc_places),
met AS (SELECT doc_id, i, m, item_id FROM doc_wins JOIN wins USING (m, words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM met) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
""",
}
