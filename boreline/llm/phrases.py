"""Phrases whose words stand together more often than chance, mined by an FM-index over the words of each shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreline.functions.blocks import durable
from boreline.llm import text
from boreline.llm.bits import bit_filter, passes

LONGEST = 3
LEAST = 10
#: A candidate goes if a longer one around it occurs at least so many hundredths as often.
COVERED = 50
SCALE = 1_000_000
TOP = 2000
#: Language of texts whose ``lang`` is null.
UNKNOWN = "und"
#: Bytes of text in one shard; a longer text is a shard of its own.
SHARD_BYTES = 2 << 20
_ROWS_OUT = 1 << 17

_MARKS = text._class(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D), outside=False)
#: Bytes inside a word: neither marks that end a piece nor blanks and tabs.
_WORDS = ~_MARKS
_WORDS[[0x20, 0x09]] = False


class Half:
    """A Burrows-Wheeler string over word numbers, by the order of the suffixes' first ``depth`` words.

    ``before`` holds the word in front of each suffix.  An order by ``depth`` words is enough to extend any phrase of
    fewer words to the left: the suffixes that begin with a phrase stand together, and stepping from them to the words in
    front of them keeps their order.
    """

    def __init__(self, ids: np.ndarray, words: int, depth: int):
        key, size = ids.astype(np.int64), words
        rest = ids.astype(np.int64)
        for _ in range(depth - 1):
            # Past a separator, 0, nothing is compared.
            rest = np.where(rest > 0, np.append(rest[1:], 0), 0)
            if size > (1 << 62) // words:
                found, key = np.unique(key, return_inverse=True)
                size = len(found)
            key, size = key * words + rest, size * words
        order = np.argsort(key)
        self.before = ids[order - 1].astype(np.int64)
        self.first = np.searchsorted(ids[order], np.arange(words + 1))
        self.size = len(ids)
        # Where each word stands in ``before``: word by word, ascending.
        self.stands = np.sort(self.before * self.size + np.arange(self.size))

    def rank(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each word stands in front of the suffixes up to the one number ``at``."""
        return np.searchsorted(self.stands, words * self.size + at) - self.first[words]

    def extend(self, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words in front of the intervals from ``low``: the interval extended, the word, the new interval's low end
        and count, and how many smaller words and separators stand in the old interval."""
        end = np.cumsum(count)
        own = np.repeat(np.arange(len(low)), count)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(low - (end - count), count)
        key = own * len(self.first) + self.before[at]
        key.sort()
        edge = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(np.append(edge, len(key)))
        own, word = np.divmod(key[edge], len(self.first))
        smaller = edge - (end - count)[own]
        some = word > 0
        own, word, times, smaller = own[some], word[some], times[some], smaller[some]
        return own, word, self.first[word] + self.rank(word, low[own]), times, smaller


class Shard:
    """Two halves, over the words and over the same words backwards, whose intervals are kept together: a phrase has one
    interval in each, of one size, and can be extended on both sides."""

    def __init__(self, ids: np.ndarray, words: int, depth: int):
        self.left, self.right = Half(ids, words, depth), Half(ids[::-1], words, depth)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every word as a phrase: its words, both low ends, and its count."""
        own = np.arange(1, len(self.left.first) - 1)
        return own[:, None], self.left.first[own], self.right.first[own], np.diff(self.left.first)[own]

    def extend(self, found, keep, side: str):
        """The phrases of ``found`` (words, both low ends, counts) that ``keep`` marks with every word on one ``side``."""
        phrases, low, back, count = (part[keep] for part in found)
        if side == "left":
            own, word, low, times, smaller = self.left.extend(low, count)
            return np.column_stack([word, phrases[own]]), low, back[own] + smaller, times
        own, word, back, times, smaller = self.right.extend(back, count)
        return np.column_stack([phrases[own], word]), low[own] + smaller, back, times


def shard_words(langs: pa.Array, column: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The words of all texts as numbers from 1, with a 0 behind every piece, and of each number the language and the word.

    A piece ends at a mark, a line or the end of its text.  Equal words of two languages have different numbers.
    """
    data, offsets = text.flat(column)
    data = text.LOWER[data]
    starts, ends, first = text.spans(data, offsets, _WORDS)
    if not len(starts):
        return np.empty(0, np.int64), pa.array([], pa.string()), pa.array([], pa.string())
    inside = _WORDS[data]
    edges = np.concatenate([[0], np.cumsum(ends - starts)])
    body = pa.py_buffer(np.ascontiguousarray(data[inside]))
    spelled = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), body).dictionary_encode()
    spoken = langs.fill_null(UNKNOWN).dictionary_encode()
    texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # Marks before each word; where that number changes, or the text does, a piece ends.
    passed = np.searchsorted(np.flatnonzero(_MARKS[data]), starts)
    last = np.append((np.diff(passed) != 0) | (np.diff(texts) != 0), True)
    key = spoken.indices.to_numpy()[texts].astype(np.int64) * len(spelled.dictionary) + spelled.indices.to_numpy()
    kinds, number = np.unique(key, return_inverse=True)
    ids = np.zeros(len(starts) + int(last.sum()), np.int64)
    ids[np.arange(len(starts)) + np.cumsum(last) - last] = number + 1
    lang, word = np.divmod(kinds, len(spelled.dictionary))
    return ids, spoken.dictionary.take(pa.array(lang)).cast(pa.string()), spelled.dictionary.take(pa.array(word)).cast(pa.string())


def _hashes(words: pa.Array) -> np.ndarray:
    data, offsets = text.flat(words)
    return text.span_hashes(data, offsets[:-1], offsets[1:])


def _phrase_hash(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """A number for each phrase of a language, from the hashes of its words."""
    with np.errstate(over="ignore"):
        out = text.mix(lang)
        for k, word in enumerate(words):
            out = text.mix(out + word * np.uint64(2 * k + 3))
    return out.view(np.int64)


def _spelled(langs: pa.Array, words: pa.Array, phrases: np.ndarray, counts: np.ndarray):
    """Rows of phrases given by word numbers from 1."""
    for at in range(0, len(phrases), _ROWS_OUT):
        some = phrases[at : at + _ROWS_OUT] - 1
        spelled = pc.binary_join_element_wise(*(words.take(pa.array(some[:, k])) for k in range(some.shape[1])), " ")
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(some[:, 0])), pa.array(np.full(len(some), some.shape[1], np.int32)), spelled, pa.array(counts[at : at + _ROWS_OUT].astype(np.int64))],
            ["lang", "k", "phrase", "f"])


def _shards(batches):
    """Batches of about ``SHARD_BYTES`` of text each."""
    held, size = [], 0
    for batch in text.slices(batches, limit=SHARD_BYTES):
        own = text.flat(batch.column(1))[1][-1]
        if held and size + own > SHARD_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
        held.append(batch)
        size += int(own)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _counted(docs: DataFrame, rows) -> DataFrame:
    """lang, k, phrase and f, the sum over all shards of what ``rows(ids, langs, words)`` gives for one."""

    def mine(batches):
        for shard in _shards(batches):
            ids, langs, words = shard_words(shard.column(0).combine_chunks(), shard.column(1))
            if len(ids):
                yield from rows(ids, langs, words)
            del shard, ids, langs, words
            text.release()

    found = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(mine, "lang string, k int, phrase string, f long")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, k (words), phrase and f of the words and phrases of up to ``longest`` words that occur ``least`` times or more
    in their language, and lang and n, the number of all words.

    Texts are lower-cased in A-Z and cut at marks and line ends; phrases stay within a piece.  Every shard counts its own
    words and pairs.  Longer phrases are mined one length at a time: those of ``k`` words that are frequent as a whole are
    extended on the right in every shard, and the last ``k`` words of what comes out have to be frequent too.  Both are
    checked by a filter that spares work and decides nothing.  Null, empty and blank texts have no phrases.
    """

    def pairs(ids, langs, words):
        shard = Shard(ids, len(words) + 1, min(2, longest))
        single = shard.words()
        total = np.bincount(_codes(langs), single[3])
        yield pa.RecordBatch.from_arrays(
            [langs.unique(), pa.array(np.zeros(len(total), np.int32)), pa.array([""] * len(total)), pa.array(total.astype(np.int64))], ["lang", "k", "phrase", "f"])
        yield from _spelled(langs, words, single[0], single[3])
        if longest > 1:
            both = shard.extend(single, slice(None), "left")
            yield from _spelled(langs, words, both[0], both[3])

    counted = durable(_counted(docs, pairs).filter((F.col("f") >= least) | (F.col("k") == 0)))
    total = counted.filter("k = 0").select("lang", F.col("f").alias("n"))
    found = counted.filter("k > 0")
    for k in range(2, longest):
        shared = docs.sparkSession.sparkContext.broadcast(bit_filter(_hashed(found.filter(F.col("k") == k)), F.col("h")))

        def longer(ids, langs, words, k=k, shared=shared):
            shard = Shard(ids, len(words) + 1, k + 1)
            hashes, tongue = _hashes(words), _hashes(langs)

            def frequent(phrases):
                at = phrases - 1
                return passes(shared.value, _phrase_hash(tongue[at[:, 0]], [hashes[at[:, j]] for j in range(at.shape[1])]))

            grown = shard.words()
            for _ in range(k - 1):
                grown = shard.extend(grown, slice(None), "left")
            grown = shard.extend(grown, frequent(grown[0]), "right")
            keep = frequent(grown[0][:, 1:])
            yield from _spelled(langs, words, grown[0][keep], grown[3][keep])

        found = found.unionByName(durable(_counted(docs, longer).filter(F.col("f") >= least)))
    return found, total


def _codes(langs: pa.Array) -> np.ndarray:
    return langs.dictionary_encode().indices.to_numpy()


def _hashed(found: DataFrame) -> DataFrame:
    """h, the phrase hash of each row of ``found`` (lang, phrase), all of one number of words."""

    def make(batches):
        for batch in batches:
            if batch.num_rows:
                parts = pc.split_pattern(batch.column(1), " ")
                width = len(parts[0])
                words = _hashes(parts.flatten()).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array(_phrase_hash(_hashes(batch.column(0)), list(words.T)))], ["h"])

    return found.select("lang", "phrase").mapInArrow(make, "h long")


def extensions(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, phrase, side, word and f of the words that extend frequent phrases, where the longer phrase is frequent too."""
    found, _ = frequent_phrases(docs, longest, least)
    words = F.split("phrase", " ")
    longer = durable(found).filter("k > 1").withColumn("w", words)
    left = longer.select("lang", F.array_join(F.expr("slice(w, 2, k - 1)"), " ").alias("phrase"), F.lit("left").alias("side"), F.col("w")[0].alias("word"), "f")
    right = longer.select("lang", F.array_join(F.expr("slice(w, 1, k - 1)"), " ").alias("phrase"), F.lit("right").alias("side"), F.element_at("w", -1).alias("word"), "f")
    return left.unionByName(right)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of 2 to ``longest`` words of each language.

    a is a phrase's count (``least`` or more) and l and r those of its parts at a cut; the score is the lowest of
    floor(1000000 * a * a / (l * r)) over all cuts, the shortest first part of equal ones.  Phrases inside a longer one
    that occurs ``covered`` hundredths as often, or more, go.  The order is by score, a and phrase (in bytes).  ``docs``
    has lang and text; a null lang is ``und``, rows repeated count again, other columns take no part, and an empty table
    gives an empty one.
    """
    found, total = frequent_phrases(docs, longest, least)
    parts = found.select("lang", "phrase", "f")
    candidates = found.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = candidates.select("lang", "phrase", "a", "w", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("at"))
    cut = cut.select("lang", "phrase", "a", "at", F.array_join(F.expr("slice(w, 1, at)"), " ").alias("head"), F.array_join(F.expr("slice(w, at + 1, k - at)"), " ").alias("tail"))
    cut = cut.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr(f"cast(a AS decimal(19, 0)) * {SCALE} * cast(a AS decimal(19, 0)) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("best"))

    inner = candidates.filter("k > 2").select("lang", "a", "w", "k", F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("at"))
    inner = inner.select("lang", F.array_join(F.expr("slice(w, at, size)"), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_around"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("_around").isNull() | (100 * F.col("_around") < covered * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    # Ranks above the top are cut before the shuffle already.
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir):
    return collocations(text.table(spark, sf_dir, "documents"))


QUERIES = {"op13_phrases": op13_phrases}
ORACLES = {"op13_phrases": r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    counted AS MATERIALIZED (
        SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
    total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
    candidates AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 10),
    cuts AS (SELECT *, unnest(range(1, k)) AS size FROM candidates),
    scored AS (
        SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, c.size, CAST((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
        FROM cuts c
        JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.size], ' ')
        JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.size + 1 :], ' ')),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, size) = 1),
    around AS (
        SELECT lang, phrase, max(a) AS a FROM (SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, a FROM candidates, (SELECT unnest([1, 2]) AS i) WHERE k = 3)
        GROUP BY lang, phrase),
    kept AS (SELECT l.* FROM lowest l LEFT JOIN around o ON o.lang = l.lang AND o.phrase = l.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * l.a)
    SELECT lang, rank, phrase, a, l, r, n, score FROM (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang)
    WHERE rank <= 2000"""}
