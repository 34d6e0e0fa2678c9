"""Language identification by n-gram filters whose slots hold a bit for every language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreline.functions.blocks import durable
from boreline.llm import text

GRAM = 4
#: Documents of one language that are learned from, about; larger languages are sampled by a hash of doc_id and text.
SAMPLE = 4000
#: An n-gram belongs to a language if so large a share of its documents holds it.  The n-grams of a language are then at
#: most the mean number of different n-grams in a document divided by this, however many documents there are.
HELD_BY = 0.01
#: Slots per n-gram, and slots looked up for each.
SLOTS_PER_GRAM = 12
PROBES = 3
#: An inventory of languages is small; a column with more values than this is refused, as it holds something else.
MAX_LANGUAGES = 4096
UNKNOWN = "und"

#: Lower case of A to Z; everything in ASCII that isn't a letter is a blank.
_LETTERS = text.LOWER.copy()
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_LETTER = regex.compile(r"\p{L}")


def _grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit number for the ``n`` bytes at each place, and whether these are of one text and hold a letter first."""
    if len(data) < n:
        return np.empty(0, np.uint32), np.empty(0, bool)
    letters = _LETTERS[data]
    count = len(data) - n + 1
    code = np.zeros(count, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(n):
            code = code * np.uint32(0x01000193 if n > 4 else 256) + letters[k : k + count]
    valid = letters[:count] != 0x20
    for back in range(1, n):
        at = offsets[1:] - back
        valid[at[(at >= 0) & (at < count)]] = False
    return code, valid


def _probes(code: np.ndarray, slots: int):
    """The slots of n-grams: ``slots`` is a power of two, and each probe takes the upper bits of another product."""
    shift = np.uint32(32 - slots.bit_length() + 1)
    with np.errstate(over="ignore"):
        for k in range(PROBES):
            yield (code ^ (code >> np.uint32(15))) * np.uint32((0x9E3779B1 + 0x85EBCA76 * k) % (1 << 32)) >> shift


class Filters:
    """One Bloom filter per language, stored slot by slot: the bits of a slot, anded over the probes of an n-gram, are
    the languages that hold it.  Languages stand in bytes of eight."""

    def __init__(self, languages: list[str], grams: list[tuple[int, int]]):
        """``grams``: pairs of a language's number and an n-gram."""
        self.languages = languages
        lang = np.array([g[0] for g in grams], np.int64)
        code = np.array([g[1] for g in grams], np.uint32)
        most = int(np.bincount(lang, minlength=1).max()) if len(lang) else 1
        self.slots = 1 << max(10, (SLOTS_PER_GRAM * most - 1).bit_length())
        self.bits = np.zeros((-(-len(languages) // 8), self.slots), np.uint8)
        for slot in _probes(code, self.slots):
            for k in range(len(languages)):
                self.bits[k // 8, slot[lang == k]] |= np.uint8(1 << k % 8)
        fill = np.concatenate([[(row >> b & 1).mean() for b in range(8)] for row in self.bits]) if languages else np.empty(0)
        self.false_rate = fill[: len(languages)] ** PROBES

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the number of n-grams, and for every language how many it holds, less its false positives."""
        texts = len(offsets) - 1
        code, valid = _grams(data, offsets, GRAM)
        places = np.flatnonzero(valid)
        doc = np.searchsorted(offsets, places, side="right") - 1
        total = np.bincount(doc, minlength=texts)
        code = code[places]
        slots = list(_probes(code, self.slots))
        held = np.zeros((texts, len(self.languages)))
        for part, row in enumerate(self.bits):
            mask = row[slots[0]]
            for slot in slots[1:]:
                mask &= row[slot]
            table = np.bincount(doc * 256 + mask, minlength=256 * texts).reshape(texts, 256)
            own = np.arange(8 * part, min(8 * part + 8, len(self.languages)))
            held[:, own] = table @ (np.arange(256)[:, None] >> (own - 8 * part) & 1)
        return total, np.maximum(0, (held - total[:, None] * self.false_rate) / (1 - self.false_rate))


def _sampled(docs: DataFrame, sample: int) -> tuple[DataFrame, dict[str, int]]:
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return docs, counts
    parts = 1 << 20
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(parts, -(-sample * parts // n)))])
    return docs.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(parts)) < F.element_at(share, F.col("lang"))), counts


def learn_filters(docs: DataFrame, sample: int = SAMPLE, held_by: float = HELD_BY) -> Filters:
    """Filters of the languages in ``docs`` (doc_id, text, lang); rows without language or text teach nothing.

    About ``sample`` documents of each language are read, the fit of the model; all n-grams of their whole texts are
    counted, each once a document.
    """
    known = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    chosen, counts = _sampled(known, sample)
    languages = sorted(counts, key=lambda x: (-counts[x], x))
    if not languages:
        return Filters([], [])
    number = {lang: k for k, lang in enumerate(languages)}

    def count(batches):
        for batch in text.slices(batches):
            lang = np.array([number[x] for x in batch.column(2).to_pylist()])
            data, offsets = text.flat(batch.column(1))
            code, valid = _grams(data, offsets, GRAM)
            places = np.flatnonzero(valid)
            doc = np.searchsorted(offsets, places, side="right") - 1
            once = np.unique(doc.astype(np.uint64) << np.uint64(32) | code[places])
            key = lang[(once >> np.uint64(32)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | once & np.uint64(0xFFFFFFFF)
            pairs, docs_with = np.unique(key, return_counts=True)
            # One row without an n-gram per document tells how many there are.
            own = np.bincount(lang, minlength=len(languages))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([(pairs >> np.uint64(32)).astype(np.int32), np.arange(len(languages), dtype=np.int32)])),
                pa.array(np.concatenate([(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), np.full(len(languages), -1)])),
                pa.array(np.concatenate([docs_with, own]))], ["lang", "gram", "docs"])

    found = durable(chosen.mapInArrow(count, "lang int, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs")))
    read = {r["lang"]: r["docs"] for r in found.filter("gram = -1").collect()}
    enough = F.lit(None).cast("double")
    for k, n in read.items():
        enough = F.when(F.col("lang") == k, F.lit(held_by * n)).otherwise(enough)
    grams = found.filter((F.col("gram") >= 0) & (F.col("docs") >= enough)).select("lang", "gram").collect()
    return Filters(languages, sorted((r["lang"], r["gram"]) for r in grams))


def predict_languages(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` with the columns ``lang_pred`` and ``lang_score``, in place of any of these names, from every whole ``text``.

    The language that holds most of the text's n-grams, counted each time they occur and corrected for the filter's
    false positives; ties go to the language with more documents learned from.  The score is its share of the counts of all languages.  A text that is
    null or has no letter, and every text if nothing was learned, is ``und`` with score 0.  A text with letters whose
    n-grams are all unknown, or that is too short to have one, goes to the commonest language with score 0.
    """
    docs = docs.drop("lang_pred", "lang_score")
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string", "lang_score double"]
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded: see HELD_BY

    def predict(batches):
        own = shared.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in text.slices(batches):
            column = batch.column(batch.schema.get_field_index("text"))
            data, offsets = text.flat(column)
            letters = np.concatenate([[0], np.cumsum((_LETTERS[data] != 0x20) & (data < 128))])
            has_letter = np.diff(letters[offsets]) > 0
            for i in np.flatnonzero(~has_letter & (np.diff(offsets) > 0)):
                has_letter[i] = _LETTER.search(column[int(i)].as_py()) is not None
            best, score = np.full(batch.num_rows, len(own.languages)), np.zeros(batch.num_rows)
            if own.languages:
                _, held = own.counts(data, offsets)
                first, sums = held.argmax(axis=1), held.sum(axis=1)
                best = np.where(has_letter, first, best)
                top = held[np.arange(len(held)), first]
                score = np.where(has_letter & (sums > 0), top / np.where(sums > 0, sums, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(predict, ", ".join(fields))


def held_out():
    return text.fold(F.col("doc_id")) % 4 == 2


def op5_languages(spark, sf_dir):
    docs = text.table(spark, sf_dir, "documents")
    filters = learn_filters(docs.filter(~held_out()))
    found = predict_languages(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op5_languages": op5_languages}
ORACLES: dict[str, str] = {}
