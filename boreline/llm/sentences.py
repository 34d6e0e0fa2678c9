"""Substring dedup by sliding sentence spans: every run of several sentences is hashed and joined over all documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boreline.functions.blocks import durable
from boreline.llm import repeats, text

#: Sentences of a run, and words that it has at least; a run with fewer words goes on to further sentences.
RUN = 3
LEAST_WORDS = 12
#: A sentence of more words is cut, so that any passage of 50 words holds whole runs, wherever it stands.
LONGEST = 10

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over each ``width`` neighbours."""
    done, out = 1, values
    while 2 * done <= width:
        out, done = op(out[: len(out) - done], out[done:]), 2 * done
    rest = width - done
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of texts: the first word of each (one entry more), the first sentence of each text (one more), and the
    hash and first byte of each word.

    Words are runs of letters, digits and non-ASCII characters, lower-cased.  A sentence ends with a word before a full
    stop, exclamation or question mark or line end.  A sentence of more than ``LONGEST`` words also ends with each word
    whose hash is the least of ``LONGEST`` words in a row, so these cuts depend on near words only.
    """
    lowered = text.LOWER[data]
    starts, ends, first = text.spans(lowered, offsets, text.LETTER_WORDS)
    hashes = text.span_hashes(lowered, starts, ends)
    n = len(starts)
    last = np.zeros(n + 1, bool)
    if n:
        marks = np.concatenate([[0], np.cumsum(_ENDS[data])])
        last[1:n] = marks[starts[1:]] > marks[ends[:-1]]
        last[first] = True
        last[n] = True
        edges = np.flatnonzero(last)
        edges = edges if edges[0] == 0 else np.concatenate([[0], edges])
        long = np.repeat(np.diff(edges) > LONGEST, np.diff(edges))
        if long.any() and n >= LONGEST:
            least = _sliding(hashes, LONGEST, np.minimum)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            least[doc[LONGEST - 1 :] != doc[: len(least)]] = 0
            around = np.concatenate([np.zeros(LONGEST - 1, np.uint64), least, np.zeros(LONGEST - 1, np.uint64)])
            picked = _sliding(around, LONGEST, np.maximum) == hashes
            last[1:] |= picked & long
        last[0] = True
    cuts = np.flatnonzero(last) if n else np.zeros(1, np.int64)
    return cuts, np.searchsorted(cuts, first), hashes, starts


def runs(cuts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per run: its first sentence, the sentence after its last, and its text.  A run begins with every sentence from
    which ``RUN`` sentences and ``LEAST_WORDS`` words are left; a text too short for one is one run itself."""
    count = len(cuts) - 1
    begin = np.arange(count)
    end = np.maximum(begin + RUN, np.searchsorted(cuts, cuts[:-1] + LEAST_WORDS))
    doc = np.searchsorted(first, begin, side="right") - 1
    fits = end <= first[doc + 1]
    has = np.bincount(doc[fits], minlength=len(first) - 1) > 0
    alone = np.flatnonzero(~has & (np.diff(first) > 0))
    begin, end, doc = (np.concatenate([a[fits], b]) for a, b in ((begin, first[alone]), (end, first[alone + 1]), (doc, alone)))
    return begin, end, doc


_STEP = 0x9FB21C651E98DF25


def _run_hashes(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the words ``low`` to ``high``, in their order."""
    up = np.full(len(hashes) + 1, _STEP, np.uint64)
    down = np.full(len(hashes) + 1, pow(_STEP, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1])])
    return text.mix((run[high] - run[low]) * down[low] + (high - low).astype(np.uint64))


def sentence_runs(docs: DataFrame) -> DataFrame:
    """h, doc_id and place of every run of sentences in the whole texts of ``docs``."""

    def make(batches):
        for batch in text.slices(batches):
            data, offsets = text.flat(batch.column(1))
            cuts, first, hashes, _ = split(data, offsets)
            begin, end, doc = runs(cuts, first)
            h = _run_hashes(hashes, cuts[begin], cuts[end])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), batch.column(0).take(pa.array(doc)), pa.array(repeats.places(batch.column(1), doc, begin - first[doc]))],
                ["h", "doc_id", "place"])

    return docs.select("doc_id", "text").mapInArrow(make, "h long, doc_id long, place long")


def _cover(data: np.ndarray, found: np.ndarray) -> np.ndarray:
    cuts, first, _, starts = split(data, np.array([0, len(data)]))
    begin, end, _ = runs(cuts, first)
    edges = np.concatenate([[0], starts[cuts[1:-1]], [len(data)]])
    at = np.isin(begin, found)
    return np.stack([edges[begin[at]], edges[end[at]]], axis=1)


def remove_repeated_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of ``docs`` (doc_id, text), less repeated sentences.

    Every run of sentences with the same words, whatever their case and marks, as one in an earlier document or earlier
    in its own is taken out, with the marks and blanks after it; the first in order of doc_id (null last) stays.  Runs
    are judged on the input.  A null or empty text has none; a text without words is kept.  Rows that agree in doc_id
    and text are one document.
    """
    rows = durable(sentence_runs(docs))
    return repeats.without(docs, repeats.later(durable(repeats.repeated(rows))), _cover)


def op4_sentence_spans(spark, sf_dir):
    return repeats.digest(remove_repeated_sentences(text.table(spark, sf_dir, "documents")))


QUERIES = {"op4_sentence_spans": op4_sentence_spans}
ORACLES: dict[str, str] = {}
