"""Quality classifier on learned vectors of hashed words and byte n-grams, averaged per document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreline.functions.blocks import durable
from boreline.llm import text

BUCKETS = 1 << 18
#: The bucket of repeated words, which hashing may give to others too.
REPEATED = 0
GRAM = 3
WIDTH = 8
EPOCHS = 12
BATCH = 16
RATE = 0.5
#: Labelled documents of one class that the model is fitted on, about; more are sampled by a hash of doc_id.
SAMPLE = 3000
THRESHOLD = 0.7
SEED = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and n-grams in the texts, and the place in them where each text's begin (one more).

    Words end at white space and keep their case and marks; n-grams are runs of three UTF-8 bytes.  A word that is the
    one before it again goes to a bucket of its own, so that repeating is learned whatever the word.
    """
    starts, ends, first = text.spans(data, offsets, text.SPACE_WORDS)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    hashes = text.span_hashes(data, starts, ends, seed=1)
    words = (hashes >> shift).astype(np.int32)
    again = np.zeros(len(words), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][first[:-1] < len(words)]] = False
    words[again] = REPEATED
    count = max(0, len(data) - GRAM + 1)
    code = np.zeros(count, np.uint32)
    for k in range(GRAM):
        code = code << np.uint32(8) | data[k : k + count]
    with np.errstate(over="ignore"):
        grams = ((code + np.uint32(1)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)
    inside = np.ones(count, bool)
    for back in range(1, GRAM):
        at = offsets[1:] - back
        inside[at[(at >= 0) & (at < count)]] = False
    grams = grams[inside]
    per_text = np.maximum(0, np.diff(offsets) - GRAM + 1)
    gram_first = np.concatenate([[0], np.cumsum(per_text)])
    # Words of a text, then its n-grams.
    out = np.empty(len(words) + len(grams), np.int32)
    begin = first + gram_first
    out[np.arange(len(words)) + np.repeat(gram_first[:-1], np.diff(first))] = words
    out[np.arange(len(grams)) + np.repeat(first[1:], per_text)] = grams
    return out, begin


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Trains on (buckets, counts, class) by stochastic gradient descent; returns per bucket and class the score of one
    occurrence, and the bias of each class.  The output is linear in the average, so vectors and output weights are
    multiplied out."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, classes), np.float32), np.zeros(classes, np.float32)
    steps, done = EPOCHS * -(-len(rows) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            part = [rows[i] for i in order[at : at + BATCH]]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            sizes = np.array([len(b) for b, _, _ in part])
            first = np.cumsum(sizes) - sizes
            ids = np.concatenate([b for b, _, _ in part])
            share = np.concatenate([c / c.sum() for _, c, _ in part]).astype(np.float32)
            mean = np.add.reduceat(vectors[ids] * share[:, None], first, axis=0)
            raw = mean @ out + bias
            p = np.exp(raw - raw.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), [y for _, _, y in part]] -= 1
            back = p @ out.T
            out -= rate * (mean.T @ p) / len(part)
            bias -= rate * p.mean(axis=0)
            # Each vector moves by its share times the number of different ones in the text, 1 on average.
            move = -rate * np.repeat(back * sizes[:, None], sizes, axis=0) * share[:, None]
            np.add.at(vectors, ids, move)
    return vectors @ out, bias


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The model for ``quality`` 0 or 1 of ``labels`` (doc_id, quality), from the texts of ``docs``.

    About ``sample`` labelled documents of each class are used, chosen by a hash of doc_id.  Rows without label or
    doc_id teach nothing; a doc_id labelled twice counts twice.  Without any label all scores are 0.5.
    """
    labelled = durable(labels.select("doc_id", "quality").filter("quality IN (0, 1) AND doc_id IS NOT NULL"))
    counts = {r["quality"]: r["n"] for r in labelled.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return np.zeros(BUCKETS), np.zeros(1)
    parts = 1 << 20
    share = F.lit(0)
    for label, n in sorted(counts.items()):
        share = F.when(F.col("quality") == label, min(parts, -(-sample * parts // n))).otherwise(share)
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(parts)) < share).withColumnRenamed("doc_id", "_labelled")

    def rows(batches):
        for batch in text.slices(batches):
            data, offsets = text.flat(batch.column(1))
            ids, first = features(data, offsets)
            own = [np.unique(ids[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([b.astype("<i4").tobytes() for b, _ in own], pa.binary()),
                pa.array([c.astype("<i4").tobytes() for _, c in own], pa.binary())], ["doc_id", "quality", "buckets", "counts"])

    # The sample is bounded by its parameter, so it may be broadcast, and its features collected.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"))
    found = joined.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(rows, "doc_id long, quality int, buckets binary, counts binary")
    got = sorted((r["doc_id"], r["quality"], bytes(r["buckets"]), bytes(r["counts"])) for r in found.collect())
    train = [(np.frombuffer(b, "<i4"), np.frombuffer(c, "<i4"), y) for _, y, b, c in got if b]
    if not train:
        return np.zeros(BUCKETS), np.zeros(1)
    weights, bias = fit(train, 2)
    return (weights[:, 1] - weights[:, 0]).astype(np.float64), (bias[1:] - bias[:1]).astype(np.float64)


def score_quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with two columns, in place of any of these names, from every whole ``text``: ``score``, the softmax
    output of class 1, and ``predicted``.  A text without features, null or empty, has the score of the bias alone."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double", "predicted int"]

    def score(batches):
        weights, bias = shared.value
        for batch in text.slices(batches):
            data, offsets = text.flat(batch.column(batch.schema.get_field_index("text")))
            ids, first = features(data, offsets)
            sizes = np.diff(first)
            sums = np.zeros(batch.num_rows)
            some = np.flatnonzero(sizes)
            if len(some):
                sums[some] = np.add.reduceat(weights[ids], first[:-1][some])
            p = 1 / (1 + np.exp(-(sums / np.maximum(1, sizes) + bias[0])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(score, ", ".join(fields))


def held_out():
    return text.fold(F.col("doc_id")) % 4 == 2


def op1_quality(spark, sf_dir):
    docs = text.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = text.table(spark, sf_dir, "labels").filter(~held_out())
    found = score_quality(docs, learn_quality(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
