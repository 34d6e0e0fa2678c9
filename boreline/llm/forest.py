"""Approximate nearest neighbours by a forest of random-projection trees and one priority queue over all of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreline.functions.blocks import durable
from boreline.llm import text

TREES = 8
#: Vectors the trees are fitted on, about, chosen by a hash of the smallest id that has them; every vector is indexed.
SAMPLE = 1 << 15
#: Sampled vectors in a leaf.
LEAF = 64
#: Share of the true neighbours, within the sample, that the number of leaves read per query is set to reach.
RECALL = 0.97
TRIALS = 256
SEED = 3
NEIGHBOURS = 5
#: Queries that meet a leaf at once, and neighbouring leaves of a tree whose best a query gets together.
QUERY_BLOCK = 512
LEAVES_TOGETHER = 16


class Forest:
    """Complete binary trees.  A node splits by the sign of ``x . normal - threshold``: the normal joins two sampled
    vectors of the node, the threshold is the median, so leaves hold equal shares of the sample."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.trees, self.width = trees, sample.shape[1]
        self.depth = max(0, (len(sample) // max(1, leaf)).bit_length() - 1)
        self.leaves = 1 << self.depth
        self.normals = np.zeros((trees, self.leaves - 1, self.width))
        self.thresholds = np.zeros((trees, self.leaves - 1))
        for tree in range(trees):
            members = {0: np.arange(len(sample))}
            for node in range(self.leaves - 1):
                own = members.pop(node)
                if len(own) > 1:
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    normal = a - b
                else:
                    normal = rng.normal(size=self.width)
                normal /= np.linalg.norm(normal) or 1
                along = sample[own] @ normal
                cut = float(np.median(along)) if len(own) else 0.0
                self.normals[tree, node], self.thresholds[tree, node] = normal, cut
                members[2 * node + 1], members[2 * node + 2] = own[along < cut], own[along >= cut]
        self.read = trees * self.leaves

    def place(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, numbered through all trees."""
        out = np.zeros((len(unit), self.trees), np.int64)
        for tree in range(self.trees):
            node = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", unit, self.normals[tree, node]) >= self.thresholds[tree, node]
                node = 2 * node + 1 + right
            out[:, tree] = tree * self.leaves + node - (self.leaves - 1)
        return out

    def queue(self, unit: np.ndarray) -> np.ndarray:
        """Per query all leaves of all trees, in the order in which one priority queue gives them out.

        The queue holds nodes of all trees under the least margin on their way, largest first.  A child's margin is never
        above its parent's, so leaves come out in the order of their own margins, and the queue is one sort of these.
        """
        margins = np.empty((len(unit), self.trees, self.leaves))
        for tree in range(self.trees):
            side = unit @ self.normals[tree].T - self.thresholds[tree]
            level = np.full((len(unit), 1), np.inf)
            for d in range(self.depth):
                first = (1 << d) - 1
                own = side[:, first : 2 * first + 1]
                level = np.stack([np.minimum(level, -own), np.minimum(level, own)], axis=2).reshape(len(unit), -1)
            margins[:, tree] = level
        return np.argsort(-margins.reshape(len(unit), -1), axis=1, kind="stable")

    def calibrate(self, sample: np.ndarray, recall: float, k: int, trials: int, seed: int) -> None:
        """Sets how many leaves a query reads: so many that ``recall`` of the true neighbours of sampled vectors,
        found within the sample by comparing all, stand in one of them."""
        if len(sample) < 2:
            return
        tried = np.random.default_rng(seed).permutation(len(sample))[:trials]
        cosines = sample[tried] @ sample.T
        cosines[np.arange(len(tried)), tried] = -np.inf
        k = min(k, len(sample) - 1)
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        turn = np.argsort(self.queue(sample[tried]), axis=1)
        found = np.take_along_axis(turn[:, None, :], self.place(sample)[near], axis=2).min(axis=2)
        self.read = int(np.sort(found.ravel())[min(found.size - 1, int(recall * found.size))]) + 1


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of the rows that can be compared.

    Out go null ids, and vectors that are null, empty, all zero, or hold a null or a component that isn't finite; so do
    vectors of another length than the commonest (the longest of equally common ones).
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sound = sound.filter(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    top = sound.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return sound.filter(F.size("embedding") == (top["n"] if top else -1))


def nearest(vectors: DataFrame, is_query, k: int = NEIGHBOURS, trees: int = TREES, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """For every row of ``vectors`` (vec_id, embedding) that ``is_query`` holds for, its ``k`` nearest by cosine:
    query_id, rank, vec_id, score.

    A query's own id is no candidate; ties go to the smaller id; with fewer candidates all are returned.  Equal vectors
    are searched once, and as candidates only the ``k + 1`` smallest ids of a vector can matter, so large groups of
    copies cost no more than one.  Rows with one id and several vectors count as one candidate, with the best score.
    What ``sound_vectors`` leaves out takes no part.  Each leaf's vectors meet the queries that read it in one task, as a
    product of two matrices, and of a few leaves together the best ``k + 1`` per query go on.
    """
    spark = vectors.sparkSession
    sound = durable(sound_vectors(vectors).distinct())
    first = Window.partitionBy("embedding").orderBy("vec_id")
    # Ranks are cut before the shuffle already, so copies of one vector don't meet in a task.
    kept = durable(sound.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1))
    single = kept.filter("place = 1").select(F.col("vec_id").alias("class"), "embedding")
    members = kept.join(single, "embedding").select("class", "vec_id")
    queries = sound.filter(is_query).select(F.col("vec_id").alias("query_id"), "embedding").join(single, "embedding").select("query_id", "class")
    queries = durable(queries)

    head = single.first()
    width = len(head["embedding"]) if head else 0
    total = single.count()
    parts = 1 << 20
    chosen = single.filter(F.pmod(F.xxhash64("class", F.lit(SEED)), F.lit(parts)) < min(parts, -(-sample * parts // max(1, total)))).toArrow()
    points = _matrix(chosen.column("embedding").combine_chunks(), width) if chosen.num_rows else np.zeros((0, max(1, width)))
    points = _unit(points[np.argsort(chosen.column("class").to_numpy())])
    forest = Forest(points, trees, LEAF, SEED)
    forest.calibrate(points, recall, k, TRIALS, SEED)
    shared = spark.sparkContext.broadcast(forest)  # bounded by the sample

    def indexed(batches):
        for batch in batches:
            if batch.num_rows:
                places = shared.value.place(_unit(_matrix(batch.column(1), width)))
                at = pa.array(np.repeat(np.arange(batch.num_rows), places.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(places.ravel()), batch.column(0).take(at), batch.column(1).take(at)], ["leaf", "class", "embedding"])

    def asked(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                leaves = shared.value.queue(_unit(_matrix(part.column(1), width)))[:, : shared.value.read]
                again = pa.array(np.repeat(np.arange(part.num_rows), leaves.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(leaves.ravel()), part.column(0).take(again), part.column(1).take(again)], ["leaf", "class", "embedding"])

    def best_of(left: pd.DataFrame, right: pd.DataFrame) -> list[pd.DataFrame]:
        """The best ``k + 1`` of one leaf for each query that reads it."""
        vectors, classes, found = np.stack(right["embedding"]), right["class"].to_numpy(), []
        sizes = np.linalg.norm(vectors, axis=1)
        for at in range(0, len(left), QUERY_BLOCK):
            part = left.iloc[at : at + QUERY_BLOCK]
            queries = np.stack(part["embedding"])
            cosines = queries @ vectors.T / (np.linalg.norm(queries, axis=1)[:, None] * sizes)
            some = min(k + 1, len(classes))
            best = np.argpartition(-cosines, some - 1, axis=1)[:, :some]
            found.append(pd.DataFrame({
                "asking": np.repeat(part["class"].to_numpy(), some), "class": classes[best].ravel(),
                "score": np.take_along_axis(cosines, best, axis=1).ravel()}))
        return found

    def meet(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        leaves = dict(iter(held.groupby("leaf")))
        found = [part for leaf, left in asking.groupby("leaf") if leaf in leaves for part in best_of(left, leaves[leaf])]
        if not found:
            return pd.DataFrame({"asking": [], "class": [], "score": []})
        # A tree has each class in one leaf only, so none is listed twice.
        every = pd.concat(found).sort_values(["asking", "score", "class"], ascending=[True, False, True])
        return every.groupby("asking").head(k + 1)

    layout = "leaf long, class long, embedding array<double>"
    held = single.mapInArrow(indexed, layout)
    asking = single.join(queries.select("class").distinct(), "class").select("class", "embedding").mapInArrow(asked, layout)
    # Leaves are numbered tree by tree, and a tree has a power of two of them.
    together = F.floor(F.col("leaf") / min(LEAVES_TOGETHER, forest.leaves)).cast("long").alias("together")
    pairs = asking.groupBy(together).cogroup(held.groupBy(together)).applyInPandas(meet, "asking long, class long, score double")
    # A class can be found in several trees; the largest of scores that differ in their last bit is kept.
    pairs = pairs.groupBy("asking", "class").agg(F.max("score").alias("score"))
    top = Window.partitionBy("asking").orderBy(F.desc("score"), "class")
    pairs = durable(pairs.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= k + 1).drop("place"))
    listed = pairs.join(members, "class").select("asking", "vec_id", "score")
    each = Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("place", F.row_number().over(each)).filter(F.col("place") <= k + 1).drop("place")
    answers = queries.join(listed.withColumnRenamed("asking", "class"), "class").filter("vec_id <> query_id")
    answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark, sf_dir):
    return nearest(text.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op7_neighbours": op7_neighbours}
ORACLES: dict[str, str] = {}
