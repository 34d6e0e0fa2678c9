"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreline.functions.blocks import durable
from boreline.llm import running, text

EPOCHS = 3
CYCLE = (5, 2, 1)
SEED = 7


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` (double) and ``capped`` to a table of sources with ``source_size`` and ``weight`` (both long).

    All sizes together are shared out by weight.  A source whose share is above ``epochs`` times its size is clamped
    there, and what is left is shared among the others by weight, until no share is above its bound.  Each round is one
    aggregation, and comparisons are exact, in decimals.  A source of size 0 gets 0.
    """
    bound = (F.col("source_size") * epochs).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("decimal(38,0)") for x in ("source_size", "weight")]
    total, weights = sources.agg(*sums).first()
    left, capped = (int(total), int(weights)), F.lit(False)
    while True:
        rest, share = left
        capped = bound * F.lit(share).cast("decimal(20,0)") < F.lit(rest).cast("decimal(30,0)") * F.col("weight")
        size, weight = sources.filter(capped).agg(*sums).first()
        found = (int(total) - epochs * int(size), int(weights) - int(weight))
        if found == left or not found[1]:
            break
        left = found
    target = F.when(capped, bound.cast("double")).otherwise(F.lit(float(rest)) * F.col("weight") / F.lit(float(share or 1)))
    return sources.withColumns({"target": target, "capped": F.coalesce(capped, F.lit(False))})


def mix_sources(docs: DataFrame, weights: Sequence[int] = CYCLE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, row, size, source_size, target, times, taken.

    ``size`` counts the words of the whole text (null: 0).  Sources in code point order, null last, take the weights in
    turn.  A source's target is reached by whole repetitions of all its documents and one more of those that come first
    in a seeded order, up to the document whose middle passes the target; so the words taken miss the target by half a
    document at most, and no document is taken more than ``epochs`` times.  Rows with one doc_id are rows of their own;
    null doc_ids take the place of the text ``null``; texts without words are taken 0 words, any number of times; an empty table gives no rows.
    ``row`` is the key by which ``repeat_documents`` finds the row again.
    """
    key = F.md5(F.concat(F.lit(f"mix-{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(text.SPACED)), F.lit(0)).cast("long")
    sized = durable(docs.select("doc_id", "source", text.row_key().alias("row"), size.alias("size"), key.alias("_key")))

    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1).cast("long"))
    sources = running.before(sources, [F.col("source").asc_nulls_last()], "_one", "_place")
    turn = F.array(*[F.lit(int(w)) for w in weights])
    sources = sources.withColumn("weight", F.element_at(turn, (F.col("_place") % len(weights) + 1).cast("int")).cast("long"))
    plan = durable(water_fill(sources, epochs))
    whole = F.when(F.col("capped"), epochs).when(F.col("source_size") == 0, 0)
    whole = whole.otherwise(F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs - 1))).cast("long")
    plan = plan.withColumn("_whole", whole).withColumn("_quota", F.col("target") - F.col("_whole") * F.col("source_size"))
    plan = running.before(plan, [F.col("source").asc_nulls_last()], "source_size", "_base")
    plan = plan.select(F.col("source").alias("_source"), "source_size", "target", "_whole", "_quota", "_base")

    ordered = running.before(sized, [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id"), F.col("size")], "size", "_before")
    joined = ordered.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    extra = (F.col("_before") - F.col("_base") + F.col("size") / 2 <= F.col("_quota")).cast("long")
    joined = joined.withColumn("times", F.least(F.col("_whole") + extra, F.lit(epochs).cast("long")))
    return joined.select("doc_id", "source", "row", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Every row of ``docs`` as often as ``mixed``, made of the same rows, says, with all its columns."""
    turns = mixed.groupBy("row").agg(F.array_sort(F.collect_list("times")).alias("_times"))
    found = text.numbered(docs).join(turns, F.col("_row") == F.col("row"))
    times = F.element_at("_times", F.col("_nth")).cast("int")
    found = found.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times)))
    return found.select("_doc.*")


def op9_mix_sources(spark, sf_dir):
    docs = text.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mix_sources": op9_mix_sources}

ORACLES = {
    "op9_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-7:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, sum(source_size) OVER ()::HUGEINT AS total,
         coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS full_before,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS weight_left
  FROM sources WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST)),
clamped AS (SELECT *, 3 * source_size::HUGEINT * weight_left < (total - full_before) * weight AS capped FROM ranked),
rest AS (
  SELECT sum(source_size) - coalesce(sum(3 * source_size) FILTER (capped), 0) AS rest,
         coalesce(sum(weight) FILTER (NOT capped), 1) AS share FROM clamped),
plan AS (
  SELECT source, source_size,
         CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE rest::DOUBLE * weight / share::DOUBLE END AS target,
         CASE WHEN capped THEN 3 WHEN source_size = 0 THEN 0
              ELSE least(floor(rest::DOUBLE * weight / share::DOUBLE / source_size), 2) END::BIGINT AS whole
  FROM clamped, rest),
ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier FROM sized)
SELECT doc_id, size, source_size, target,
       (size * (whole + (earlier + size / 2 <= target - whole * source_size)::BIGINT))::BIGINT AS taken
FROM ordered JOIN plan ON ordered.source IS NOT DISTINCT FROM plan.source
""",
}
