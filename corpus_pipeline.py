"""Corpus preparation from documents to token files, in stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreline.functions.blocks import durable
from boreline.llm import contamination, languages, mixture, setjoin, text, tokenfiles
from boreline.session import attach


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those go that op5 calls ``und``, whose text is null or has no letter."""
    attach(spark)
    filters = languages.learn_filters(docs.filter(~languages.held_out()))
    found = languages.predict_languages(text.packed(docs, F.col("text")), filters)
    return found.filter(F.col("lang_pred") != languages.UNKNOWN).select("_doc.*")


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by similar sets of shingles."""
    attach(spark)
    return setjoin.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that benchmark items contaminate."""
    attach(spark)
    return contamination.decontaminate(docs, text.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    attach(spark)
    return mixture.repeat_documents(docs, durable(mixture.mix_sources(docs)))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of all that is left, as read back."""
    attach(spark)
    return tokenfiles.token_files(spark, docs)


STAGES = [
    ("language_id", identify_languages),
    ("near_copies", join_near_copies),
    ("decontamination", remove_benchmark),
    ("mixture", mix),
    ("token_files", write_tokens),
]

#: The tokenizer can't be had in SQL; a test compares run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
