"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, sources are mixed to target weights, the mix is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import jaccard, mixing, packing, tokens, toxicity
from codeloom.llm.common import discard, stash, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.default_path(), most=2048)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: No SQL can express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir))
        if docs is not before:
            discard(before)  # a stage's table is written whole, so the one before it is not read again
    return STAGES[-1][1](spark, docs, sf_dir)
