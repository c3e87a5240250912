"""The corpus pipeline: stages that each filter, mix or encode what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import decontaminate, jaccard, mixing, quality, token_files
from tablewright.llm.queries import BYTE_BPE, quality_labels
from tablewright.session import Tables
from tablewright.storage import discard, materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the stage's own input, does not reject."""
    return quality.keep_good(docs, *quality.train(docs, quality_labels(Tables(spark, sf_dir).labels)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least id."""
    return jaccard.without_duplicates(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, Tables(spark, sf_dir).benchmark)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_files(docs, BYTE_BPE)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", not_in_benchmark),
    ("mixing sources to target weights", mixed_sources),
    ("token-ID / binary output", token_ids),
]
# Training, retrieval and the tokenizer have no SQL; the stages are tested against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
