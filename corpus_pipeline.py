"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.op1_mixing import mix
from foliospark.llm.op7_jaccard import keep_one
from foliospark.llm.op8_decontamination import keep_clean
from foliospark.llm.op9_rules import keep_good
from foliospark.llm.op10_privacy import redact
from foliospark.llm.shared import Scratch, documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio against the labelled good ones."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.8 and more join."""
    return keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a mark in place of personal data."""
    return redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it, with the number of the copy."""
    return mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("jaccard_join", one_of_each),
    ("decontamination", decontaminated),
    ("privacy", private),
    ("mixing", mixed),
]
#: Hashed likelihood ratios, spans of a fitted model and random rounding have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = documents(spark, sf_dir)
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        done, docs = docs, scratch.store(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(done)
    return docs
