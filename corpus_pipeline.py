"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Rows without doc_id, null texts and extra columns go through every stage as the operators of the stages define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, mixing, quality, simhash, suffix_dedup
from graphloom.llm.common import cut


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier, fitted on the labelled rows, rejects."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates."""
    return simhash.one_of_each(docs)


def first_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that also start earlier in the corpus."""
    return suffix_dedup.deduplicated(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which items of the benchmark leak."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of the sources takes."""
    return mixing.mix(docs)


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each_group), ("repeated_passages", first_passages), ("test_items", without_test_items), ("mixing", mixed_sources)]

#: The first stage learns a classifier, which SQL cannot express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
