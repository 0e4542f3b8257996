"""Training-data pipeline: each stage is one operator over all documents that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and reads it again as the next
stage's docs. All but the last return the columns of documents; the last has tokens in place of text.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import bpe, exchange, jaccard_join, mixing, quality_rules, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier in the corpus."""
    return suffix_dedup.drop_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources asks for."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents in place of their texts."""
    return bpe.encode(docs, drop_text=True)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", repeats), ("mixture of sources", mixture), ("tokens", tokens)]

#: The last stage's byte-pair merges can't be told in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents. Results between stages lie in the shared checkpoint folder."""
    folder = os.path.join(exchange.shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            # What a stage read isn't needed once its result is written: a run holds two of them at most, and leaves one.
            exchange.remove(spark, f"{folder}/{k - 1}")
    return docs
