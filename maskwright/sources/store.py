"""Registries and reports on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

REGISTRY = "normalized_hash string, token string, namespace string, document_id bigint, field_context string, confidence double"
_RECORD = "struct<token: string, namespace: string, normalized_hash: string, created_at: string, document_id: string, field_context: string, confidence: double>"


def save_registry(registry: DataFrame, path: str) -> None:
    """As Parquet, in parts by namespace."""
    registry.write.mode("overwrite").partitionBy("namespace").parquet(path)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(path)


def registry_json(registry: DataFrame, created_at: str) -> DataFrame:
    """One row of JSON: version, created_at, token_count, and the records by hash. For registries that one file can hold."""
    record = F.struct("token", "namespace", "normalized_hash", F.lit(created_at).alias("created_at"), F.col("document_id").cast("string").alias("document_id"), "field_context", "confidence")
    tokens = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("normalized_hash").alias("k"), record.alias("v")))))
    all_ = registry.agg(F.lit("1.0").alias("version"), F.lit(created_at).alias("created_at"), F.count(F.lit(1)).alias("token_count"), tokens.alias("tokens"))
    return all_.select(F.to_json(F.struct("*")).alias("json"))


def read_registry_json(spark: SparkSession, path: str) -> DataFrame:
    """The records of JSON registries; what can't be read as one gives no row."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<tokens: map<string, {_RECORD}>>").alias("r"))
    records = whole.select(F.explode("r.tokens").alias("k", "v"))
    return records.select(F.col("k").alias("normalized_hash"), "v.token", "v.namespace", F.col("v.document_id").cast("bigint").alias("document_id"), "v.field_context", F.coalesce("v.confidence", F.lit(1.0)).alias("confidence"))


def save_reports(reports: DataFrame, folder: str) -> None:
    """One JSON line a document; nulls are left out."""
    reports.write.mode("overwrite").json(f"{folder}/logs/reports")


def save_summary(summary: DataFrame, folder: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/logs/batch_summary")
