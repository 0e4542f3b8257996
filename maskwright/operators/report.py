"""Statistics of fields, reports of documents, and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.geometry import masking_method
from .lineage import together

_LONG = ["doc_id", "dimension", "value", "n"]


def _count(fields: DataFrame, dimension: str, value) -> DataFrame:
    return fields.select("doc_id", value.alias("value")).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.lit(dimension).alias("dimension"), "value", "n")


def by_type(fields: DataFrame) -> DataFrame:
    return _count(fields, "type", F.coalesce("field_type", F.lit("unknown")))


def by_page(fields: DataFrame) -> DataFrame:
    return _count(fields, "page", F.coalesce("page", F.lit(0)).cast("string"))


def by_regulation(fields: DataFrame) -> DataFrame:
    """Fields without regulations count for none."""
    return _count(fields.select("doc_id", F.explode("regulations").alias("r")), "regulation", F.col("r"))


def by_risk(fields: DataFrame) -> DataFrame:
    return _count(fields, "risk_level", F.coalesce("risk_level", F.lit("UNKNOWN")))


def statistics(fields: DataFrame) -> DataFrame:
    """doc_id, dimension, value, n: all four countings and the total. Documents' fields meet by one shuffle of a narrow row each, and are spread over the countings after it."""
    pair = lambda name, v: F.struct(F.lit(name).alias("dimension"), v.alias("value"))
    fixed = F.array(pair("total", F.lit("all")), pair("type", F.coalesce("field_type", F.lit("unknown"))), pair("page", F.coalesce("page", F.lit(0)).cast("string")), pair("risk_level", F.coalesce("risk_level", F.lit("UNKNOWN"))))
    ruled = F.transform(F.coalesce("regulations", F.array().cast("array<string>")), lambda r: F.struct(F.lit("regulation").alias("dimension"), r.alias("value")))
    narrow = together(fields.select("doc_id", "field_type", "page", "risk_level", "regulations"), "doc_id")
    return narrow.select("doc_id", F.inline(F.concat(fixed, ruled))).groupBy("doc_id", "dimension", "value").agg(F.count(F.lit(1)).alias("n")).select(*_LONG)


def documents(masked_fields: DataFrame, pages: DataFrame, originals: bool = False) -> DataFrame:
    """A row a document of ``pages`` (doc_id, total_pages): counts and its fields, numbered from 1. Original values stay out unless asked for."""
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "src_ord"))
    row = masked_fields.withColumn("field_id", nth)
    shown = ["field_id", F.col("field_type").alias("type"), "page", "bbox", "confidence", "detection_method", masking_method(F.col("field_type"), F.col("detection_method")).alias("masking_method"), "risk_level", "regulations", F.nullif("replacement", F.lit("")).alias("dummy_text"), F.nullif("reasoning", F.lit("")).alias("reasoning")]
    if originals:
        shown.append(F.nullif("original_text", F.lit("")).alias("original_text"))
    listed = row.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_masked_fields"), F.array_sort(F.collect_list(F.struct(*shown))).alias("masked_fields"))
    counts = masked_fields.groupBy("doc_id", "field_type").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_type", "n")))).alias("by_type"))
    out = pages.join(listed, "doc_id", "left").join(counts, "doc_id", "left")
    return out.select("doc_id", F.lit("success").alias("status"), "total_pages", F.coalesce("total_masked_fields", F.lit(0)).alias("total_masked_fields"), "by_type", "masked_fields")


def failures(errors: DataFrame) -> DataFrame:
    """Error rows (document, error) as reports."""
    return errors.select(F.col("document").cast("string").alias("document"), F.lit("failed").alias("status"), F.coalesce("error", F.lit("unknown error")).alias("error"))


def dry_run(triaged: DataFrame) -> DataFrame:
    """What would be masked and what would be asked, by document."""
    return triaged.groupBy("doc_id").agg(F.lit("dry_run").alias("status"), F.count(F.lit(1)).alias("n_fields"), F.count_if(F.col("review_status") == "auto_mask").alias("n_auto"), F.count_if(F.col("review_status") == "needs_review").alias("n_review"))


def batch_summary(reports: DataFrame, failed: DataFrame) -> DataFrame:
    """One row over all documents' reports and the failures."""
    totals = reports.agg(F.count(F.lit(1)).alias("successful"), F.coalesce(F.sum("total_pages"), F.lit(0)).alias("total_pages"), F.coalesce(F.sum("total_masked_fields"), F.lit(0)).alias("total_masked_fields"))
    types = reports.select(F.explode("by_type").alias("t", "n")).groupBy("t").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("by_type"))
    bad = failed.agg(F.count(F.lit(1)).alias("failed"), F.array_sort(F.collect_list(F.struct("document", "error"))).alias("failed_documents"))
    mean = F.when(F.col("successful") > 0, F.col("total_masked_fields") / F.col("successful")).otherwise(0.0)
    return totals.crossJoin(bad).crossJoin(types).select((F.col("successful") + F.col("failed")).alias("total_documents"), "successful", "failed", "total_pages", "total_masked_fields", F.round(mean, 2).alias("fields_per_document"), "by_type", "failed_documents")


def console(reports: DataFrame, verification: DataFrame) -> str:
    """Lines for a terminal: documents, pages and fields, the commonest types, and how verification went. Sums are made by Spark."""
    n, pages, fields = reports.agg(F.count(F.lit(1)), F.coalesce(F.sum("total_pages"), F.lit(0)), F.coalesce(F.sum("total_masked_fields"), F.lit(0))).first()
    kinds = reports.select(F.explode("masked_fields").alias("f")).groupBy("f.type").count().orderBy(F.desc("count"), "type").limit(10).collect()
    status = verification.groupBy("status").count().orderBy("status").collect()
    lines = [f"Documents: {n}", f"Pages: {pages}", f"Masked fields: {fields}", *(f"  {r.type}: {r['count']}" for r in kinds)]
    return "\n".join([*lines, "Verification: " + (", ".join(f"{r.status} {r['count']}" for r in status) or "none")])
