"""Requests to, and answers of, a language model that looks at pages. Answers are a table (doc_id, page, raw)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import detect as D

_ANSWER = "struct<text_detections: array<struct<block_id: string, full_text: string, label: string, sensitive_value: string, category: string, confidence: double, risk_level: string, reasoning: string>>, visual_detections: array<struct<element_id: string, type: string, bbox: struct<x1: int, y1: int, x2: int, y2: int>, confidence: double, description: string>>>"


def answer(raw: Column) -> Column:
    """The JSON object within an answer's text, or null where there is none that can be read."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(raw, rf'(?s)\{{.*"{k}_detections".*\}}', 0), F.lit("")) for k in ("text", "visual")))
    return F.from_json(found, _ANSWER)


def text_fields(responses: DataFrame, blocks: DataFrame) -> DataFrame:
    """Found values with the box of their block; of blocks with equal ids the last counts, and one that isn't there gives no box."""
    found = responses.select("doc_id", "page", F.posexplode(answer(F.col("raw"))["text_detections"]).alias("k", "d")).select("doc_id", "page", "k", "d.*")
    boxes = blocks.groupBy("doc_id", "page", "block_id").agg(F.max_by("bbox", "block_ord").alias("bbox"))
    found = found.join(boxes, ["doc_id", "page", "block_id"], "left")
    value = F.coalesce("sensitive_value", F.lit(""))
    return D.fields(found, doc_id="doc_id", page="page", src_ord=F.lit(D.TEXTS) + F.col("k"), block_id="block_id", field_type=F.coalesce("category", F.lit("unknown")), text=value, original_text=value, full_text=F.coalesce("full_text", F.lit("")), label="label", bbox="bbox", confidence=F.coalesce("confidence", F.lit(0.5)), risk_level=F.coalesce("risk_level", F.lit("MEDIUM")), detection_method=F.lit("llm_unified"), reasoning=F.coalesce("reasoning", F.lit("")))


def visual_fields(responses: DataFrame) -> DataFrame:
    found = responses.select("doc_id", "page", F.posexplode(answer(F.col("raw"))["visual_detections"]).alias("k", "d")).select("doc_id", "page", "k", "d.*")
    kind = F.coalesce("type", F.lit("signature"))
    box = F.when(F.col("bbox").isNotNull(), F.array(*(F.coalesce(F.col(f"bbox.{c}"), F.lit(0)) for c in ("x1", "y1", "x2", "y2"))))
    return D.fields(found, doc_id="doc_id", page="page", src_ord=F.lit(D.VISUALS) + F.col("k"), block_id="element_id", field_type=kind, text=F.concat(F.lit("["), F.upper(kind), F.lit("]")), original_text=F.lit(""), bbox=box, confidence=F.coalesce("confidence", F.lit(0.8)), detection_method=F.lit("llm_unified_visual"), description=F.coalesce("description", F.lit("")), is_visual=F.lit(True))


def prompts(blocks: DataFrame, most: int = 100) -> DataFrame:
    """doc_id, page, n_blocks, payload: a page's first blocks as JSON, as many as one request holds."""
    nth = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("block_ord", "block_id"))
    few = blocks.withColumn("nth", nth).filter(F.col("nth") <= most)
    payload = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("nth", "block_id", "text"))), lambda b: F.struct(b["block_id"].alias("id"), b["text"].alias("text"))))
    return few.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_blocks"), payload.alias("payload"))


def languages(raw: Column) -> tuple[Column, Column]:
    """(languages, locale) of a language answer: English is always among them, and stands alone where the answer can't be read."""
    found = F.from_json(F.regexp_extract(raw, r"(?s)\{.*?\}", 0), "struct<languages: array<string>, locale: string>")
    known = found["languages"]
    english = F.array(F.lit("en"))
    listed = F.when(F.array_contains(known, "en"), known).otherwise(F.concat(english, known))
    return F.coalesce(listed, english), F.coalesce(found["locale"], F.lit("en_US"))
