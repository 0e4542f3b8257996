"""Producers of fields: patterns, company endings, responses of language models."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns as P

#: The columns of fields. src_ord numbers a page's fields as they were found: responses' texts, their visuals, patterns, companies.
SCHEMA = "doc_id bigint, page int, src_ord bigint, block_id string, field_type string, text string, original_text string, full_text string, label string, bbox array<int>, confidence double, regulations array<string>, risk_level string, detection_method string, reasoning string, description string, is_visual boolean"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = {c.split()[0]: c.split()[1] for c in SCHEMA.split(", ")}
TEXTS, VISUALS, PATTERNS, COMPANIES = (k << 40 for k in range(4))


def fields(df: DataFrame, **columns: Column | str) -> DataFrame:
    """df as fields: columns that aren't given are null."""
    given = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    return df.select(*(given.get(c, F.lit(None)).cast(_TYPES[c]).alias(c) for c in COLUMNS))


def by_patterns(blocks: DataFrame, names: Collection[str] | None = None) -> DataFrame:
    """The first match of each pattern (of all, or those named) in each block of 3 characters or more: one scan, whatever the number of patterns."""
    text, conf = F.col("text"), F.coalesce("confidence", F.lit(0.5))
    hits = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p.name).alias("field_type"), P.first_hit(text, p).alias("hit"), P.confidence(conf, p).alias("sure"), F.array(*map(F.lit, p.regulations)).alias("regulations"), F.lit(p.risk).alias("risk_level")) for k, p in enumerate(P.PATTERNS) if names is None or p.name in names))
    found = blocks.filter((F.length("text") >= 3) & text.rlike(r"(?U)[@\d]")).select("doc_id", "page", "block_ord", "block_id", "text", "bbox", F.filter(hits, lambda h: h["hit"] != "").alias("hits"))
    # An outer generator: of an inner one the optimizer would ask first whether it has rows, and run all patterns for that too.
    found = found.select("doc_id", "page", "block_ord", "block_id", F.col("text").alias("block"), "bbox", F.inline_outer("hits")).filter("hit IS NOT NULL")
    order = F.lit(PATTERNS) + F.col("block_ord") * len(P.PATTERNS) + F.col("k")
    return fields(found, doc_id="doc_id", page="page", src_ord=order, block_id="block_id", field_type="field_type", text="hit", original_text="hit", full_text="block", bbox="bbox", confidence="sure", regulations="regulations", risk_level="risk_level", detection_method=F.lit("pattern_match"))


def by_company_suffix(blocks: DataFrame) -> DataFrame:
    found = blocks.filter((F.length("text") >= 5) & P.has_company_suffix(F.col("text")))
    sure = F.least(F.coalesce("confidence", F.lit(0.5)) + F.lit(0.1), F.lit(0.85))
    return fields(found, doc_id="doc_id", page="page", src_ord=F.lit(COMPANIES) + F.col("block_ord"), block_id="block_id", field_type=F.lit("company_name"), text="text", original_text="text", bbox="bbox", confidence=sure, regulations=F.array(F.lit("GDPR"), F.lit("KVKK")), risk_level=F.lit("MEDIUM"), detection_method=F.lit("legal_suffix"))


def detect(blocks: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """All fields, before duplicates are taken out."""
    found = by_patterns(blocks).unionByName(by_company_suffix(blocks))
    if responses is None:
        return found
    from .responses import text_fields, visual_fields

    return text_fields(responses, blocks).unionByName(visual_fields(responses)).unionByName(found)
