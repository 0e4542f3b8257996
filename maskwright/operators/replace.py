"""Replacements of fields' values, and the registry of what was replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dummy, tokens
from . import canonical


def field_context(page: Column, kind: Column, method: Column) -> Column:
    return F.format_string("page:%s|type:%s|method:%s", page, kind, method)


def dictionary(known: DataFrame, key: str, similar: bool = True, by_family: bool = True, mode: str = "dummy") -> DataFrame:
    """key, leader, replacement: made once for each leader, from its first raw value and type."""
    if not similar:
        # Every key leads: what is known of it is in its own row.
        new = tokens.token(key, F.col("key"), tokens.namespace(F.col("field_type"))) if mode == "token" else dummy.replacement(key, F.col("raw"), F.col("field_type"), by_family)
        return known.select("key", F.col("key").alias("leader"), new.alias("replacement"))
    led = canonical.leaders(known, similar)
    first = led.filter("key = leader").select("leader").join(known.withColumnRenamed("key", "leader"), "leader")
    if mode == "token":
        new = tokens.token(key, F.col("leader"), tokens.namespace(F.col("field_type")))
    else:
        new = dummy.replacement(key, F.col("raw"), F.col("field_type"), by_family)
    return led.join(first.select("leader", new.alias("replacement")), "leader").select("key", "leader", "replacement")


def registry(known: DataFrame, words: DataFrame) -> DataFrame:
    """A record for each leader, by the hash of its key: where it was first seen, and its replacement. Raw values stay out."""
    led = words.filter("key = leader").select("key", "replacement").join(known, "key")
    return led.select(tokens.sha256(F.col("key")).alias("normalized_hash"), F.col("replacement").alias("token"), tokens.namespace(F.col("field_type")).alias("namespace"), F.col("ord.doc_id").alias("document_id"), field_context(F.col("ord.page"), F.col("field_type"), F.col("detection_method")).alias("field_context"), (-F.col("ord.rank")).alias("confidence"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records of old, and those of new whose hash old doesn't have."""
    return old.unionByName(new.join(old.select("normalized_hash"), "normalized_hash", "left_anti").select(*old.columns))


def statistics(records: DataFrame) -> DataFrame:
    return records.groupBy("namespace").agg(F.count(F.lit(1)).alias("n_tokens"))


def replace(fields: DataFrame, found: DataFrame, words: DataFrame) -> DataFrame:
    """fields with ``replacement``: '' where the value is blank."""
    own = found.select("doc_id", "page", "src_ord", "key").join(words.select("key", "replacement"), "key").drop("key")
    return fields.join(own, ["doc_id", "page", "src_ord"], "left").withColumn("replacement", F.coalesce("replacement", F.lit("")))
