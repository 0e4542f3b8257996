"""Blocks with their personal values replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import is_mark


def mask(blocks: DataFrame, fields: DataFrame, mode: str = "block") -> DataFrame:
    """The blocks, with ``is_masked``.

    Mode 'block' rewrites a whole block as label and replacement, of the last of its fields (automatic before reviewed, then as found). Mode 'value' puts
    the replacements in place of the values and keeps the rest. Signatures and the like are [COVERED] in both. Fields without a box change nothing.
    """
    if mode not in ("block", "value"):
        raise ValueError("mode must be block or value")
    status = F.col("review_status") if "review_status" in fields.columns else F.lit("auto_mask")
    place = F.struct((status != "auto_mask").alias("late"), (-F.coalesce("confidence", F.lit(0.0))).alias("rank"), "src_ord")
    value = F.coalesce(F.nullif("original_text", F.lit("")), "text")
    row = F.struct(place.alias("place"), is_mark(F.col("field_type"), F.col("detection_method")).alias("mark"), value.alias("value"), F.concat(F.coalesce("label", F.lit("")), F.col("replacement")).alias("whole"), "replacement")
    per = fields.filter("bbox IS NOT NULL").groupBy("doc_id", "page", "block_id").agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    out = blocks.join(per, ["doc_id", "page", "block_id"], "left")
    rows = F.col("__rows")
    if mode == "block":
        last = F.element_at(rows, -1)
        new = F.when(last["mark"], "[COVERED]").otherwise(last["whole"])
    else:
        # Longer values first, so that no value is broken by one that it contains.
        ordered = F.array_sort(rows, lambda a, b: F.when(F.length(a["value"]) > F.length(b["value"]), -1).when(F.length(a["value"]) < F.length(b["value"]), 1).otherwise(0))
        new = F.aggregate(ordered, F.col("text"), lambda t, r: F.when(r["mark"], "[COVERED]").otherwise(F.replace(t, r["value"], r["replacement"])))
    return out.withColumn("is_masked", rows.isNotNull()).withColumn("text", F.when(rows.isNotNull(), new).otherwise(F.col("text"))).select(*blocks.columns, "is_masked")
