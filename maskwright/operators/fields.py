"""Fields after detection: duplicates, triage by confidence, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geometry import overlap
from ..functions.text import strip

SAME = 0.7


def deduplicate(fields: DataFrame, most: float = SAME) -> DataFrame:
    """Greedily by falling confidence (ties: as found) within a page and type.

    A field goes if one with the same block and text was kept, or if its box and a kept one overlap by more than ``most``. Only a page's
    fields of one type meet, so groups don't grow with the corpus; the order of rows plays no part. Fields meet by one shuffle, as they are:
    what they are ordered and compared by is added after it.
    """
    names, by = fields.columns, ("doc_id", "page", "field_type")
    key = F.lower(strip(F.coalesce("text", F.lit(""))))
    place = {"src_ord": "nth", "block_id": "block", "bbox": "box"}
    rest = [c for c in names if c not in by and c not in place]
    row = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("rank"), F.col("src_ord").alias("nth"), F.col("block_id").alias("block"), key.alias("key"), F.col("bbox").alias("box"), F.struct(*rest).alias("rest"))
    page = fields.repartition(*by).groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def step(kept: Column, x: Column) -> Column:
        again = F.exists(kept, lambda k: (k["block"].eqNullSafe(x["block"]) & (k["key"] == x["key"])) | (x["box"].isNotNull() & k["box"].isNotNull() & (overlap(x["box"], k["box"]) > most)))
        return F.when(again, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.when(F.size("rows") == 1, F.col("rows")).otherwise(F.aggregate("rows", F.slice("rows", 1, 0), step))
    return page.select(*by, F.explode(kept).alias("x")).select(*(c if c in by else F.col(f"x.{place[c]}").alias(c) if c in place else f"x.rest.{c}" for c in names))


def triage(fields: DataFrame, auto: float = 0.85, floor: float = 0.60) -> DataFrame:
    """With review_status: auto_mask or needs_review; fields below the floor go."""
    sure = F.coalesce("confidence", F.lit(0.0))
    return fields.filter(sure >= floor).withColumn("review_status", F.when(sure >= auto, "auto_mask").otherwise("needs_review"))


def review(triaged: DataFrame, decisions: DataFrame) -> DataFrame:
    """Fields that are masked: automatic ones, and those that a reviewer approved.

    decisions: doc_id, page, src_ord, answer. Answers are read in the document's order: Y approves, N rejects, A approves this one and all
    after it, S rejects this one and all after it. The first A or S rules what follows it; unanswered fields are rejected.
    """
    asked = triaged.filter("review_status = 'needs_review'").join(decisions.select("doc_id", "page", "src_ord", F.upper(F.col("answer")).alias("__answer")).dropDuplicates(["doc_id", "page", "src_ord"]), ["doc_id", "page", "src_ord"], "left")
    upto = W.partitionBy("doc_id").orderBy("page", "src_ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    rule = F.first(F.when(F.col("__answer").isin("A", "S"), F.col("__answer")), ignorenulls=True).over(upto)
    approved = asked.withColumn("__rule", rule).filter((F.col("__rule") == "A") | (F.col("__rule").isNull() & (F.col("__answer") == "Y")))
    return triaged.filter("review_status = 'auto_mask'").unionByName(approved.select(*triaged.columns))
