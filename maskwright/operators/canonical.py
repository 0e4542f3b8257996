"""One replacement for all spellings of a value, across documents.

Values come in a total order (doc_id, page, review after automatic, falling confidence, src_ord). A value's key is its normalised form; keys
count from where they occur first. A key follows the earliest *leader* before it that it resembles, and leads where there is none. It
resembles an earlier key of a compatible type if one contains the other (4 characters or more), if half of all their words are common
(names), or if their digits are equal or contain each other (ids and phones; 8 digits or more); keys under 3 characters resemble none.

Distributed: pairs come from joins that miss none. Of two keys of which one contains the other, the longer has every 4-gram of the shorter,
so keys meet at the shorter's rarest; word sets of that likeness share one of the rarest words of each. Then rounds decide the keys
whose earlier neighbours are decided, all at once; they end since the earliest undecided key can always be decided.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.normalize import normalize
from ..functions.text import is_blank
from .lineage import checkpoint

GROUPS = {"name": ("person_name", "company_name"), "id": ("national_id", "passport", "tax_id"), "contact": ("email", "phone")}
NUMERIC = ("national_id", "phone", "tax_id")
ORDER = ("doc_id", "page", "is_review", "rank", "src_ord")


def _group(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind.isin(*ts), g) for g, ts in GROUPS.items()))


def values(fields: DataFrame, unicode: bool = True) -> DataFrame:
    """The fields' values that are replaced, with their key and place in the order."""
    raw = F.coalesce(F.nullif("original_text", F.lit("")), "text")
    out = fields.withColumn("raw", raw).filter(~is_blank(F.col("raw")))
    status = F.col("review_status") if "review_status" in fields.columns else F.lit("auto_mask")
    return out.select("doc_id", "page", (status != "auto_mask").alias("is_review"), (-F.coalesce("confidence", F.lit(0.0))).alias("rank"), "src_ord", "raw", "field_type", "detection_method", normalize(F.col("raw"), F.col("field_type"), unicode).alias("key"))


def keys(found: DataFrame) -> DataFrame:
    """key, ord, raw, field_type: each key where it occurs first."""
    first = F.min(F.struct(F.struct(*ORDER).alias("ord"), "raw", "field_type", "detection_method"))
    return found.groupBy("key").agg(first.alias("f")).select("key", "f.ord", "f.raw", "f.field_type", "f.detection_method")


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))))


def _contained(known: DataFrame, column: str, n: int) -> DataFrame:
    """(short, long) keys of which long's ``column`` contains short's."""
    grams = known.filter(F.length(column) >= n).select("key", F.col(column).alias("s"), F.explode(_grams(F.col(column), n)).alias("g"))
    often = grams.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    rarest = grams.join(often, "g").groupBy("key", "s").agg(F.min(F.struct("c", "g")).alias("m")).select(F.col("key").alias("short"), F.col("s").alias("short_s"), F.col("m.g").alias("g"))
    both = rarest.join(grams.select("g", F.col("key").alias("long"), F.col("s").alias("long_s")), "g")
    return both.filter((F.col("short") != F.col("long")) & F.contains("long_s", F.col("short_s"))).select("short", "long")


def _alike(known: DataFrame) -> DataFrame:
    """Keys of 4 characters or more of which half of all words are common."""
    bags = known.filter(F.length("key") >= 4).select("key", F.array_distinct(F.split("key", " ")).alias("ws"))
    each = bags.select("key", F.explode("ws").alias("w"), F.size("ws").alias("n"))
    often = each.groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    nth = F.row_number().over(W.partitionBy("key").orderBy("c", "w"))
    rare = each.join(often, "w").withColumn("nth", nth).filter(F.col("nth") <= F.col("n") - F.ceil(F.col("n") / 2) + 1).select("w", "key")
    met = rare.join(rare.select("w", F.col("key").alias("key2")), "w").filter("key < key2").select("key", "key2").distinct()
    met = met.join(bags, "key").join(bags.select(F.col("key").alias("key2"), F.col("ws").alias("ws2")), "key2")
    return met.filter(F.size(F.array_intersect("ws", "ws2")) * 2 >= F.size(F.array_union("ws", "ws2"))).select(F.col("key").alias("short"), F.col("key2").alias("long"))


def links(known: DataFrame) -> DataFrame:
    """(late, early, early_ord): keys and the earlier ones that they resemble."""
    known = known.withColumn("digits", F.regexp_replace("key", r"(?U)\D", ""))
    # Digits tell for numbers alone, so only these look for others of equal digits: a hot "5" of addresses meets no other address.
    equal = known.filter("digits <> ''").select("digits", F.col("key").alias("short"), "field_type")
    equal = equal.filter(F.col("field_type").isin(*NUMERIC)).select("digits", "short").join(equal.select("digits", F.col("short").alias("long"), F.col("field_type").alias("kind")), "digits")
    numbers = F.coalesce(_group(F.col("kind")), F.lit("id")).isin("id", "contact")
    equal = equal.filter(numbers & (F.col("short") != F.col("long"))).select(F.least("short", "long").alias("short"), F.greatest("short", "long").alias("long")).distinct()
    why = {"text": _contained(known, "key", 4), "words": _alike(known), "digits": equal, "within": _contained(known, "digits", 8)}
    pairs = reduce(DataFrame.unionByName, (p.withColumn("why", F.lit(k)) for k, p in why.items()))
    one = known.select(F.col("key").alias("short"), F.struct("ord", "key", "field_type").alias("x"))
    two = known.select(F.col("key").alias("long"), F.struct("ord", "key", "field_type").alias("y"))
    pairs = pairs.join(one, "short").join(two, "long").select("why", F.when(F.col("x.ord") < F.col("y.ord"), F.col("x")).otherwise(F.col("y")).alias("early"), F.when(F.col("x.ord") < F.col("y.ord"), F.col("y")).otherwise(F.col("x")).alias("late"))
    new = F.col("late.field_type")
    same = F.coalesce(_group(new) == _group(F.col("early.field_type")), F.lit(True))
    fits = (F.col("why") == "text") | ((F.col("why") == "words") & new.isin(*GROUPS["name"])) | (F.col("why").isin("digits", "within") & new.isin(*NUMERIC))
    enough = (F.length("late.key") >= 3) & (F.length("early.key") >= 3)
    return pairs.filter(same & fits & enough).select(F.col("late.key").alias("late"), F.col("early.key").alias("early"), F.col("early.ord").alias("early_ord")).distinct()


def leaders(known: DataFrame, similar: bool = True) -> DataFrame:
    """key, leader: every key with the key whose replacement it takes (itself, if it leads)."""
    if not similar:
        return known.select("key", F.col("key").alias("leader"))
    known = checkpoint(known)
    near = checkpoint(links(known))
    decided = None
    #: Keys that have a link, of which only these are looked at in rounds.
    open_ = checkpoint(near.select(F.col("late").alias("key")).distinct())
    while open_.limit(1).count():
        # What is known of each undecided key's earlier neighbours; those without links of their own lead.
        waits = near.join(open_.withColumnRenamed("key", "late"), "late", "left_semi")
        waits = waits.join(open_.select(F.col("key").alias("early"), F.lit(True).alias("unknown")), "early", "left")
        if decided is not None:
            waits = waits.join(decided.filter("leader <> key").select(F.col("key").alias("early"), F.lit(True).alias("follows")), "early", "left")
        else:
            waits = waits.withColumn("follows", F.lit(None).cast("boolean"))
        leads = F.col("unknown").isNull() & F.col("follows").isNull()
        seen = waits.groupBy("late").agg(F.min(F.when(leads, F.struct("early_ord", "early"))).alias("first"), F.min(F.when(F.col("unknown"), F.col("early_ord"))).alias("pending"))
        # The earliest leader is final once no undecided neighbour is before it.
        done = seen.filter("pending IS NULL OR first.early_ord < pending").select(F.col("late").alias("key"), F.coalesce("first.early", "late").alias("leader"))
        done = checkpoint(done)
        decided = done if decided is None else checkpoint(decided.unionByName(done))
        open_ = checkpoint(open_.join(done, "key", "left_anti"))
    if decided is None:
        return known.select("key", F.col("key").alias("leader"))
    return known.select("key").join(decided, "key", "left").select("key", F.coalesce("leader", "key").alias("leader"))


def leaders_in_order(known: list[tuple]) -> dict[str, str]:
    """The same for (key, field_type) in order, one after the other. For tests and small inputs."""
    found: list[tuple] = []
    out: dict[str, str] = {}
    group = {t: g for g, ts in GROUPS.items() for t in ts}
    for key, kind in known:
        out[key] = key
        digits = "".join(c for c in key if c.isdigit())
        for old, old_kind in found:
            a, b = group.get(kind), group.get(old_kind)
            if (a and b and a != b) or len(key) < 3 or len(old) < 3:
                continue
            theirs = "".join(c for c in old if c.isdigit())
            hit = False
            if len(key) >= 4 and len(old) >= 4:
                w, v = set(key.split()), set(old.split())
                hit = key in old or old in key or (a == "name" and len(w & v) * 2 >= len(w | v) > 0)
            if not hit and kind in NUMERIC and digits and theirs:
                hit = digits == theirs or (len(digits) >= 8 and len(theirs) >= 8 and (digits in theirs or theirs in digits))
            if hit:
                out[key] = old
                break
        else:
            found.append((key, kind))
    return out
