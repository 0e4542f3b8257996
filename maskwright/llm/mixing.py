"""Mixing sources to target weights by Pareto order sampling.

How: each source gets a whole number of copies, its share of ``percent`` per cent of all rows by integer weight (the given one, or
the whole part of the square root of its row count, which evens sources out). A row's share of its source's copies is
proportional to its size measure, 1 plus the bits of its character count, so longer texts come more often without crowding out
short ones. Whole copies are certain. For the rest of the share, p, rows are ranked by Pareto's u / (1 - u) * (1 - p) / p, where u is a uniform number from the
md5 of seed and doc_id, and the lowest ranks get one copy more; as many as make the source's copies exact.

The ranks' cut is found without sorting a source in one place: ranks are counted by leading bits, and only rows of
the bin in which the cut falls are numbered. A hot source is split like any other.

Cases: null and empty source are two sources like any other; null, missing or negative n_chars count as 0. Ranks tie only for rows of equal doc_id
(also null ones, which share one u): they're taken in order of doc_id, n_chars and a hash of all columns, and rows equal in all of these are interchangeable.
Repeated rows are rows of their own. Sources without a given weight, where weights are given, get no copy. An empty table gives an empty result.
Other columns, whatever their names, are passed through by ``mix`` and ignored by ``copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from . import exchange as E

PERCENT, SEED = 80, 17
#: Leading bits of the rank by which rows are counted.
BINS = 4096
#: 1 for rows whose bin is below their source's cut; rows without a rank, which have whole copies alone, have no bin.
_LESS = "CAST(coalesce(__bin < __cut, false) AS int)"


def _rows(docs: DataFrame) -> DataFrame:
    """docs with __doc, __source, __chars and __measure, which texts play no part in."""
    n_chars = F.greatest(F.coalesce(F.col("n_chars").cast("bigint"), F.lit(0)), F.lit(0)) if "n_chars" in docs.columns else F.lit(0).cast("bigint")
    rows = docs.withColumns({"__doc": F.col("doc_id").cast("bigint"), "__source": F.col("source"), "__chars": n_chars})
    return rows.withColumn("__measure", (1 + F.length(F.bin("__chars"))).cast("bigint"))


def _with_ranks(rows: DataFrame, totals: DataFrame, seed: int) -> DataFrame:
    """rows of sources in totals (__key, __n, __total and others), with __whole copies, what is left of the share, the rank __q and its __bin."""
    rows = rows.join(totals, F.col("__source").eqNullSafe(F.col("__key"))).drop("__key")
    rows = rows.withColumns({"__whole": F.expr("__n * __measure div __total"), "__left": F.expr("__n * __measure % __total")})
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__doc").cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    p = F.col("__left") / F.col("__total")
    rows = rows.withColumn("__q", F.when(F.col("__left") > 0, u / (1 - u) * ((1 - p) / p)))
    # A monotone bin of the rank: q / (1 + q) lies between 0 and 1.
    return rows.withColumn("__bin", F.floor(F.col("__q") / (1 + F.col("__q")) * BINS).cast("int"))


def _cuts(rows: DataFrame, weights: dict[str, int] | None, percent: int, seed: int) -> DataFrame:
    """One row a source: __key, __n, __total, __cut (rows of lesser bins get a copy more) and __room (how many of the bin itself do); materialised."""
    totals = rows.groupBy("__source").agg(F.count(F.lit(1)).alias("__rows"), F.sum("__measure").alias("__total"))
    if weights is None:
        weight = F.floor(F.sqrt("__rows"))
    else:
        given = [F.lit(x) for k, v in weights.items() for x in (k, int(v))]
        weight = F.coalesce(F.element_at(F.create_map(*given), F.col("__source")), F.lit(0)).cast("bigint") if given else F.lit(0).cast("bigint")
    totals = E.checkpoint(totals.withColumn("__weight", weight))
    every = totals.agg(F.sum("__rows"), F.sum("__weight")).first()
    share = F.expr(f"{(every[0] or 0) * int(percent) // 100}L * __weight div {every[1]}L") if every[1] else F.lit(0).cast("bigint")
    totals = E.lean(E.checkpoint(totals.select(F.col("__source").alias("__key"), share.alias("__n"), "__total")))
    bins = _with_ranks(rows.select("__doc", "__source", "__measure"), totals, seed).groupBy("__source", "__n", "__total", "__bin").agg(F.sum("__left").alias("__lefts"), F.count("__q").alias("__many"))
    by = W.partitionBy("__source")
    bins = bins.withColumn("__give", F.expr("sum(__lefts) over (partition by __source) div __total"))
    before = F.coalesce(F.sum("__many").over(by.orderBy(F.col("__bin").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = F.min(F.when(F.col("__bin").isNotNull() & (F.col("__room") < F.col("__many")), F.struct("__bin", "__room")))
    found = bins.withColumn("__room", F.col("__give") - before).groupBy("__source", "__n", "__total").agg(cut.alias("__at"))
    return E.checkpoint(found.select(F.col("__source").alias("__key"), "__n", "__total", F.coalesce("__at.__bin", F.lit(BINS + 1)).alias("__cut"), F.greatest(F.coalesce("__at.__room", F.lit(0)), F.lit(0)).alias("__room")))


def _numbered(rows: DataFrame, tie: list[str]) -> DataFrame:
    """Rows of the cuts' bins, with __more: whether they are among the first of their source's bin. Few rows, as a bin has one of BINS parts of a source."""
    number = F.row_number().over(W.partitionBy("__source").orderBy("__q", *tie))
    return rows.filter("__bin = __cut").withColumn("__more", (number <= F.col("__room")).cast("int"))


def copies(docs: DataFrame, weights: dict[str, int] | None = None, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, source, copies of every row that is chosen at least once."""
    rows = _rows(docs.select(*(c for c in ("doc_id", "source", "n_chars") if c in docs.columns)))
    ranked = _with_ranks(rows, E.lean(_cuts(rows, weights, percent, seed)), seed)
    chosen = ranked.filter("__bin IS NULL OR __bin <> __cut").withColumn("__more", F.expr(_LESS)).unionByName(_numbered(ranked, ["__doc", "__chars"]))
    chosen = chosen.withColumn("__copies", F.col("__whole") + F.col("__more")).filter("__copies > 0")
    return chosen.select(F.col("__doc").alias("doc_id"), F.col("__source").alias("source"), F.col("__copies").cast("bigint").alias("copies"))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """docs with each row as often as it is chosen. Each row's copies are told where it is read, from its source's cut and a table of
    the rows in the cuts' bins; texts don't move unless that table (one of BINS parts of all rows) is too large for a broadcast, and then those rows' alone.

    Rows of equal doc_id, source and n_chars get their copies by ``copies`` together: the first of them in order of a hash of all columns.
    """
    E.small_batches(docs.sparkSession)
    names = docs.columns
    rows = _rows(docs)
    cuts = E.lean(_cuts(rows.select("__doc", "__source", "__measure"), weights, percent, seed))
    ranked = _with_ranks(rows, cuts, seed)
    at = ranked.filter("__bin = __cut").withColumn("__hash", F.xxhash64(*[F.col(f"`{c}`") for c in names]))
    near = _numbered(at.select("__doc", "__source", "__chars", "__hash", "__q", "__bin", "__cut", "__room"), ["__doc", "__chars", "__hash"])
    # Rows that are equal throughout: all, none or some of them get a copy more.
    near = near.groupBy("__doc", "__source", "__chars", "__hash").agg(F.sum("__more").alias("__times"), F.count(F.lit(1)).alias("__same")).filter("__times > 0")
    near = E.checkpoint(near.toDF("__d", "__s", "__c", "__h", "__times", "__same"))
    key = lambda: F.col("__doc").eqNullSafe(F.col("__d")) & F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__chars") == F.col("__c")) & (F.col("__hash") == F.col("__h"))
    every = near.filter("__times = __same")
    some = near.filter("__times < __same")
    hashed = ranked.withColumn("__hash", F.when(F.col("__bin") == F.col("__cut"), F.xxhash64(*[F.col(f"`{c}`") for c in names])))
    more = F.when(F.col("__bin") == F.col("__cut"), F.col("__times").isNotNull().cast("int")).otherwise(F.expr(_LESS))
    if near.limit(E.MOST_ROWS + 1).count() <= E.MOST_ROWS:
        met = hashed.join(F.broadcast(every), key(), "left").withColumn("__each", F.col("__whole") + more)
    else:
        far = ranked.filter("__bin IS NULL OR __bin <> __cut").withColumn("__each", F.col("__whole") + F.expr(_LESS))
        met = far.select(*[F.col(f"`{c}`") for c in names], "__each").unionByName(at.join(every, key(), "left").withColumn("__each", F.col("__whole") + more).select(*[F.col(f"`{c}`") for c in names], "__each"))
    met = met.select(*[F.col(f"`{c}`") for c in names], "__each")
    if some.limit(1).count():
        # Of rows that are equal throughout it is all the same which get it: one of them, so often. A source has one such group at most.
        one = at.join(E.lean(some), key()).dropDuplicates(["__doc", "__source", "__chars", "__hash"])
        met = met.unionByName(one.select(*[F.col(f"`{c}`") for c in names], F.col("__times").alias("__each")))
    return met.filter("__each > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__each").cast("int")))).select(*[F.col(f"`{c}`") for c in names])
