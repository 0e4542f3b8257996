"""Document fingerprints by improbable features: digests of chained Bloom filters, compared by normalised bit overlap.

How: the entropy of every 64-byte window is found by updating counts as the window moves; a first pass over the corpus counts entropies, and a
window ranks by how rare its entropy is. Within each 64 windows in a row the leftmost of lowest rank gains a point, and windows of 16
points or more are a document's features. Five 11-bit parts of a feature's hash are set in a 2,048-bit filter; after 160 features the next filter of the
chain begins. Two filters score 0 if they have no more bits in common than chance and a margin explain, 100 if one has all bits of the other;
two digests score the mean, over the filters of the shorter, of the best score against the other's.

Search: the queries are all rows whose doc_id is divisible by 50, and they are searched for among all rows. Rows of equal digests are one class. Every feature
of every filter is in the index; of each filter the PROBES features of least hash (all, if it has fewer) ask for the filters that have them too and are no smaller, from a
query's filter to any row's and from any row's to a query's. Two filters score above 0 only if they share more than MARGIN of the smaller one's
features, so a pair is missed by all its probes with a chance of 0.7**16 at most. A key finds all filters with its feature, however many have it, and all pairs found are scored. A query's match
is the best score of all rows of other doc_ids (ties: the least doc_id), and n_matches counts the documents of other classes that score above 0, and the other documents of its own class.
Bits that agree by chance count for a score but share no feature: digests of a few features may score with full filters that they have
nothing in common with, and such pairs are not searched for. Of all pairs with a score of 60 or more, the share that is found is tested to be at least 0.9.

Cases: null and empty texts have no filter and no match. A text in which no window has 16 points (always if under 142 bytes) has one feature: its window of most points, or of lowest rank
if it has no whole group, or the whole text if it has no window with a rank. A very long text has a chain of filters. Rows without doc_id get a digest, aren't queries and match none.
Rows that repeat a doc_id are digested and matched each, and never match one another. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as E, textops as X, vocabulary as V

WINDOW, POINTS, PER_FILTER, BITS, PARTS = 64, 16, 160, 2048, 5
LEVELS = 1000
#: Windows of less entropy, of LEVELS, are never features: runs of few different bytes are in every document.
LEAST_LEVEL = 100
MARGIN = 0.3
#: Features of each filter that ask for others, and the divisor of the doc_ids that are queries.
PROBES, QUERY = 16, 50
#: Pairs that one tile may hold before it is split.
TILE_PAIRS = 200_000

_F = np.arange(WINDOW + 2) * np.log2(np.maximum(np.arange(WINDOW + 2), 1))
_GAIN = np.diff(_F)  # what one more of a byte adds to the sum of c log c


def levels(buf: np.ndarray) -> np.ndarray:
    """Entropy of each window, from each byte on, as a level from 0 to LEVELS - 1."""
    n = len(buf) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    order = np.argsort(buf, kind="stable")
    # Bytes by value, then place: places of the same byte less than WINDOW apart are neighbours in this order.
    kind = np.int32 if len(buf) < 1 << 22 else np.int64
    key = order.astype(kind) + (buf[order].astype(kind) << kind(22 if kind is np.int32 else 40))
    earlier, later = np.zeros(len(buf), np.uint8), np.zeros(len(buf), np.uint8)
    for d in range(1, min(WINDOW, len(buf))):
        near = key[d:] - key[:-d] < WINDOW
        if not near.any():
            break
        earlier[d:] += near
        later[:-d] += near
    before, after = np.empty_like(earlier), np.empty_like(later)
    before[order], after[order] = earlier, later
    # Windows of the first bytes have fewer before them, which is right: the sum starts at nothing.
    total = np.empty(len(buf))
    enter = _GAIN[before]
    total[:] = enter
    total[WINDOW:] -= _GAIN[after[: len(buf) - WINDOW]]
    np.cumsum(total, out=total)
    entropy = np.log2(WINDOW) - total[WINDOW - 1 :] / WINDOW
    return np.clip(entropy * (LEVELS / np.log2(WINDOW)) + 1e-6, 0, LEVELS - 1).astype(np.int32)


def _valid(off: np.ndarray, size: int) -> np.ndarray:
    """Whether a window from each byte on lies within one text."""
    good = np.zeros(max(0, size), bool)
    good[X.ranges(off[:-1], np.maximum(off[:-1], off[1:] - WINDOW + 1))] = True
    return good


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each level: the rarest has 0; equal counts by level; too low levels have no rank (LEVELS)."""
    order = np.lexsort((np.arange(LEVELS), counts))
    out = np.empty(LEVELS, np.int64)
    out[order] = np.arange(LEVELS)
    out[:LEAST_LEVEL] = LEVELS
    return out


def select(buf: np.ndarray, off: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the texts' features in order, and the texts they are in; texts without a window that has a rank have none."""
    level = levels(buf)
    n = len(level)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    none = np.int64(1) << 60
    key = np.where(_valid(off, n), (rank[level] << 40) + np.arange(n), none)
    size = 1
    low = key
    while size < WINDOW:
        low = np.minimum(low[:-size], low[size:]) if len(low) > size else low[:0]
        size *= 2
    # Groups of WINDOW windows in a row within one text: both ends are valid and of one text.
    texts = np.repeat(np.arange(len(off) - 1), np.diff(off))
    last = np.arange(len(low)) + WINDOW - 1
    whole = (key[: len(low)] < none) & (key[last] < none) & (texts[: len(low)] == texts[last])
    best = low[whole]
    best = best[(best >> 40) < LEVELS] & ((np.int64(1) << 40) - 1)
    points = np.bincount(best, minlength=n)
    found = np.flatnonzero(points >= POINTS)
    bare = np.ones(len(off) - 1, bool)
    bare[texts[found]] = False
    more = []
    for t in np.flatnonzero(bare & (np.diff(off) >= WINDOW)):
        a, b = int(off[t]), int(off[t + 1]) - WINDOW + 1
        at = a + int(points[a:b].argmax() if points[a:b].any() else key[a:b].argmin())
        if key[at] >> 40 < LEVELS:
            more.append(at)
    found = np.sort(np.concatenate([found, np.array(more, np.int64)]))
    return found, texts[found]


def digests(text: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, list[bytes], list[np.ndarray], list[list[int]]]:
    """Number of features, filters on end, and the filters' distinct features on end with their numbers, of each text."""
    buf, off = X.utf8(text)
    at, doc = select(buf, off, rank)
    h = X.grams(X.mix(buf.astype(np.uint64) + X.U64(1)), WINDOW)[at]
    edge = np.searchsorted(doc, np.arange(len(off)))
    count, filters, keys, sizes = np.zeros(len(off) - 1, np.int64), [], [], []
    for t, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        own = h[a:b]
        if not len(own) and off[t] < off[t + 1]:
            own = np.frombuffer(hashlib.blake2b(buf[off[t] : off[t + 1]].tobytes(), digest_size=8).digest(), np.uint64)
        count[t] = len(own)
        chain = (len(own) + PER_FILTER - 1) // PER_FILTER
        bits = np.zeros(chain * BITS, bool)
        nth = np.arange(len(own)) // PER_FILTER * BITS
        for p in range(PARTS):
            bits[nth + ((own >> X.U64(11 * p)) & X.U64(BITS - 1)).astype(np.int64)] = True
        filters.append(np.packbits(bits).tobytes())
        parts = [np.unique(own[x : x + PER_FILTER]) for x in range(0, len(own), PER_FILTER)]
        keys.append(np.concatenate(parts) if parts else own)
        sizes.append([len(x) for x in parts])
    return count, filters, keys, sizes


def compare(one: bytes, n_one: int, two: bytes, n_two: int) -> float:
    """Score of two digests with their numbers of features, 0 to 100."""
    if not one or not two:
        return 0.0
    if len(one) > len(two):
        one, n_one, two, n_two = two, n_two, one, n_one
    a, b = (np.frombuffer(x, np.uint64).reshape(-1, BITS // 64) for x in (one, two))
    size_a, size_b = (np.minimum(PER_FILTER, n - PER_FILTER * np.arange(len(x)))[:, None] * PARTS for n, x in ((n_one, a), (n_two, b)))
    size_b = size_b.T
    common = np.bitwise_count(a[:, None, :] & b[None, :, :]).sum(axis=2, dtype=np.int64)
    most = np.minimum(np.bitwise_count(a).sum(axis=1, dtype=np.int64)[:, None], np.bitwise_count(b).sum(axis=1, dtype=np.int64)[None, :])
    q = 1 - 1 / BITS
    chance = BITS * (1 - q**size_a - q**size_b + q ** (size_a + size_b))
    cut = chance + MARGIN * (most - chance)
    score = np.where(common > cut, 100 * (common - cut) / np.maximum(most - cut, 1e-9), 0.0)
    return float(np.minimum(score, 100).max(axis=1).mean())


def compare_all(one: list[bytes], n_one: np.ndarray, two: list[bytes], n_two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of pairs of digests, and of the same pairs the other way round, which differ for chains of equal length."""
    there = np.zeros(len(one))
    flat = np.flatnonzero([len(a) == len(b) == BITS // 8 for a, b in zip(one, two)])
    if len(flat):
        a, b = (np.frombuffer(b"".join(x[i] for i in flat.tolist()), np.uint64).reshape(len(flat), -1) for x in (one, two))
        common = np.bitwise_count(a & b).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64))
        q, size_a, size_b = 1 - 1 / BITS, n_one[flat] * PARTS, n_two[flat] * PARTS
        chance = BITS * (1 - q**size_a - q**size_b + q ** (size_a + size_b))
        cut = chance + MARGIN * (most - chance)
        there[flat] = np.minimum(np.where(common > cut, 100 * (common - cut) / np.maximum(most - cut, 1e-9), 0.0), 100)
    back = there.copy()
    rest = np.ones(len(one), bool)
    rest[flat] = False
    for i in np.flatnonzero(rest).tolist():
        there[i] = back[i] = compare(one[i], int(n_one[i]), two[i], int(n_two[i]))
        if len(one[i]) == len(two[i]):
            back[i] = compare(two[i], int(n_two[i]), one[i], int(n_one[i]))
    return there, back


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks of the levels by how often all windows of all texts have them."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((LEVELS, 1))
        for b in batches:
            for s in X.pieces(b):
                buf, off = X.utf8(s.column("text"))
                level = levels(buf)
                out[:, 0] += np.bincount(level[_valid(off, len(level))], minlength=LEVELS)
        return out

    return ranks_of(V.sum_arrays(docs.select("text"), count, LEVELS, 1)[:, 0])


def _made(docs: DataFrame, scratch: E.Scratch) -> DataFrame:
    """doc_id, n_features, digest, class (null without a feature), and keys and sizes: each filter's distinct features; in a table."""
    E.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs))

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.pieces(b):
                n, filters, keys, sizes = digests(s.column("text"), shared.value)
                bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(bounds), pa.array(X.signed(np.concatenate(keys))))
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(filters, pa.binary()), flat, pa.array(sizes, pa.list_(pa.int32()))], ["doc_id", "n_features", "digest", "keys", "sizes"])
        X.tidy()

    made = docs.mapInArrow(source, "doc_id bigint, n_features int, digest binary, keys array<bigint>, sizes array<int>")
    return scratch.write(made.withColumn("class", F.when(F.col("n_features") > 0, F.xxhash64("digest", "n_features"))))


def _met(known: DataFrame) -> DataFrame:
    """one (a query's class), two: different classes of which a filter's probe found a filter of the other. known: class, keys, sizes, asks."""
    packer = E.Packer(E.width(known.sparkSession), {"feature": np.uint64, "size": np.uint8, "probe": np.uint8}, {"class": np.int64, "asks": np.uint8})

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bool] = {}
        for b in batches:
            # Copies are taken together before they are exchanged: a partition sends a class once, and again if a later row of it is the first that asks.
            new = []
            for name, asks in zip(b.column("class").to_pylist(), b.column("asks").to_pylist()):
                new.append(name not in seen or (asks and not seen[name]))
                seen[name] = asks or seen.get(name, False)
            b = pa.Table.from_batches([b.filter(pa.array(new, pa.bool_()))]).combine_chunks().to_batches()
            if not b:
                continue
            b = b[0]
            keys, sizes = b.column("keys"), b.column("sizes")
            feature = keys.flatten().to_numpy().view(np.uint64)
            size = sizes.flatten().to_numpy().astype(np.int64)
            chain = np.diff(sizes.offsets.to_numpy())
            text = np.repeat(np.repeat(np.arange(len(b)), chain), size)
            # A filter's features are ascending in hash: its first ones are the probes.
            turn = np.arange(len(feature)) - np.repeat(np.cumsum(size) - size, size)
            yield from packer.add(E.bucket_of(feature, packer.buckets), text, {"feature": feature, "size": np.repeat(size, size), "probe": turn < PROBES}, {"class": b.column("class").to_numpy(), "asks": b.column("asks").to_numpy(zero_copy_only=False)}, len(b))
        yield packer.flush()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = packer.read(batches)
        order = np.lexsort((got["probe"], got["class"], got["size"], got["feature"]))
        feature, size, name, probe, asks = (got[k][order] for k in ("feature", "size", "class", "probe", "asks"))
        first = X.runs(feature, size, name, probe)[:-1]
        asks = np.maximum.reduceat(asks, first) > 0 if len(first) else asks > 0
        feature, size, name, probe = feature[first], size[first], name[first], probe[first] > 0
        del got
        edge = X.runs(feature)
        held: list = []
        waiting = 0

        def pack() -> pa.RecordBatch:
            one, two = (np.concatenate(x) for x in zip(*held))
            o = np.lexsort((two, one))
            one, two = one[o], two[o]
            first = X.runs(one, two)[:-1]
            return pa.RecordBatch.from_arrays([pa.array(one[first]), pa.array(two[first])], ["one", "two"])

        listed = np.diff(edge) > 1
        listed &= np.add.reduceat(asks.astype(np.int64), edge[:-1]) > 0 if len(listed) else listed
        for k in np.flatnonzero(listed).tolist():
            a, b = int(edge[k]), int(edge[k + 1])
            own = size[a:b].astype(np.int64)
            for i in np.flatnonzero(asks[a:b]).tolist():
                # Filters that are no smaller, where this is a probe, and the probes of those that are no larger.
                near = (probe[a + i] & (own >= own[i])) | (probe[a:b] & (own <= own[i]))
                near &= name[a:b] != name[a + i]
                two = name[a:b][near]
                held.append((np.full(len(two), name[a + i]), two))
                waiting += len(two)
            if waiting > 500_000:
                yield pack()
                held, waiting = [], 0
        if held:
            yield pack()
        X.tidy()

    return E.regroup(known.select("class", "keys", "sizes", "asks"), source, packer, reduce, "one bigint, two bigint").distinct()


def _class_scores(made: DataFrame) -> DataFrame:
    """one, two, score (of one against two): every class of a query with other classes that the index gives and a score above 0; materialised."""
    known = made.filter("doc_id IS NOT NULL AND class IS NOT NULL").withColumn("asks", F.expr(f"doc_id % {QUERY} = 0"))
    pairs = E.checkpoint(_met(known))
    heads = known.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    # Queries of a group share a tile, that of the least class that they met, so each digest goes there once; a large tile is cut by the other class.
    least = E.checkpoint(pairs.groupBy("one").agg(F.min("two").alias("tile")))
    tiled = pairs.join(E.lean(least), "one")
    parts = E.checkpoint(tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE_PAIRS)).alias("parts")))
    tiled = E.checkpoint(tiled.join(E.lean(parts), "tile").select("tile", F.pmod(F.xxhash64("two"), F.col("parts")).cast("int").alias("part"), "one", "two"))
    asked = tiled.select("tile", "part", F.explode(F.array("one", "two")).alias("class")).distinct().join(heads, "class")
    rows = known.select("class", "doc_id", "digest", "n_features").join(E.lean(E.checkpoint(asked)), ["class", "doc_id"])
    rows = rows.select("tile", "part", F.col("class").alias("one"), F.lit(None).cast("bigint").alias("two"), "digest", "n_features")
    rows = rows.union(tiled.select("tile", "part", "one", "two", F.lit(None).cast("binary"), F.lit(None).cast("int")))
    rows = rows.repartition(E.width(made.sparkSession), "tile", "part").sortWithinPartitions("tile", "part", F.col("two").asc_nulls_first())

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, {}
        for b in batches:
            key = np.stack([b.column(k).to_numpy().astype(np.int64) for k in ("tile", "part")])
            edge = X.runs(*key)
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if tuple(key[:, x].tolist()) != now:
                    now, have = tuple(key[:, x].tolist()), {}
                own = b.slice(x, y - x)
                is_pair = own.column("two").is_valid()
                given, asked_for = own.filter(pa.array(~np.asarray(is_pair))), own.filter(is_pair)
                have.update(zip(given.column("one").to_pylist(), zip(given.column("digest").to_pylist(), given.column("n_features").to_pylist())))
                one, two = asked_for.column("one"), asked_for.column("two")
                for z in range(0, len(one), 5000):
                    left, right = one.slice(z, 5000), two.slice(z, 5000)
                    (mine, n), (theirs, m) = (zip(*(have[k] for k in side.to_pylist())) for side in (left, right))
                    there, _ = compare_all(mine, np.array(n), theirs, np.array(m))
                    yield pa.RecordBatch.from_arrays([left, right, pa.array(there)], ["one", "two", "score"])
        X.tidy()

    return E.checkpoint(rows.mapInArrow(scores, "one bigint, two bigint, score double").filter("score > 0"))


def _members(made: DataFrame) -> DataFrame:
    return made.filter("doc_id IS NOT NULL AND class IS NOT NULL").select("class", "doc_id").distinct()


def pairs(docs: DataFrame) -> DataFrame:
    """doc_id, to, score: every query (doc_id divisible by QUERY) with every other document that scores above 0; the best score of their rows."""
    scratch = E.Scratch(docs.sparkSession)
    made = _made(docs, scratch)
    members, scores = E.checkpoint(_members(made)), _class_scores(made)
    scratch.drop()
    same = members.select("class").distinct().select(F.col("class").alias("one"), F.col("class").alias("two"), F.lit(100.0).alias("score"))
    found = scores.union(same).join(members.filter(f"doc_id % {QUERY} = 0").toDF("one", "doc_id"), "one").join(members.toDF("two", "to"), "two").filter("doc_id <> to")
    return found.groupBy("doc_id", "to").agg(F.max("score").alias("score"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_features, n_filters, digest of each row; of queries (doc_id divisible by QUERY) match_id, match_score and n_matches too, null for other rows.

    A query without a match above 0 has null match_id and match_score and n_matches 0.
    """
    made = _made(docs, E.Scratch(docs.sparkSession))
    members, scores = E.checkpoint(_members(made)), _class_scores(made)
    asking = members.filter(f"doc_id % {QUERY} = 0").select("class").distinct()
    # A row needs its class' two best documents at most, as but one of them can be its own. They are told by partial aggregation, as are the two least
    # documents of a class: rows of a hot class don't meet before they are few.
    needed = E.lean(E.checkpoint(scores.select(F.col("two").alias("class")).union(asking).distinct()))
    own = members.join(needed, "class", "left_semi")
    of_class = own.groupBy("class").agg(F.min("doc_id").alias("d"), F.count(F.lit(1)).alias("copies"))
    second = own.join(E.lean(E.checkpoint(of_class)), "class").groupBy("class", "d", "copies").agg(F.min(F.when(F.col("doc_id") > F.col("d"), F.col("doc_id"))).alias("d2"))
    two = E.checkpoint(second.select("class", "copies", F.array_compact(F.array("d", "d2")).alias("least")))
    across = scores.join(E.lean(two.toDF("two", "copies", "least")), "two").select(F.col("one").alias("class"), "score", "copies", "least")
    number = across.groupBy("class").agg(F.sum("copies").alias("others"))
    mine = E.checkpoint(two.join(E.lean(E.checkpoint(asking)), "class", "left_semi"))
    same = mine.filter(F.size("least") > 1).select("class", F.lit(100.0).alias("score"), F.explode("least").alias("to"))
    best = E.checkpoint(across.select("class", "score", F.explode("least").alias("to")).union(same).groupBy("class", "to").agg(F.max("score").alias("score")))
    rank = F.struct((-F.col("score")).alias("s"), "to")
    first = best.groupBy("class").agg(F.min(rank).alias("a"))
    best = best.join(first, "class").groupBy("class", "a").agg(F.min(F.when(F.col("to") != F.col("a.to"), rank)).alias("b"))
    best = mine.select("class", "copies").join(best, "class", "left").join(number, "class", "left")
    best = E.checkpoint(best.select("class", "a", "b", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n")))
    # Only queries meet their matches: the digests of other rows stay where they are.
    queries = made.filter(f"doc_id % {QUERY} = 0").join(E.lean(best), "class", "left")
    m = F.when(F.col("a.to") != F.col("doc_id"), F.col("a")).otherwise(F.col("b"))
    shown = [F.col("doc_id"), F.col("n_features"), (F.length("digest") * 8 / BITS).cast("int").alias("n_filters"), F.col("digest")]
    queries = queries.withColumn("m", m).select(*shown, F.col("m.to").alias("match_id"), (-F.col("m.s")).alias("match_score"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_matches"))
    rest = made.filter(f"doc_id IS NULL OR doc_id % {QUERY} <> 0").select(*shown, F.lit(None).cast("bigint").alias("match_id"), F.lit(None).cast("double").alias("match_score"), F.lit(None).cast("bigint").alias("n_matches"))
    return queries.unionByName(rest)
