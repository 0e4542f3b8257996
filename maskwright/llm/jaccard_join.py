"""N-gram Jaccard join: links between documents whose sets of word trigrams have a Jaccard index of at least 0.6.

How: documents with the same set are one class; a set's grams are put in one global order, those of many documents
last, the rest by hash. Of two sets that reach the threshold, the first (1 - t) n + l grams share at least l; so
records of these grams meet in buckets, where size bands give each gram's compatible partners. Classes whose first hot
gram, or second to fourth, is that of many others go to a tile as a list, without their pairs; other pairs go on if they meet often enough, or at once where a
shared gram is among the first hot ones of both. Lists that overlap are one tile, and a large tile is cut into blocks that meet two by two. The sorted hash arrays
of a tile's classes are gathered once: there, size bands and 1,024-bit parity signatures bound each overlap from above, and what is left is
settled by exact intersection. A tile returns each class' number of links and a forest of its links, so no step's rows grow with the square of a group.

``near_duplicates`` gives each document that has a link its group (the least doc_id that links lead to), and its number of links: other texts at or
above the threshold, where a text is a doc_id with a set. ``near_pairs`` lists the pairs, which grow with the square of a group.

Cases: null texts and texts without words have no grams and no partner. Texts of one or two words have one gram, of
all their words. Rows without doc_id are left out. Rows that repeat a doc_id are one document; if their texts
differ, each text has its links, a document's number is their sum, and near_pairs reports a pair with the highest index that any of them reaches. Ties can't arise.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import exchange as E, textops as X

N, NUM, DEN = 3, 6, 10
#: So many of the most frequent grams come last in the order. Any order is right: the number bounds what is broadcast (8 bytes each).
MOST_HOT = 1_000_000
BITS = 1024
#: Grams of a tile's block, and pairs that a tile of pairs may hold before it is split.
TILE_GRAMS, TILE_PAIRS = 1_500_000, 200_000
EXTRA = 20
#: Records carry the first of the hot grams in their document's prefix, which as a rule only copied texts have. Pairs that share one meet only at the least of these.
FIRSTS = 4
#: Grams meet by so many bits of their hashes. Grams of different texts that agree in these make candidates more; two of one text (about 1 of 10**9 texts of 700 words) count once.
MEET = 48
#: Classes with a first gram in common from which on they go to a tile as a list, not by pairs.
MANY = 16
SURE = 1 << 20
#: Pairs that a worker holds before it sorts and passes them on, and rows of the batches it passes.
HELD, ROWS = 800_000, 100_000


def prefix_size(n: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """Grams of a set's prefix, and how many of them a partner must share at least."""
    least = 1 + n // EXTRA
    return np.minimum(n, n - (n * num + den - 1) // den + least), least


def class_of(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    total = np.zeros(len(g) + 1, X.U64)
    np.cumsum(X.mix(g + X.U64(0x1F83D9ABFB41BD6B)), out=total[1:])
    return X.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(X.U64))


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_id, sets and bounds of a batch's documents, a slice at a time."""
    for s in X.pieces(batch):
        g, bounds = X.gram_sets(X.plain_words(s.column("text")), n)
        yield s.column("doc_id").to_numpy(), g, bounds


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """In one pass: class, size and doc_id of every document that has grams, and (g, c) of grams that occur in 3 documents of some worker's block."""

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["class", "size", "doc_id", "g", "c"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        held: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            g = np.sort(np.concatenate(held)) if held else np.zeros(0, X.U64)
            edge = X.runs(g)
            found = np.flatnonzero(np.diff(edge) >= 3)
            none = [pa.nulls(len(found), k) for k in kinds[:3]]
            return pa.RecordBatch.from_arrays([*none, pa.array(X.signed(g[edge[:-1]][found])), pa.array(np.diff(edge)[found])], names)

        for b in batches:
            for ids, g, bounds in _sets(b, n):
                at = np.flatnonzero(np.diff(bounds) > 0)
                none = [pa.nulls(len(at), k) for k in kinds[3:]]
                yield pa.RecordBatch.from_arrays([pa.array(X.signed(class_of(g, bounds))[at]), pa.array(np.diff(bounds)[at].astype(np.int32)), pa.array(ids[at]), *none], names)
                held.append(g)
                size += len(g)
                if size > 3_000_000:
                    yield flush()
                    held, size = [], 0
        yield flush()
        X.tidy()

    return docs.mapInArrow(source, "class bigint, size int, doc_id bigint, g bigint, c bigint")


def _hot(counted: DataFrame, most: int = MOST_HOT) -> np.ndarray:
    """Up to ``most`` grams that most documents have, of the survey's. Ascending."""
    found = E.checkpoint(counted.groupBy("g").agg(F.sum("c").alias("c")))
    # The least count of which no more than ``most`` grams are at or above it; counts beyond 10,000 are one class.
    classes = found.groupBy(F.least("c", F.lit(10_000)).alias("c")).count().toArrow().sort_by([("c", "descending")])
    upto = np.cumsum(classes.column("count").to_numpy())
    good = int(np.searchsorted(upto, most, side="right"))
    if not good:
        return np.zeros(0, X.U64)
    rows = found.filter(F.col("c") >= int(classes.column("c")[good - 1].as_py())).select("g").toArrow().column(0).to_numpy()
    return np.sort(np.ascontiguousarray(rows).view(X.U64))


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower 32 and the next 16 bits."""
    return (x & X.U64(0xFFFFFFFF)).astype(np.uint32), ((x >> X.U64(32)) & X.U64(0xFFFF)).astype(np.uint16)


def _whole(got: dict[str, np.ndarray], name: str) -> np.ndarray:
    return got[f"{name}_low"].astype(np.uint64) | (got[f"{name}_high"].astype(np.uint64) << X.U64(32))


def prefixes(g: np.ndarray, bounds: np.ndarray, hot: np.ndarray, num: int, den: int, mask: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records of sets: where in g they are and of which set, and each set's first grams (FIRSTS rows, 0 for none)."""
    size = np.diff(bounds)
    take, _ = prefix_size(size, num, den)
    doc = np.repeat(np.arange(len(size)), size)
    late = E.has(hot, g)
    # The order within a set: other grams by hash, then the hot ones by hash.
    early = np.cumsum(~late) - (~late)
    early = early - early[np.minimum(bounds[:-1], max(len(g) - 1, 0))][doc] if len(g) else early
    within = np.arange(len(g)) - bounds[:-1][doc]
    cool = np.bincount(doc[~late], minlength=len(size))
    place = np.where(late, cool[doc] + within - early, early)
    at = np.flatnonzero(place < take[doc])
    nth = within - early
    firsts = np.zeros((FIRSTS, len(size)), np.uint64)
    for k in range(FIRSTS):
        pick = at[late[at] & (nth[at] == k)]
        firsts[k, doc[pick]] = g[pick] & mask
    return at, doc[at], firsts


def least_common(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Least first gram that columns of one and two (FIRSTS, pairs) share, all ones where there is none."""
    none = ~X.U64(0)
    least = np.full(np.broadcast_shapes(one.shape[1:], two.shape[1:]), none)
    for x in one:
        for y in two:
            least = np.where((x == y) & (x > 0), np.minimum(least, x), least)
    return least


def meet(g: np.ndarray, c: np.ndarray, size: np.ndarray, firsts: np.ndarray, num: int, den: int, many: int) -> Iterator[tuple]:
    """Batches of (tile, class, None, ...) of lists and (a, b, size_a, size_b, times) of pairs, of a bucket's records."""
    order = np.argsort(g)
    edge = X.runs(g[order])
    at = order[np.repeat(np.diff(edge) > 1, np.diff(edge))]
    g, c, size, firsts = g[at], c[at], size[at], firsts[:, at]
    at = np.lexsort((c, size, g))
    at = at[X.runs(g[at], c[at])[:-1]]
    g, c, size, firsts = g[at], c[at], size[at], firsts[:, at]
    edge = X.runs(g)
    length = np.diff(edge)
    key = (np.repeat(np.arange(len(length)), length) << 34) + size
    reach = np.searchsorted(key, (key >> 34 << 34) + size * den // num, side="right")
    own = (firsts == g).any(axis=0)
    listed = np.add.reduceat(own.astype(np.int64), edge[:-1]) > many if len(length) else np.zeros(0, bool)
    for k in np.flatnonzero(listed).tolist():
        # All pairs of classes with this gram among their firsts meet in its tile.
        members = np.sort(c[edge[k] : edge[k + 1]][own[edge[k] : edge[k + 1]]])
        yield "list", (np.full(len(members), members[0]), members)
    # Long lists by groups of equal firsts: only groups that have none in common (or this one, where there is no tile) have pairs here.
    copied = np.add.reduceat((firsts > 0).any(axis=0).astype(np.int64), edge[:-1]) if len(length) else length
    long = (length > 4 * many) & (copied * 2 > length)
    for k in np.flatnonzero(long).tolist():
        a = int(edge[k])
        equal = np.zeros(int(length[k]), np.uint64)
        for x in firsts[:, a : edge[k + 1]]:
            equal = X.mix(equal + x)
        _, first, group = np.unique(equal, return_index=True, return_inverse=True)
        by = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[by], np.arange(len(first) + 1))
        kinds = firsts[:, a + first]
        for x in range(len(first)):
            least = least_common(kinds[:, x : x + 1], kinds[:, x:])
            open_ = (least == ~X.U64(0)) | ((least == g[a]) & (not listed[k]))
            y = x + np.flatnonzero(open_)
            if not len(y):
                continue
            left = a + by[bounds[x] : bounds[x + 1]]
            right = a + by[X.ranges(bounds[y], bounds[y + 1])]
            sure = np.repeat(least[y - x] != ~X.U64(0), np.diff(bounds)[y])
            same = np.repeat(y == x, np.diff(bounds)[y])
            for own_left in left.tolist():
                low, high = np.minimum(own_left, right), np.maximum(own_left, right)
                fit = np.flatnonzero((low < high) & (high < reach[low]) & ~(same & (right < own_left)))
                if len(fit):
                    yield "pairs", (c[low[fit]], c[high[fit]], size[low[fit]], size[high[fit]], np.where(sure[fit], SURE, 1))
    count = np.where(np.repeat(long, length), 0, reach - np.arange(len(g)) - 1)
    todo = np.flatnonzero(count > 0)
    ends = np.cumsum(count[todo])
    tiled = np.repeat(listed, length) & own
    done = 0
    while done < len(todo):
        base = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, base + HELD // 4)))
        these = todo[done:upto]
        left = np.repeat(these, count[these])
        right = X.ranges(these + 1, reach[these])
        least = least_common(firsts[:, left], firsts[:, right])
        here = np.flatnonzero(((least == ~X.U64(0)) | (least == g[left])) & ~(tiled[left] & tiled[right]))
        left, right = left[here], right[here]
        yield "pairs", (c[left], c[right], size[left], size[right], np.where(least[here] == ~X.U64(0), 1, SURE))
        done = upto


def _candidates(docs: DataFrame, n: int, num: int, den: int, hot: np.ndarray, many: int, bits: int) -> DataFrame:
    """Rows of two kinds: tile, class of lists, and a < b, size_a, size_b, shared of pairs of classes; not added up yet."""
    spark = docs.sparkSession
    halves = {"low": np.uint32, "high": np.uint16}
    packer = E.Packer(E.width(spark), {f"g_{k}": t for k, t in halves.items()}, {"c": np.int64, "size": np.uint32, **{f"f{i}_{k}": t for i in range(FIRSTS) for k, t in halves.items()}})
    shared = spark.sparkContext.broadcast(hot)
    mask = X.U64((1 << bits) - 1)

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            for ids, g, bounds in _sets(b, n):
                own = X.signed(class_of(g, bounds))
                # Copies are taken together before they are exchanged: one of each class in a partition.
                fresh = np.zeros(len(own), bool)
                fresh[np.unique(own, return_index=True)[1]] = True
                fresh &= np.fromiter((x not in seen for x in own.tolist()), bool, len(own))
                seen.update(own[fresh].tolist())
                at, doc, firsts = prefixes(g, bounds, shared.value, num, den, mask)
                keep = fresh[doc]
                at, doc = at[keep], doc[keep]
                met = g[at] & mask
                columns = dict(zip(("g_low", "g_high"), _halves(met)))
                keys = {"c": own, "size": np.diff(bounds)}
                for i in range(FIRSTS):
                    keys[f"f{i}_low"], keys[f"f{i}_high"] = _halves(firsts[i])
                yield from packer.add(E.bucket_of(met, packer.buckets), doc, columns, keys, len(own))
        yield packer.flush()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tile", "class", "a", "b", "size_a", "size_b", "shared"]
        got = packer.read(batches)
        g, c, size = _whole(got, "g"), got["c"], got["size"].astype(np.int64)
        firsts = np.stack([_whole(got, f"f{i}") for i in range(FIRSTS)])
        del got
        lists: set = set()
        held: list = []
        waiting = 0

        def pack() -> Iterator[pa.RecordBatch]:
            one, two, size_one, size_two, times = (np.concatenate([x[k] for x in held]) for k in range(5))
            turn = one > two
            a, b = np.where(turn, two, one), np.where(turn, one, two)
            left, right = np.where(turn, size_two, size_one), np.where(turn, size_one, size_two)
            o = np.lexsort((b, a))
            a, b, left, right, times = a[o], b[o], left[o].astype(np.int32), right[o].astype(np.int32), times[o]
            e = X.runs(a, b)[:-1]
            times = np.minimum(np.add.reduceat(times, e), SURE).astype(np.int32) if len(e) else times.astype(np.int32)
            a, b, left, right = a[e], b[e], left[e], right[e]
            for k in range(0, len(a), ROWS):
                rows = [pa.array(x[k : k + ROWS]) for x in (a, b, left, right, times)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows[0]), pa.int64()) for _ in range(2)), *rows], names)

        def pack_lists() -> pa.RecordBatch:
            rows = np.array(sorted(lists), np.int64).reshape(-1, 2)
            none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), *none], names)

        for kind, rows in meet(g, c, size, firsts, num, den, many):
            if kind == "list":
                lists.update(zip(*(x.tolist() for x in rows)))
                if len(lists) > HELD // 4:
                    yield pack_lists()
                    lists.clear()
                continue
            held.append(rows)
            waiting += len(rows[0])
            if waiting > HELD:
                yield from pack()
                held, waiting = [], 0
        if held:
            yield from pack()
        if lists:
            yield pack_lists()
        X.tidy()

    return E.regroup(docs, source, packer, reduce, "tile bigint, class bigint, a bigint, b bigint, size_a int, size_b int, shared int")


def signature(g: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set: bit i is whether an odd number of its hashes fall on i."""
    bit = (X.mix(g ^ X.U64(0x94D049BB133111EB)) % X.U64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=BITS) & 1).astype(np.uint8)).view(np.uint64)


class Tile:
    """Classes (ascending) with their sets, the tiles that hold them, and how many documents they stand for."""

    def __init__(self, names: np.ndarray, sets: list[np.ndarray], docs: np.ndarray, tiles: list[list[int]], blocks: np.ndarray, num: int, den: int):
        self.names, self.docs, self.tiles, self.blocks, self.num, self.den = names, docs, tiles, blocks, num, den
        self.size = np.array([len(x) for x in sets], np.int64)
        self.off = np.concatenate([[0], np.cumsum(self.size)])
        # Grams by number: sets stay sorted, and one is held against others by looking their grams up in it.
        known, self.flat = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
        self.mark = np.zeros(len(known), bool)
        self.bits = np.stack([signature(x) for x in sets])
        self.links, self.root = np.zeros(len(names), np.int64), np.arange(len(names))

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.flat[self.off[i] : self.off[i + 1]]
        self.mark[own] = True
        hit = np.concatenate([[0], np.cumsum(self.mark[self.flat[X.ranges(self.off[others], self.off[others + 1])]])])
        self.mark[own] = False
        ends = np.cumsum(self.size[others])
        return hit[ends] - hit[ends - self.size[others]]

    def settle(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of others, those that reach the threshold with i, and the grams in common."""
        both = self.size[i] + self.size[others]
        most = (both - np.bitwise_count(self.bits[i] ^ self.bits[others]).sum(axis=1, dtype=np.int64)) // 2
        fit = most * self.den >= self.num * (both - most)
        others, both = others[fit], both[fit]
        common = self.common(i, others)
        fit = common * self.den >= self.num * (both - common)
        return others[fit], common[fit]

    def link(self, i: int, others: np.ndarray) -> None:
        if not len(others):
            return
        self.links[i] += self.docs[others].sum()
        self.links[others] += self.docs[i]
        roots = np.unique(np.append(self.root[others], self.root[i]))
        if len(roots) > 1:
            self.root[np.isin(self.root, roots[1:])] = roots[0]

    def of_list(self, tile: int, one: int, two: int) -> Iterator[tuple[int, np.ndarray]]:
        """i and its candidates: classes of compatible sizes, of blocks one and two, that no lesser tile holds together."""
        order = np.argsort(self.size, kind="stable")
        size, block = self.size[order], self.blocks[order]
        reach = np.searchsorted(size, size * self.den // self.num, side="right")
        lesser = {t: np.array([t in x for x in self.tiles]) for t in {t for x in self.tiles for t in x if t < tile}}
        for x, i in enumerate(order.tolist()):
            near = order[x + 1 : reach[x]]
            if one != two:
                near = near[block[x + 1 : reach[x]] != block[x]]
            for t in self.tiles[i]:
                if t < tile:
                    near = near[~lesser[t][near]]
            yield i, near

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """i and its partners, without those of one tile."""
        order = np.argsort(a, kind="stable")
        a, b = np.searchsorted(self.names, a[order]), np.searchsorted(self.names, b[order])
        edge = X.runs(a)
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            i, others = int(a[x]), np.unique(b[x:y])
            if self.tiles[i]:
                others = others[[not any(t in self.tiles[k] for t in self.tiles[i]) for k in others.tolist()]]
            yield i, others


def _lists(found: DataFrame, members: DataFrame) -> DataFrame | None:
    """tile, class, tiles (all of the class), one, two, block of every class in tiles; null where there is no tile."""
    entries = E.checkpoint(found.filter("tile IS NOT NULL").select("tile", "class").distinct())
    if entries.limit(1).count() == 0:
        return None
    # Tiles that share half of the lesser one's classes are one: their classes go there once.
    counts = E.checkpoint(entries.groupBy("tile").agg(F.count(F.lit(1)).alias("n")))
    own = entries.groupBy("class").agg(F.array_sort(F.collect_set("tile")).alias("tiles")).filter("size(tiles) > 1")
    both = own.select(F.explode(F.expr("flatten(transform(tiles, (x, i) -> transform(slice(tiles, i + 2, size(tiles)), y -> struct(x AS a, y AS b))))")).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("common"))
    small = E.lean(counts)
    edges = both.join(small.toDF("a", "n_a"), "a").join(small.toDF("b", "n_b"), "b").filter("common * 2 >= least(n_a, n_b)").select("a", "b")
    merged = components(E.checkpoint(edges)).toDF("tile", "into")
    entries = entries.join(E.lean(E.checkpoint(merged)), "tile", "left").select(F.coalesce("into", "tile").alias("tile"), "class").distinct()
    entries = E.checkpoint(entries.join(members.select("class", "size").distinct(), "class"))
    parts = entries.groupBy("tile").agg(F.ceil(F.sum("size") / F.lit(TILE_GRAMS)).cast("int").alias("parts"))
    tiles = entries.groupBy("class").agg(F.array_sort(F.collect_set("tile")).alias("tiles"))
    rows = entries.join(E.lean(E.checkpoint(parts)), "tile").join(E.lean(E.checkpoint(tiles)), "class").withColumn("block", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("tile", "class", "tiles", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block")


def _settled(docs: DataFrame, n: int, num: int, den: int, pairs: bool, many: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes a, b, size_a, size_b, common if asked for, else class, root, links of each tile; members: class, size, doc_id), both materialised."""
    spark = docs.sparkSession
    E.small_batches(spark)
    scratch = E.Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    survey = scratch.write(_survey(docs, n))
    members = E.checkpoint(survey.filter("class IS NOT NULL").select("class", "size", "doc_id").distinct())
    found = scratch.write(_candidates(docs, n, num, den, _hot(survey.filter("g IS NOT NULL").select("g", "c")), many, bits))
    lists = _lists(found, members)
    met = found.filter("a IS NOT NULL").groupBy("a", "b", "size_a", "size_b").agg(F.sum("shared").alias("shared"))
    met = E.checkpoint(met.filter(f"shared >= 1 + least(size_a, size_b) div {EXTRA}").select("a", "b"))
    # A group's pairs share a tile: that of the least class below theirs.
    least = E.checkpoint(met.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("least")))
    tiled = met.join(E.lean(least), "a", "left").withColumn("tile", F.coalesce("least", "a")).drop("least")
    parts = E.checkpoint(tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE_PAIRS)).alias("parts")))
    tiled = E.checkpoint(tiled.join(E.lean(parts), "tile").select("tile", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("two"), "a", "b"))
    asked = tiled.select("tile", "two", F.explode(F.array("a", "b")).alias("class")).distinct().select("tile", F.lit(-1).alias("one"), "two", F.lit(-1).alias("block"), "class")
    none = F.array().cast("array<bigint>")
    if lists is None:
        asked = asked.withColumn("tiles", none)
    else:
        of_class = E.lean(E.checkpoint(lists.select("class", "tiles").distinct()))
        asked = asked.join(of_class, "class", "left").withColumn("tiles", F.coalesce("tiles", none)).unionByName(lists)
    head = members.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("docs"))
    asked = E.checkpoint(asked.join(head, "class"))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, g, bounds in _sets(b, n):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(X.signed(class_of(g, bounds))), pa.array([g[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())], ["doc_id", "class", "grams"])

    sets = E.of_ids(docs, asked.select("doc_id").distinct(), ["doc_id", "text"]).mapInArrow(arrays, "doc_id bigint, class bigint, grams binary")
    rows = sets.join(E.lean(asked), ["doc_id", "class"]).select("tile", "one", "two", "class", F.lit(None).cast("bigint").alias("b"), "block", "docs", "tiles", "grams")
    rows = rows.union(tiled.select("tile", F.lit(-1), "two", "a", "b", F.lit(-1), F.lit(0).cast("bigint"), none, F.lit(None).cast("binary")))
    rows = rows.repartition(E.width(spark), "tile", "one", "two").sortWithinPartitions("tile", "one", "two")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in _by_tile(batches):
            yield from _tile_rows(key, part, num, den, pairs)
        X.tidy()

    schema = "a bigint, b bigint, size_a int, size_b int, common int" if pairs else "class bigint, root bigint, links bigint"
    settled = E.checkpoint(rows.mapInArrow(settle, schema))
    scratch.drop()
    return settled, members


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """A partition's rows, which are in order of tile, tile by tile."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("tile", "one", "two")])
        edge = X.runs(*key)
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own = tuple(key[:, x].tolist())
            if own != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = own
            held.append(batch.slice(x, y - x))
    if held:
        yield now, pa.Table.from_batches(held)


def _tile_rows(key: tuple[int, int, int], rows: pa.Table, num: int, den: int, pairs: bool) -> Iterator[pa.RecordBatch]:
    tile, one, two = key
    rows = rows.combine_chunks()
    is_pair = np.asarray(rows.column("b").is_valid())
    own = rows.filter(pa.array(~is_pair))
    names, at = np.unique(own.column("class").to_numpy(), return_index=True)  # rows of a document that repeats are one
    own = own.take(pa.array(at))
    sets = [np.frombuffer(x, np.uint64) for x in own.column("grams").to_pylist()]
    if len(sets) < 2:
        return
    t = Tile(names, sets, own.column("docs").to_numpy(), own.column("tiles").to_pylist(), own.column("block").to_numpy(), num, den)
    asked = rows.filter(pa.array(is_pair)).select(["class", "b"])
    todo = t.of_list(tile, one, two) if one >= 0 else t.of_pairs(asked.column("class").to_numpy(), asked.column("b").to_numpy())
    for i, others in todo:
        others, common = t.settle(i, others)
        if pairs:
            left, right = np.minimum(i, others), np.maximum(i, others)
            yield pa.RecordBatch.from_arrays([pa.array(names[left]), pa.array(names[right]), pa.array(t.size[left].astype(np.int32)), pa.array(t.size[right].astype(np.int32)), pa.array(common.astype(np.int32))], ["a", "b", "size_a", "size_b", "common"])
        else:
            t.link(i, others)
    if not pairs:
        at = np.flatnonzero(t.links > 0)
        yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(names[t.root[at]]), pa.array(t.links[at])], ["class", "root", "links"])


def near_pairs(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN, many: int = MANY, bits: int = MEET) -> DataFrame:
    """doc_a < doc_b, common, size_a, size_b, jaccard: every pair of documents at or above the threshold."""
    pairs, members = _settled(docs, n, num, den, True, many, bits)
    paired = E.checkpoint(members.join(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), "class"))
    paired = E.lean(paired)
    one = paired.select(F.col("class").alias("a"), F.col("doc_id").alias("d1"))
    two = paired.select(F.col("class").alias("b"), F.col("doc_id").alias("d2"))
    across = pairs.join(one, "a").join(two, "b").filter("d1 <> d2")
    across = across.select(F.least("d1", "d2").alias("doc_a"), F.greatest("d1", "d2").alias("doc_b"), "common", F.when(F.col("d1") < F.col("d2"), F.col("size_a")).otherwise(F.col("size_b")).alias("size_a"), F.when(F.col("d1") < F.col("d2"), F.col("size_b")).otherwise(F.col("size_a")).alias("size_b"))
    same = members.select(F.col("class"), "size", F.col("doc_id").alias("doc_a")).join(members.select("class", F.col("doc_id").alias("doc_b")), "class").filter("doc_a < doc_b").select("doc_a", "doc_b", F.col("size").alias("common"), F.col("size").alias("size_a"), F.col("size").alias("size_b"))
    found = across.union(same).withColumn("jaccard", F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")))
    return found.groupBy("doc_a", "doc_b").agg(F.max_by(F.struct("common", "size_a", "size_b", "jaccard"), F.struct("jaccard", "common", "size_a")).alias("m")).select("doc_a", "doc_b", "m.common", "m.size_a", "m.size_b", "m.jaccard")


#: Edges up to this number are grouped on the driver (16 bytes each), more of them by joins.
MOST_EDGES = 2_000_000


def _group_local(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex with the least vertex of its connected component."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            return names, names[label]
        label = new


def components(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """vertex, label: each vertex of the edges (a, b bigint) with the least vertex of its connected component."""
    spark = edges.sparkSession
    got = edges.select("a", "b").limit(most + 1).toArrow()
    if len(got) <= most:
        names, labels = _group_local(got.column("a").to_numpy(), got.column("b").to_numpy())
        return spark.createDataFrame(pa.table({"vertex": pa.array(names, pa.int64()), "label": pa.array(labels, pa.int64())}))
    both = edges.select(F.col("a").alias("vertex"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct()
    both = E.checkpoint(both)
    label = E.checkpoint(both.groupBy("vertex").agg(F.least(F.min("other"), F.first("vertex")).alias("label")))
    while True:
        theirs = both.join(label.withColumnRenamed("vertex", "other"), "other").groupBy("vertex").agg(F.min("label").alias("low"))
        new = label.join(theirs, "vertex").select("vertex", F.least("label", "low").alias("hop"), F.col("label").alias("was"))
        far = label.select(F.col("vertex").alias("hop"), F.col("label").alias("next"))
        new = E.checkpoint(new.join(far, "hop").select("vertex", F.least("hop", "next").alias("label"), "was"))
        moved = new.filter("label <> was").limit(1).count()
        label = new.select("vertex", "label")
        if not moved:
            return label


def near_duplicates(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN, many: int = MANY, bits: int = MEET) -> DataFrame:
    """doc_id, class_id, n_links: every document that has a link, the least doc_id of its group, and its number of links."""
    settled, members = _settled(docs, n, num, den, False, many, bits)
    links = settled.groupBy("class").agg(F.sum("links").alias("links"))
    # A document whose rows have different texts is in several classes and ties them together.
    first = E.checkpoint(members.groupBy("class").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies")))
    heads = first.select("class", "head")
    across = settled.filter("class <> root").select("class", "root").join(heads, "class").join(heads.toDF("root", "b"), "root").select(F.col("head").alias("a"), "b")
    own = members.join(heads, "class").filter("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    group = components(E.checkpoint(across.union(own).filter("a <> b").distinct()))
    # One hot class has one row in first and links: its members go to both without meeting in one place.
    counted = first.join(links, "class", "left").select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")).filter("links > 0")
    counted = members.join(E.lean(E.checkpoint(counted)), "class").groupBy("doc_id").agg(F.sum("links").alias("n_links"))
    return counted.join(group, counted["doc_id"] == group["vertex"], "left").select("doc_id", F.coalesce("label", "doc_id").alias("class_id"), "n_links")


def _among(docs: DataFrame, ids: DataFrame, inside: bool) -> DataFrame:
    """Rows of docs whose doc_id is (or else isn't) among ids (one materialised column, distinct); a null isn't."""
    few = E.small_ids(ids)
    if few is None:
        ids = ids.toDF("__id")
        return docs.join(ids, docs["doc_id"].cast("bigint") == ids["__id"], "left_semi" if inside else "left_anti")
    # Texts stay where they are: each task looks its rows up.
    shared = docs.sparkSession.sparkContext.broadcast(few)

    @F.arrow_udf("boolean")
    def stays(ids: pa.Array) -> pa.Array:
        found = E.has(shared.value, ids.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array((found & np.asarray(ids.is_valid())) == inside)

    return docs.filter(stays(F.col("doc_id").cast("bigint")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that have a near duplicate of lower doc_id in their group; rows that repeat a kept doc_id are one row.

    That row is the first by text (nulls last), then by the other columns that have an order. Rows without doc_id, and documents without words, stay.
    """
    gone = E.checkpoint(near_duplicates(docs).filter("doc_id <> class_id").select("doc_id"))
    left = _among(docs, gone, False)
    many = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("doc_id")
    many = E.checkpoint(many)
    if many.limit(1).count() == 0:
        return left
    order = [F.asc_nulls_last(f"`{c}`") for c in ["text", *(c for c, kind in docs.dtypes if c != "text" and "map<" not in kind and "variant" not in kind)]]
    first = _among(left, many, True).withColumn("__turn", F.row_number().over(W.partitionBy(F.col("doc_id").cast("bigint")).orderBy(*order)))
    return _among(left, many, False).union(first.filter("__turn = 1").drop("__turn"))
