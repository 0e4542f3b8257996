"""Word counts of the corpus, and sums of large arrays over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import exchange as E, textops as X


def top_words(docs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (ascending) and counts of the ``most`` most frequent plain words of all texts, and the number of all words.

    Equal counts go by hash. The sizes of what reaches the driver are bounded by ``most`` times the session's shuffle partitions.
    """
    packer = E.Packer(E.width(docs.sparkSession), {"word": np.uint64, "count": np.int64}, {})

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def pack() -> Iterator[pa.RecordBatch]:
            words = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            edge = X.runs(words)
            words = words[edge[:-1]]
            yield from packer.add(E.bucket_of(words, packer.buckets), np.zeros(len(words), np.int64), {"word": words, "count": np.diff(edge)}, {}, 1)

        for b in batches:
            for s in X.pieces(b):
                held.append(X.plain_words(s.column("text")).hash)
                size += len(held[-1])
                if size > 4_000_000:
                    yield from pack()
                    held, size = [], 0
        yield from pack()
        yield packer.flush()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = packer.read(batches)
        order = np.argsort(got["word"], kind="stable")
        word, count = got["word"][order], got["count"][order]
        edge = X.runs(word)
        count = np.add.reduceat(count, edge[:-1]) if len(word) else count
        word = word[edge[:-1]]
        best = np.lexsort((word, -count))[:most]
        yield pa.RecordBatch.from_arrays([pa.array(X.signed(word[best])), pa.array(count[best]), pa.array(np.full(len(best), count.sum()))], ["word", "count", "total"])

    found = E.checkpoint(E.regroup(docs.select("text"), source, packer, reduce, "word bigint, count bigint, total bigint").withColumn("part", F.spark_partition_id()))
    total = found.groupBy("part").agg(F.first("total").alias("t")).agg(F.sum("t")).first()[0] or 0
    # Buckets' words below a count that enough words have are left where they are: what meets in one task is about ``most`` words, however many buckets there are.
    size = F.floor(F.log2("count") * 64).cast("int")
    sizes = found.groupBy(size.alias("size")).count().toArrow().sort_by([("size", "descending")])
    upto = int(np.searchsorted(np.cumsum(sizes.column("count").to_numpy()), most))
    few = found.filter(size >= sizes.column("size")[upto].as_py()) if upto < len(sizes) else found
    got = few.orderBy(F.desc("count"), "word").limit(most).select("word", "count").toArrow()
    word, count = np.ascontiguousarray(got.column(0).to_numpy()).view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(word)
    return word[order], count[order], int(total)


def ids_of(words: np.ndarray, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Index of each hash in words (ascending); others get one of ``buckets`` further ids."""
    other = len(words) + (X.mix(hashes) % X.U64(buckets)).astype(np.int64)
    if not len(words):
        return other
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at, other)


#: Rows of an array that travel together, and how many partitions' arrays are added up first.
BLOCK, FAN = 1024, 16


def sum_arrays(df: DataFrame, make, rows: int, columns: int, kind: type = np.float64) -> np.ndarray:
    """Sum over partitions of the (rows, columns) arrays that make(batches) returns; the driver gets one array, whatever the number of partitions.

    Arrays go from partitions as ``kind``; sums are float64, in order of partitions and in a tree, so that no task takes more than FAN blocks of each
    sum it makes at once, and results don't depend on which task ends first.
    """
    blocks = (rows + BLOCK - 1) // BLOCK

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.ascontiguousarray(make(batches), kind)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array(np.full(blocks, part, np.int32)), pa.array([whole[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in range(blocks)], pa.binary())], ["block", "part", "data"])

    def add(own: type):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come in order of block, group and part."""
            now, total = None, None
            out: list = []
            for b in batches:
                for block, part, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    x = np.frombuffer(x.as_buffer(), own)
                    if (block, part // FAN) == now:
                        total = total + x
                        continue
                    if now:
                        out.append((*now, total.tobytes()))
                    now, total = (block, part // FAN), x.astype(np.float64)
            if now:
                out.append((*now, total.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["block", "part", "data"])

        return run

    width, many = E.width(df.sparkSession), df.rdd.getNumPartitions()
    got, wire = df.mapInArrow(source, "block int, part int, data binary"), kind
    while many > FAN:
        groups = -(-many // FAN)
        # Dealt out in turn, not by hash: no task gets several groups more than another.
        got = got.repartitionById(width, F.expr(f"CAST(pmod(CAST(block AS bigint) * {groups} + part div {FAN}, {width}) AS int)")).sortWithinPartitions("block", "part").mapInArrow(add(wire), "block int, part int, data binary")
        wire, many = np.float64, groups
    last = min(blocks, width)
    got = got.repartitionById(last, F.expr(f"CAST(pmod(block, {last}) AS int)")).sortWithinPartitions("block", "part").mapInArrow(add(wire), "block int, part int, data binary").toArrow().to_pylist()
    out = np.zeros((rows, columns))
    for r in sorted(got, key=lambda r: (r["block"], r["part"])):
        part = np.frombuffer(r["data"], np.float64).reshape(-1, columns)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] += part
    return out
