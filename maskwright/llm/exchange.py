"""Exchange of packed columns between Python workers, and how a job cuts its lineage.

Large numbers of small records (hashes with positions) move as a few binary rows: one row a bucket and flush,
each holding whole numpy columns. Spark still does the partitioning, shuffling and retrying.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textops as X

#: Records that a worker gathers before it passes them on.
FLUSH = 700_000
#: Bytes of an Arrow batch between the JVM and a worker, where the session doesn't say: both sides hold a batch or two, for each core.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as texts are of any length; a session's own setting stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def width(spark: SparkSession) -> int:
    """Number of buckets: the session's shuffle partitions, which the deployment sizes to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names in spark.checkpoint.dir; one is made only where none is set (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared folder for the length of an operator: compressed, read by column, and deleted by drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/scratch-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes the tables; what was read from them must be materialised."""
        remove(self.spark, *self.paths)
        self.paths.clear()


def remove(spark: SparkSession, *paths: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        where = hadoop(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Packer:
    """Gathers records (bucket, slot of a text, columns) and the texts' keys, and packs them by bucket."""

    def __init__(self, buckets: int, kinds: dict[str, type], keys: dict[str, type]):
        self.buckets, self.kinds, self.keys = buckets, kinds, keys
        self._clear()

    def _clear(self) -> None:
        self.n, self.slots, self.parts, self.tables = 0, 0, [], []

    def add(self, bucket: np.ndarray, slot: np.ndarray, columns: dict[str, np.ndarray], keys: dict[str, np.ndarray], texts: int) -> Iterator[pa.RecordBatch]:
        self.parts.append((bucket.astype(np.uint32), (slot + self.slots).astype(np.uint32), {k: columns[k].astype(t, copy=False) for k, t in self.kinds.items()}))
        self.tables.append({k: keys[k].astype(t, copy=False) for k, t in self.keys.items()})
        self.n += len(bucket)
        self.slots += texts
        if self.n >= FLUSH:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        bucket = np.concatenate([p[0] for p in self.parts]) if self.parts else np.zeros(0, np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        slot = np.concatenate([p[1] for p in self.parts])[order] if self.parts else bucket
        columns = {k: np.concatenate([p[2][k] for p in self.parts])[order] if self.parts else np.zeros(0, t) for k, t in self.kinds.items()}
        table = {k: np.concatenate([p[k] for p in self.tables]) if self.tables else np.zeros(0, t) for k, t in self.keys.items()}
        edge = X.runs(bucket)
        rows: dict[str, list] = {k: [] for k in ("bucket", "n", "texts", "slot", *self.kinds, *(f"key_{k}" for k in self.keys))}
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            used, own = np.unique(slot[a:b], return_inverse=True)
            rows["bucket"].append(int(bucket[a]))
            rows["n"].append(b - a)
            rows["texts"].append(len(used))
            rows["slot"].append(X.planes(own.astype(np.uint32)))
            for k in self.kinds:
                rows[k].append(X.planes(columns[k][a:b]))
            for k in self.keys:
                rows[f"key_{k}"].append(X.planes(table[k][used]))
        del order, bucket, slot, columns, table
        self._clear()
        X.tidy()
        return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("texts", pa.int32()), *((k, pa.binary()) for k in rows if k not in ("bucket", "n", "texts"))]))

    def schema(self) -> str:
        return ", ".join(["bucket int", "n int", "texts int", "slot binary", *(f"{k} binary" for k in self.kinds), *(f"key_{k} binary" for k in self.keys)])

    def read(self, batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        """All records of a partition, each with its text's keys."""
        parts: dict[str, list] = {k: [] for k in (*self.kinds, *self.keys)}
        for batch in batches:
            for r in batch.to_pylist():
                slot = X.unplanes(r["slot"], np.uint32, r["n"])
                for k, t in self.kinds.items():
                    parts[k].append(X.unplanes(r[k], t, r["n"]))
                for k, t in self.keys.items():
                    parts[k].append(X.unplanes(r[f"key_{k}"], t, r["texts"])[slot])
        return {k: np.concatenate(parts[k]) if parts[k] else np.zeros(0, t) for k, t in {**self.kinds, **self.keys}.items()}


def regroup(df: DataFrame, source: Callable, packer: Packer, reduce: Callable, schema: str) -> DataFrame:
    """source: batches to packed batches; their buckets are brought together; reduce: partition's batches to batches."""
    n = packer.buckets
    packed = df.mapInArrow(source, packer.schema())
    return packed.repartitionById(n, F.col("bucket")).mapInArrow(reduce, schema)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((X.mix(h ^ X.U64(0xA0761D6478BD642F)) >> X.U64(33)) % X.U64(n)).astype(np.int64)


#: Ids up to this number (8 bytes each) may go to the driver and to every worker; beyond it the same work is done by a join.
MOST_IDS = 1_000_000


def small_ids(df: DataFrame) -> np.ndarray | None:
    """Sorted values of the one bigint column of df if they are few, else None."""
    got = df.limit(MOST_IDS + 1).toArrow().column(0)
    if len(got) > MOST_IDS:
        return None
    return np.sort(got.to_numpy())


def has(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(ids):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    return ids[at] == x


def of_ids(docs: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of docs whose doc_id is in ids (distinct); a filter in the scan's own tasks where ids are few, a semi-join else."""
    few = small_ids(ids)
    if few is None:
        return docs.select(*columns).join(ids, "doc_id", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(few)
    plan = docs.select(*columns).filter(F.col("doc_id").isNotNull())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.flatnonzero(has(shared.value, b.column("doc_id").to_numpy()))
            yield b.take(pa.array(found))

    return plan.mapInArrow(keep, plan.schema)


#: Rows (of a few numbers) up to which a table is sent to all workers for a join.
MOST_ROWS = 300_000


def lean(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is small. It must be materialised, as its rows are counted; the join works either way."""
    return F.broadcast(df) if df.limit(MOST_ROWS + 1).count() <= MOST_ROWS else df
