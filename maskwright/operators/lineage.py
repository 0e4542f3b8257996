"""Where iterative plans put their intermediate results, and how rows that belong together meet."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; local sessions that name none get a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, materialised in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def together(df: DataFrame, *keys: str) -> DataFrame:
    """df, with rows of equal keys in one partition, so that what is grouped by them (and more) needs no other shuffle.

    The partitions are the session's shuffle partitions, which the deployment sizes to its input; adaptive execution doesn't merge them, since
    rows that are widened after a shuffle take more memory than their bytes tell.
    """
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
