"""Blocks of text with their place: the table that all operators work on.

``doc_id, page, block_ord, block_id, text, bbox, confidence``. Tables of plain text give one block a line; a page is LINES lines, so
that a very long text is many pages, and a box is drawn from the line's number and length. Lines under 2 characters are no blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import strip_if_any

COLUMNS = ("doc_id", "page", "block_ord", "block_id", "text", "bbox", "confidence")
SCHEMA = "doc_id bigint, page int, block_ord int, block_id string, text string, bbox array<int>, confidence double"
LINES, LEAST = 100, 2


def _id(page: Column, order: Column) -> Column:
    return F.format_string("block_%d_%d", page, order)


def from_lines(table: DataFrame, key: str = "doc_id", text: str = "text", confidence: float = 0.9) -> DataFrame:
    """Null keys and texts give no block."""
    rows = table.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("t")).filter("doc_id IS NOT NULL AND t IS NOT NULL")
    lines = rows.select("doc_id", F.posexplode(F.transform(F.split("t", "\n"), strip_if_any)).alias("n", "text")).filter(F.length("text") >= LEAST)
    page, order, y = (F.floor(F.col("n") / LINES) + 1).cast("int"), F.col("n") % LINES, F.col("n") % LINES * 20
    return lines.select("doc_id", page.alias("page"), order.alias("block_ord"), _id(page, order).alias("block_id"), "text", F.array(F.lit(0), y, F.length("text") * 8, y + 16).alias("bbox"), F.lit(confidence).alias("confidence"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return from_lines(spark.read.parquet(f"{folder}/documents.parquet"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return from_lines(spark.read.parquet(f"{folder}/pages.parquet"), "page_id", "html")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """A turn is a page."""
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    turns = table.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    lines = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.posexplode(F.transform(F.split("text", "\n"), strip_if_any)).alias("block_ord", "text")).filter(F.length("text") >= LEAST)
    y = F.col("block_ord") * 20
    return lines.select("doc_id", "page", "block_ord", _id(F.col("page"), F.col("block_ord")).alias("block_id"), "text", F.array(F.lit(0), y, F.length("text") * 8, y + 16).alias("bbox"), F.lit(0.9).alias("confidence"))


def full_text(blocks: DataFrame) -> DataFrame:
    """doc_id, page, n_blocks, full_text: a page's texts in reading order of detection, joined by spaces."""
    both = F.array_sort(F.collect_list(F.struct("block_ord", "text")))
    return blocks.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_blocks"), F.array_join(F.transform(both, lambda b: b["text"]), " ").alias("full_text"))


# Files and pixels: what renders pages and reads text from them is a function of the caller's.


def files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """path, filename, file_size_mb of the folder's own files; contents stay out unless ``content`` is asked for."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), (F.col("length") / F.lit(1048576.0)).alias("file_size_mb"), "content")


def missing(asked: DataFrame, found: DataFrame) -> DataFrame:
    """An error row for each filename that was asked for and isn't there."""
    return asked.select("filename").distinct().join(found.select("filename"), "filename", "left_anti").select("filename", F.lit("failed").alias("status"), F.concat(F.lit("File not found: "), "filename").alias("error"))


def render(found: DataFrame, renderer: Callable[[bytes], Iterable[bytes]]) -> DataFrame:
    """path, page (from 1), content, error: ``renderer`` turns a file into its pages' images; a file it fails on is one row with its error."""

    def turn(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    for k, image in enumerate(renderer(content), 1):
                        yield pd.DataFrame({"path": [path], "page": [k], "content": [image], "error": [None]})
                except Exception as e:
                    yield pd.DataFrame({"path": [path], "page": [0], "content": [None], "error": [str(e)]})

    return found.select("path", "content").mapInPandas(turn, "path string, page int, content binary, error string")


def read_images(images: DataFrame, reader: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """path, page and the columns of blocks, with ``error``: ``reader`` gives (polygon, text, confidence) of each text in an image.

    Texts under 2 characters are left out; block_ord counts the rest as they are found.
    """
    schema = "path string, page int, block_ord int, text string, polygon array<array<int>>, confidence double, error string"

    def turn(batches: Iterator) -> Iterator:
        import pandas as pd

        names = ["path", "page", "block_ord", "text", "polygon", "confidence", "error"]
        for batch in batches:
            for path, page, content in zip(batch["path"], batch["page"], batch["content"]):
                try:
                    found = [(p, t.strip(), c) for p, t, c in reader(content) if len(t.strip()) >= LEAST]
                    rows = [(path, page, k, t, [[int(v) for v in xy] for xy in p], round(float(c), 3), None) for k, (p, t, c) in enumerate(found)]
                except Exception as e:
                    rows = [(path, page, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=names)

    from ..functions.geometry import hull

    out = images.filter("error IS NULL").select("path", "page", "content").mapInPandas(turn, schema)
    return out.withColumn("bbox", hull(F.col("polygon"))).withColumn("block_id", _id(F.col("page"), F.col("block_ord")))


__all__ = ["COLUMNS", "SCHEMA", "conversations", "documents", "files", "from_lines", "full_text", "missing", "pages", "read_images", "render"]
