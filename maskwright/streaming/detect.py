"""Detection over a stream of documents, and a registry that is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.normalize import normalize
from ..functions.tokens import namespace, sha256
from ..operators.detect import by_company_suffix, by_patterns
from ..sources.blocks import from_lines

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark: SparkSession, folder: str, glob: str = "documents.parquet", per_trigger: int = 64) -> DataFrame:
    """A stream of the document files of a folder."""
    return spark.readStream.schema(DOCUMENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def fields(stream: DataFrame) -> DataFrame:
    """Fields of a stream of documents: stateless, so each batch goes through the plan that tables do."""
    blocks = from_lines(stream)
    return by_patterns(blocks).unionByName(by_company_suffix(blocks))


def first_seen(found: DataFrame) -> DataFrame:
    """A record the first time that a value is seen, with the hashes of those seen before as the query's state."""
    key = normalize(F.col("original_text"), F.col("field_type"))
    records = found.withColumn("normalized_hash", sha256(key)).select("normalized_hash", namespace(F.col("field_type")).alias("namespace"), F.col("doc_id").alias("document_id"))
    return records.dropDuplicates(["normalized_hash"])


def write(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now to a Parquet folder."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
