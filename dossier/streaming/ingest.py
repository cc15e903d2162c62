"""Incremental cleaning and chunking of newly arrived content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import chunk


def stream_ingest(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str,
    files_per_batch: int | None = None, key: str = "id",
) -> StreamingQuery:
    """Chunk every content row not seen before and append the chunks to ``target``.

    The checkpoint records what was read, so a restart goes on where it
    stopped.  A row whose ``key`` came before, in the same file or another, is
    dropped: the state store keeps the keys, one small row each, spread over the
    shuffle partitions.  The first one to arrive is chunked.  Rows without a key
    are told apart by their text.  The file sink commits each batch once.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(source).withColumn(
        "_text_key", F.when(F.col(key).isNull(), F.md5(F.coalesce("extracted_text", F.lit("")))))
    return (
        chunk.chunk_documents(rows.dropDuplicates([key, "_text_key"]).drop("_text_key"))
        .writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(target)
    )


def ingested(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)
