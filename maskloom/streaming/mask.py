"""The masking projection on streams: stateless, append mode, no watermark needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from maskloom.operators.detect import mask_regex


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string", files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def mask_stream(docs: DataFrame, text: str = "text") -> DataFrame:
    """The batch projection, unchanged: each row's result depends on the row alone."""
    return mask_regex(docs, text)


def write_masked(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet; the checkpoint and the file sink's log make each row count once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
