"""Streaming sources run the same per-document plans: every operator is stateless, so no watermark or state is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_documents(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """Parquet files of documents as a stream, in micro-batches of a few files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def annotate_stream(docs: DataFrame, plan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Appends the plan's rows to a Parquet sink, each input row once, and stops when the input is used up."""
    return plan(docs).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
