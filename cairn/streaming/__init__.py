"""Stateless operators over streams: they are the batch operators themselves, run by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    """Parquet files of pixels, points or features as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_stream(source: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Write ``operator`` of a stream to Parquet, exactly once by the checkpoint.

    For operators that keep no state between rows: thresholds and ranges (``raster_threshold`` joins the stream with a static
    meta table), ``raster_normalize_range``, ``pass_through``, coordinate transforms, and ``clip_to_extent``. Without
    ``continuous`` the query ends when all files there are have been read.
    """
    writer = operator(source).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer if continuous else writer.trigger(availableNow=True)).start()
