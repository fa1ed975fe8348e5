"""Extension: pages landing as a stream. Not part of the batch engine's surface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.pages import parsed

PAGE = "url string, html string, captured_at timestamp"


def landing(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """Parsed pages of the Parquet files that arrive in folder; a content once within the watermark."""
    pages = spark.readStream.schema(PAGE).parquet(folder)
    return parsed(pages).withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["content_hash"])


def into(stream: DataFrame, checkpoint: str, land: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand each micro-batch to land, which must be idempotent; stops when what is there is done."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(land).trigger(availableNow=True).start()


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Pages by hour of capture."""
    return stream.withWatermark("captured_at", late).groupBy(F.window("captured_at", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
