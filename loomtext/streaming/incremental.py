"""The same batch functions over arriving files: each micro-batch is extracted, compared and appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import native as N


def pages_stream(spark: SparkSession, folder: str, files_each: int = 64) -> DataFrame:
    return spark.readStream.schema("page_id long, url string, html string, source string, crawled_at timestamp").option("maxFilesPerTrigger", files_each).parquet(folder)


def first_seen(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Pages whose (url, content) wasn't seen within the watermark; state is dropped beyond it."""
    keyed = stream.withColumn("content_hash", N.content_hash("html"))
    return keyed.withWatermark("crawled_at", late).dropDuplicatesWithinWatermark(["url", "content_hash"])


def run_incremental(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Process what has arrived and stop. A batch is written under its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows, with a watermark for late ones."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")
