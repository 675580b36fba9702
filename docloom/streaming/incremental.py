"""Incremental runs: only what is new is processed, by file streams that end when they have caught up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def catch_up(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, *, format: str = "json", partition_by: list[str] = []) -> None:  # noqa: A002
    """Process the files of `source` that no earlier run has seen and append the result to `target`, exactly once."""
    stream = spark.readStream.schema(schema).format(format).load(source)
    writer = transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).outputMode("append").trigger(availableNow=True)
    (writer.partitionBy(*partition_by) if partition_by else writer).start().awaitTermination()


def windowed_counts(events: DataFrame, *, time: str = "ts", keys: list[str], window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and key; works on a stream (rows later than `late` are dropped) and on a table."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")
