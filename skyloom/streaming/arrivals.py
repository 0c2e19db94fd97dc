"""Counts of arriving rows by time window, as a Structured Streaming query (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(rows: DataFrame, time: str, keys: tuple[str, ...] = (), width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rows by window and keys; rows later than ``late`` behind the newest are left out, which bounds
    the state. Works on a batch as on a stream."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def run_available(spark: SparkSession, folder: str, schema, time: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Process the files of ``folder`` that aren't processed yet into Parquet; a later call goes on
    where this one stopped."""
    stream = spark.readStream.schema(schema).parquet(folder)
    counted = windowed_counts(stream, time, **options)
    return counted.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
