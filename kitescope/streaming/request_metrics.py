"""Request metrics per time window as a stream (M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from kitescope.operators.requestlog import failed


def windowed_metrics(log: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Requests, errors, error share and times per tumbling window and url.

    Works on a stream or a batch.  The event time must be a timestamp, so zone-less times are cast;
    state holds one row per open window and url and is dropped once the watermark passes.
    """
    timed = log.withColumn("ts", F.col("ts").cast("timestamp"))
    if log.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    return (
        timed.groupBy(F.window("ts", window).alias("w"), "url")
        .agg(
            F.count("*").alias("requests"), F.count_if(failed(F.col("status"))).alias("errors"),
            F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("max_seconds"),
        )
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "url", "requests", "errors",
            (F.col("errors") * 100.0 / F.col("requests")).alias("error_pct"), "mean_seconds", "max_seconds",
        )
    )


def run_available(stream: DataFrame, output: str, checkpoint: str) -> DataFrame:
    """Process everything available into Parquet, once per row, and return what was written."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", output)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(output)


def file_stream(spark, folder: str, schema: StructType, glob: str) -> DataFrame:
    """Parquet files of a folder as a stream, only those matching ``glob``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
