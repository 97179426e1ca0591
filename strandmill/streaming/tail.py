"""Following the metric and diagnostic files of running jobs with Structured Streaming."""

from __future__ import annotations

import os
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Fixed value: the fields of a diagnostic event.
EVENT = "phase string, event string, timestamp timestamp, rss_mb double, value double"


def follow(spark: SparkSession, folder: str, schema: str = EVENT, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def windowed(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events, mean value and largest memory per phase and time window; events later than `late` are dropped."""
    span = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    grouped = events.withWatermark("timestamp", late).groupBy(span.alias("w"), "phase")
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.max("rss_mb").alias("max_rss_mb"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "phase", "n", "mean_value", "max_rss_mb")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of a phase without a pause of `gap`."""
    grouped = events.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap).alias("w"), "phase")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "phase", "n")


def drain(result: DataFrame, mode: str = "complete") -> DataFrame:
    """The final state of a streaming aggregate over all that is there now, as a table in the shared folder.

    Each batch replaces the table as a whole ("complete") or adds to it ("append"); nothing passes the driver.
    """
    spark = result.sparkSession
    folder = os.path.join(checkpoint_dir(spark), f"stream-{uuid4().hex}")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/table")

    query = result.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/table")
