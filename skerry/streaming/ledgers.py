"""Streaming forms: windowed counts and descriptives with late data, sessions, and a running ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, group: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and sd per tumbling window and group; works on streams and on tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), F.col(group).alias("group_label")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).select(F.col("w.start").alias("start"), "group_label", "n", "mean", "sd")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key: start, end and events."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def running_tests(transcripts: DataFrame) -> DataFrame:
    """Tests and best p of each data set so far (update mode on a stream)."""
    return transcripts.where("error is null and p_value is not null").groupBy("data_id").agg(F.count("*").alias("tests"), F.min("p_value").alias("best_p"))


def follow(spark, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A stream of a folder's Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
