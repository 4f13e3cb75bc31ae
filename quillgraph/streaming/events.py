"""Event streams: windowed counts with late data, access counts and search logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; works on streams, with a watermark, and on tables."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and different users by overlapping window. On a table users are exact, on a stream, which can't keep them all, approximate."""
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.count_distinct("user_id")
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"))
        .agg(F.count("*").alias("n"), users.alias("users"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "users")
    )


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """A user's events with less than ``gap`` between them."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"), F.max("ts").alias("last"))
        .select("user_id", F.col("w.start").alias("start"), "last", "n")
    )


def access_counts(events: DataFrame) -> DataFrame:
    """Access count, last access, helpful and harmful marks by node, from a log of events."""
    return events.groupBy("user_id").agg(
        F.count("*").alias("access_count"), F.max(F.unix_millis("ts")).alias("last_accessed"),
        F.count_if(F.col("event_type") == "purchase").alias("helpful_count"), F.count_if(F.col("event_type") == "error").alias("harmful_count"),
    )


def recent(events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Events of the last ``days``; older ones are dropped like late data."""
    return events.where(F.col("ts") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {days} days"))


def log_searches(results: DataFrame, path: str, date: str) -> None:
    """Append one log row a query, in a folder a day: its hits and its near misses."""
    item = lambda miss: F.array_sort(F.collect_list(F.when(F.col("near_miss") == miss, F.struct("rank", "id", "score"))))
    rows = results.groupBy("query_id").agg(item(False).alias("top"), item(True).alias("near_misses")).withColumn("date", F.lit(date))
    rows.write.mode("append").partitionBy("date").json(path)
