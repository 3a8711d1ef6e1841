"""Streams: the cost ledger in windows, sessions by gaps, and transcripts into notes by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekeep import schemas


def stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.LEDGER).json(path).withColumn("ts", F.col("ts").try_cast("timestamp")).where("ts is not null")


def windowed_cost(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, end, model, tokens, cost, entries of each window; rows later than the watermark are left out in append mode."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    sums = rows.groupBy(w.alias("w"), "model").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.count("*").alias("entries"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "model", "tokens", "cost", "entries")


def activity(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, entries: runs of events that no gap interrupts."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    runs = rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("entries"))
    return runs.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "entries")


def into_notes(spark: SparkSession, folder: str, checkpoint: str, commit: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each micro-batch of new transcript files (session_id, path, pos, line) goes to commit once. A file that grows after it was seen is not read again: write snapshots under new names."""
    files = spark.readStream.text(folder, wholetext=True, pathGlobFilter="*.jsonl").select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("_metadata.file_name", r"^(.*)\.jsonl$", 1).alias("session_id"), "value")
    lines = files.select("session_id", "path", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("pos", "line"))
    return lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
