"""Timeline tables from stored data.

segments(video_id, idx, start_s, end_s, text) and its likes are derived from the tables at
hand: lines of documents and turns of conversations as speech with made-up timing, events as
windows of speech probability and as spans, embeddings as thumbnails, orders as runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _timed(rows: DataFrame) -> DataFrame:
    """video_id, idx, text -> with start_ms, dur_ms, start_s, end_s."""
    gap = F.when(F.col("idx") % 7 == 6, 9000).when(F.col("idx") % 3 == 2, 700).otherwise(100)
    rows = rows.withColumn("dur_ms", 400 + 60 * F.length("text")).withColumn("gap_ms", gap)
    earlier = W.partitionBy("video_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start_ms", F.coalesce(F.sum(F.col("dur_ms") + F.col("gap_ms")).over(earlier), F.lit(0)))
    return rows.select("video_id", "idx", (F.col("start_ms") / 1000.0).alias("start_s"), ((F.col("start_ms") + F.col("dur_ms")) / 1000.0).alias("end_s"), "text")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timeline a document, one segment a line that is not blank."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    lines = lines.filter(F.length(F.trim("text")) > 0)
    return _timed(lines.select("video_id", (F.row_number().over(W.partitionBy("video_id").orderBy("pos")) - 1).alias("idx"), "text"))


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return _timed(rows.select(F.col("conv_id").alias("video_id"), (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).alias("idx"), "text"))


def timestamp(column: str) -> Column:
    """Stored times carry no zone; they are read as UTC."""
    return F.col(column).cast("timestamp")


def speech_windows(spark: SparkSession, sf_dir: str, streams: int = 10) -> DataFrame:
    """stream_id, w (from 0), p: one speech probability for every 512 samples."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % streams).alias("stream_id"), "ts", "event_id", "event_type")
    rows = rows.withColumn("w", F.row_number().over(W.partitionBy("stream_id").orderBy("ts", "event_id")) - 1)
    error = F.col("event_type") == "error"
    inside = F.when(error, 0.3).otherwise(0.9)
    outside = F.when(error & (F.col("event_id") % 11 == 0), 0.6).when(error, 0.4).otherwise(0.1)
    return rows.select("stream_id", "w", F.when((F.col("w") + 7 * F.col("stream_id")) % 97 < 61, inside).otherwise(outside).alias("p"))


def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, t (seconds), frame_id, pixels: 64 grey values."""
    rows = table(spark, sf_dir, "embeddings")
    pixels = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 127.5).cast("int"))
    return rows.select(F.col("label").alias("video_id"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("t"), F.col("vec_id").alias("frame_id"), pixels.alias("pixels"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, start_ms, end_ms."""
    start = F.unix_millis(timestamp("ts"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", start.alias("start_ms"), (start + F.rint(F.col("value") * 1000).cast("long")).alias("end_ms"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, kind, status, processed_until, updated_at."""
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "running").otherwise("partial")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("kind"), status.alias("status"), F.col("o_totalprice").cast("double").alias("processed_until"), F.col("o_orderdate").alias("updated_at"))
