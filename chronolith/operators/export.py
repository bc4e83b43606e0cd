"""K7: transcripts as subtitles, Markdown, text and JSON, one row a timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock as C


def _joined(segments: DataFrame, line: Column, glue: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"])
    return segments.groupBy("video_id").agg(F.array_join(lines, glue).alias("body"))


def _cue(mark: str) -> Column:
    return F.concat(C.format_cue_time(F.col("start_s"), mark), F.lit(" --> "), C.format_cue_time(F.col("end_s"), mark), F.lit("\n"), F.col("text"), F.lit("\n"))


def to_srt(segments: DataFrame) -> DataFrame:
    return _joined(segments, F.concat((F.col("idx") + 1).cast("string"), F.lit("\n"), _cue(",")), "\n").withColumnRenamed("body", "srt")


def to_vtt(segments: DataFrame) -> DataFrame:
    return _joined(segments, _cue("."), "\n").select("video_id", F.concat(F.lit("WEBVTT\n\n"), "body").alias("vtt"))


def to_markdown(segments: DataFrame, title: str = "Transcript") -> DataFrame:
    line = F.concat(F.lit("**["), C.format_timestamp(F.col("start_s")), F.lit("]** "), F.col("text"))
    return _joined(segments, line, "\n\n").select("video_id", F.concat(F.lit(f"# {title}\n\n"), "body", F.lit("\n")).alias("md"))


def to_text(segments: DataFrame) -> DataFrame:
    return _joined(segments, F.col("text"), "\n").withColumnRenamed("body", "txt")


def to_json(segments: DataFrame) -> DataFrame:
    row = F.struct("idx", C.numbered_id("seg", F.col("idx")).alias("id"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", F.lit(None).cast("string").alias("language"))
    own = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias("segments"))
    return own.select("video_id", F.to_json(F.struct(F.transform("segments", lambda s: s.dropFields("idx")).alias("segments")), {"ignoreNullFields": "false"}).alias("json"))
