"""Processing runs, stored rows and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_run(runs: DataFrame, keys: list[str], preferred: Column | None = None) -> DataFrame:
    """L2: the preferred run if there is one, else a complete one, the farthest, the newest; ties by run_id."""
    rank = F.struct((preferred if preferred is not None else F.lit(False)).alias("p"), (F.col("status") == "complete").alias("c"), "processed_until", "updated_at", (-F.col("run_id")).alias("i"))
    return runs.groupBy(*keys).agg(F.max_by(F.struct("run_id", "status", "processed_until"), rank).alias("r")).select(*keys, "r.run_id", "r.status", "r.processed_until")


def shown_status(status: Column, rows: Column) -> Column:
    """What a reader is told of a run (null: none) with so many segments."""
    return F.when(status.isNull() | ((status == "complete") & (rows == 0)), "empty").when(status.isin("complete", "failed", "running"), status).otherwise("partial")


def nest_words(segments: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with `words`, ordered by idx; an empty array where there are none."""
    names = [c for c in words.columns if c not in keys]
    own = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("words"))
    return segments.join(own, keys, "left").withColumn("words", F.coalesce("words", F.array().cast(own.schema["words"].dataType)))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K3: rows of new, and rows of old whose key new lacks."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def without_runs(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose run is not deleted."""
    return rows.join(gone.select(key), key, "left_anti")


def next_index(rows: DataFrame, groups: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """A2: the index after the last, 0 where there are no rows."""
    top = rows.groupBy(*keys).agg((F.max(idx) + 1).alias("next_idx"))
    return groups.select(*keys).distinct().join(top, keys, "left").withColumn("next_idx", F.coalesce("next_idx", F.lit(0)))


def pick_stream(streams: DataFrame, keys: list[str], index: str, default: Column, wanted: Column | None = None) -> DataFrame:
    """The wanted stream, else one marked default, else the first."""
    rank = F.struct((wanted if wanted is not None else F.lit(False)).alias("w"), default.alias("d"), (-F.col(index)).alias("i"))
    return streams.groupBy(*keys).agg(F.max_by(index, rank).alias(index))
