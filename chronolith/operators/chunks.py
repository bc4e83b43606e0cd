"""Segments to retrieval chunks, by sentence ends, pauses and length.

The fold marks where chunks begin; segments then take the last mark before them, and a chunk
is a grouped aggregate.  chunk_step() is the same fold one segment at a time, for streams.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

PAUSE = 0.5


@dataclass(frozen=True)
class ChunkRules:
    least: float = 20.0
    most: float = 60.0
    break_on_pause: float = 8.0

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.most or self.break_on_pause <= 0:
            raise ValueError("chunk lengths have to be positive, the least not above the most")


def chunk_marks(segments: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """segments with `first_segment`, the idx at which a segment's chunk begins."""
    rows = F.array_sort(F.collect_list(F.struct("idx", F.col("start_s").alias("s"), F.col("end_s").alias("e"), T.ends_sentence(F.col("text")).alias("stop"))))
    ordered = segments.groupBy("video_id").agg(rows.alias("__s"))
    kind = dict(segments.dtypes)["idx"]
    zero = F.struct(F.lit(None).cast("double").alias("first"), F.lit(None).cast("double").alias("last"), F.array().cast(f"array<{kind}>").alias("begun"))

    def step(a: Column, s: Column) -> Column:
        gap, length = s["s"] - a["last"], a["last"] - a["first"]
        close = (s["e"] - a["first"] > rules.most) | ((gap >= rules.break_on_pause) & (length >= rules.least / 2)) | ((gap >= PAUSE) & (length >= (rules.least + rules.most) / 2))
        new = a["first"].isNull() | close
        first = F.when(new, s["s"]).otherwise(a["first"])
        done = (((s["e"] - first) >= rules.least) & s["stop"]) | ((s["e"] - first) >= rules.most)
        return F.struct(F.when(~done, first).alias("first"), s["e"].alias("last"), F.when(new, F.array_append(a["begun"], s["idx"])).otherwise(a["begun"]).alias("begun"))

    begun = ordered.select("video_id", F.explode(F.aggregate("__s", zero, step)["begun"]).alias("idx"), F.lit(True).alias("__first"))
    order = W.partitionBy("video_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    return segments.join(begun, ["video_id", "idx"], "left").withColumn("first_segment", F.last(F.when(F.col("__first"), F.col("idx")), ignorenulls=True).over(order)).drop("__first")


def ordered_texts(order: str = "idx") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])


def chunks(segments: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """video_id, idx, start_s, end_s, text, first_segment, last_segment."""
    marked = chunk_marks(segments, rules)
    out = marked.groupBy("video_id", "first_segment").agg(F.min_by("start_s", "idx").alias("start_s"), F.max("end_s").alias("end_s"), T.join_texts(ordered_texts()).alias("text"), F.max("idx").alias("last_segment"))
    return out.withColumn("idx", F.row_number().over(W.partitionBy("video_id").orderBy("first_segment")) - 1)


def segment_ids(first: Column, last: Column) -> Column:
    """P8."""
    from ..functions.clock import numbered_id

    return F.transform(F.sequence(first, last), lambda i: numbered_id("seg", i))


class Pending(NamedTuple):
    """The open chunk of a timeline between micro-batches: what the fold keeps, and its rows."""

    first: float | None = None
    last: float | None = None
    rows: tuple[tuple[int, float, float, str], ...] = ()


Chunk = tuple[int, int, float, float, str]


def closed(open_: Pending) -> list[Chunk]:
    """The open chunk as (first, last, start, end, text), if there is one."""
    if not open_.rows:
        return []
    numbers, starts, ends, texts = zip(*open_.rows)
    return [(numbers[0], numbers[-1], starts[0], max(ends), T.joined(texts))]


def chunk_step(open_: Pending, row: tuple[int, float, float, str], rules: ChunkRules = ChunkRules()) -> tuple[Pending, list[Chunk]]:
    """The fold of chunk_marks(), segment by segment: (idx, start, end, text) in, closed chunks out."""
    _, start, end, text = row
    done: list[Chunk] = []
    if open_.rows:
        silence, length = start - open_.last, open_.last - open_.first
        enough = [(rules.break_on_pause, rules.least / 2), (PAUSE, (rules.least + rules.most) / 2)]
        if end - open_.first > rules.most or any(silence >= pause and length >= least for pause, least in enough):
            done, open_ = closed(open_), Pending()
    open_ = Pending(open_.first if open_.rows else start, end, (*open_.rows, row))
    full = rules.least if re.search(T.SENTENCE_END, text.rstrip()) else rules.most
    return (Pending(), done + closed(open_)) if end - open_.first >= full else (open_, done)
