"""Search over many timelines and queries in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.clock import numbered_id
from ..operators import postings as P
from ..operators.chunks import ordered_texts
from ..operators.windows import group_marks, overlap_join

KEYS = ["query_id", "video_id"]


@dataclass(frozen=True)
class SearchOptions:
    merge_gap: float = 8.0
    max_window: float = 90.0
    candidates_per_result: int = 16
    #: Hits of a query in a timeline that are made into windows, the best; None: as many as `limit` calls for.
    candidates: int | None = None
    limit: int = 5
    expand: float = 0.0
    start: float | None = None
    end: float | None = None

    def __post_init__(self) -> None:
        if self.limit < 1 or self.expand < 0 or (self.candidates is not None and self.candidates < 1):
            raise ValueError("limit and candidates have to be 1 or more, expand not negative")

    def most_candidates(self) -> int:
        return max(64, self.limit * self.candidates_per_result) if self.candidates is None else self.candidates


def in_range(start: float | None, end: float | None) -> Column:
    """Overlaps [start, end]; either bound may be missing."""
    a = F.lit(True) if start is None else F.col("end_s") >= start
    b = F.lit(True) if end is None else F.col("start_s") <= end
    return a & b


def candidates(segments: DataFrame, queries: dict[int, P.Query], options: SearchOptions = SearchOptions(), kinds: tuple[str, ...] = ("term", "prefix", "phrase")) -> DataFrame:
    """L1: the best hits of each query in each timeline, with their segments: score, start_s, end_s, text, tokens."""
    indexed = P.with_stats(P.index(segments))
    found = P.unit_frequencies(indexed, queries, kinds)
    hits = P.bm25(found, ("start_s", "end_s", "text", "tokens")).filter(in_range(options.start, options.end))
    best = W.partitionBy(*KEYS).orderBy(F.desc(F.round("score", 9)), "idx")
    return hits.withColumn("hit_rank", F.row_number().over(best)).filter(F.col("hit_rank") <= options.most_candidates())


def stored_candidates(stored: DataFrame, stats: DataFrame, segments: DataFrame, queries: dict[int, P.Query], options: SearchOptions = SearchOptions()) -> DataFrame:
    """candidates() from a stored index: texts are read, and taken apart, for hits only."""
    scores = P.bm25(P.stored_frequencies(stored, stats, queries))
    own = segments.select("video_id", "idx", "start_s", "end_s", "text")
    hits = scores.join(own, ["video_id", "idx"]).filter(in_range(options.start, options.end))
    best = W.partitionBy(*KEYS).orderBy(F.desc(F.round("score", 9)), "idx")
    top = hits.withColumn("hit_rank", F.row_number().over(best)).filter(F.col("hit_rank") <= options.most_candidates())
    return top.withColumn("tokens", T.tokens(F.col("text")))


def _starts_with(stem: str):
    return lambda token: token.startswith(stem)


def matched_terms(query_id: Column, tokens: Column, queries: dict[int, P.Query]) -> Column:
    """The terms of a row's query that its tokens match, in order of the query."""
    cjk = F.array_join(F.filter(tokens, lambda t: t.rlike(f"^[{T.CJK}]$")), "")
    out: Column = F.array().cast("array<string>")
    for q, query in queries.items():
        found = []
        for t in query.terms:
            if t.cjk:
                hit = F.contains(cjk, F.lit(t.text))
            else:
                hit = F.array_contains(tokens, t.text)
                if t.stem:
                    hit = hit | F.exists(tokens, _starts_with(t.stem))
            found.append(F.when(hit, F.lit(t.text)))
        if found:
            out = F.when(query_id == q, F.array_compact(F.array(*found))).otherwise(out)
    return out


def _by_query(queries: dict[int, P.Query], value) -> Column:
    out = F.lit(None)
    for q, query in queries.items():
        out = F.when(F.col("query_id") == q, F.lit(value(query))).otherwise(out)
    return out


def scored_windows(hits: DataFrame, queries: dict[int, P.Query], options: SearchOptions = SearchOptions()) -> DataFrame:
    """Windows of hits with score, matched, first_idx, last_idx, start_s, end_s.

    A query has a few dozen candidates in a timeline, so they are folded as one array and cut
    into windows there, without a join.
    """
    hit = F.struct("idx", "start_s", "end_s", "score", "tokens")
    lists = hits.groupBy(*KEYS).agg(F.array_sort(F.collect_list(hit), lambda a, b: (a["idx"] - b["idx"]).cast("int")).alias("h"))
    marks = group_marks(F.transform("h", lambda h: F.struct(h["start_s"].alias("s"), h["end_s"].alias("e"))), options.merge_gap, options.max_window)
    cut = lists.withColumn("b", marks).withColumn("b", F.concat("b", F.array(F.size("h") + 1)))
    each = cut.select(*KEYS, F.explode(F.transform(F.sequence(F.lit(1), F.size("b") - 1), lambda i: F.slice("h", F.element_at("b", i), F.element_at("b", i + 1) - F.element_at("b", i)))).alias("w"))
    scores = F.transform("w", lambda h: h["score"])
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    windows = each.select(
        *KEYS, F.size("w").cast("long").alias("hits"), (top + 0.5 * (total - top)).alias("relevance"), F.array_min(F.transform("w", lambda h: h["start_s"])).alias("start_s"), F.array_max(F.transform("w", lambda h: h["end_s"])).alias("end_s"),
        F.element_at("w", 1)["idx"].alias("first_idx"), F.element_at("w", -1)["idx"].alias("last_idx"), F.flatten(F.transform("w", lambda h: h["tokens"])).alias("tokens"),
    )
    windows = windows.withColumn("matched", matched_terms(F.col("query_id"), F.col("tokens"), queries))
    coverage = F.size("matched") / F.greatest(_by_query(queries, lambda q: len(q.terms)).cast("int"), F.lit(1))
    phrase = _by_query(queries, lambda q: " ".join(q.phrase) or None)
    bonus = F.when(phrase.isNotNull() & T.contains_phrase(F.col("tokens"), phrase), 1.25).otherwise(1.0)
    return windows.withColumn("coverage", coverage).withColumn("score", F.col("relevance") * (0.5 + F.col("coverage")) * bonus).drop("tokens")


def ranked(windows: DataFrame, limit: int) -> DataFrame:
    """The best windows, rank from 0, `relative` to the best."""
    order = W.partitionBy(*KEYS).orderBy(F.desc(F.round("score", 9)), "first_idx")
    top = F.max("score").over(W.partitionBy(*KEYS))
    out = windows.withColumn("rank", F.row_number().over(order) - 1).withColumn("relative", F.greatest(F.round(F.col("score") / F.when(top != 0, top).otherwise(1.0), 4), F.lit(0.0001)))
    return out.filter(F.col("rank") < limit)


def search(segments: DataFrame, queries: dict[int, P.Query], options: SearchOptions = SearchOptions(), hits: DataFrame | None = None) -> DataFrame:
    """query_id, video_id, rank, start_s, end_s, score, text, segment_ids, matched for each result.

    hits: candidates(), if they come from elsewhere, as from a stored index.
    """
    hits = candidates(segments, queries, options) if hits is None else hits
    best = ranked(scored_windows(hits, queries, options), options.limit)
    best = best.select(*KEYS, "rank", "relative", "matched", "first_idx", "last_idx", "start_s", "end_s")
    own = segments.select("video_id", "idx", F.col("start_s"), F.col("end_s"), "text")
    if options.expand > 0:
        around = best.withColumn("w_start", F.col("start_s") - options.expand).withColumn("w_end", F.col("end_s") + options.expand).drop("start_s", "end_s")
        rows = overlap_join(around, own, ["video_id"])
    else:
        places = best.drop("start_s", "end_s").withColumn("idx", F.explode(F.sequence("first_idx", "last_idx")))
        rows = places.join(own, ["video_id", "idx"])
    ids = F.transform(F.array_sort(F.collect_list("idx")), lambda i: numbered_id("seg", i))
    return rows.groupBy(*KEYS, "rank").agg(F.min_by("start_s", "idx").alias("start_s"), F.max("end_s").alias("end_s"), F.first("relative").alias("score"), T.join_texts(ordered_texts()).alias("text"), ids.alias("segment_ids"), F.first("matched").alias("matched"))
