"""Inverted index and BM25 over many timelines at once.

The corpus of a timeline is the timeline itself, so counts of documents and mean lengths are
by video_id.  placed() is the index to be stored: places of tokens, in buckets by the letters that
every stem of theirs begins with, so that a query reads the buckets of its words and no others.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Term:
    text: str
    stem: str | None = None
    cjk: bool = False


@dataclass(frozen=True)
class Query:
    """A free-text query as terms and a phrase; `units` are what BM25 scores one by one."""

    text: str
    terms: tuple[Term, ...] = field(default=())
    phrase: tuple[str, ...] = field(default=())

    @classmethod
    def parse(cls, text: str) -> Query:
        """Words but stop words (all words where nothing else is left), then pairs of neighbours in runs of CJK
        characters; the whole as a phrase if it is short and has more than one term."""
        tokens = T.token_list(text)
        words, pairs = [], []
        for cjk, run in groupby(tokens, key=lambda t: T.is_cjk(t[0])):
            if cjk:
                chars = "".join(run)
                pairs += [chars[i : i + 2] for i in range(max(1, len(chars) - 1))]
            else:
                words += run
        stop = set(T.stop_words())
        content = [w for w in words if w not in stop] or words
        terms = (*(Term(w, T.stem_of(w)) for w in dict.fromkeys(content)), *(Term(p, cjk=True) for p in dict.fromkeys(pairs)))
        short = len(terms) > 1 and 1 < len(tokens) <= T.LONGEST_PHRASE
        return cls(text, terms, tuple(tokens) if short else ())

    def units(self) -> list[tuple[str, list[str]]]:
        """(kind, tokens) with kind term, prefix or phrase."""
        out = []
        for t in self.terms:
            out.append(("phrase", list(t.text)) if t.cjk and len(t.text) > 1 else ("term", [t.text]))
            if t.stem:
                out.append(("prefix", [t.stem]))
        return out + ([("phrase", list(self.phrase))] if self.phrase else [])

    def expression(self) -> str:
        """The query as an FTS5 MATCH text, quotes doubled."""

        def quoted(words: list[str]) -> str:
            return '"' + " ".join(words).replace('"', '""') + '"'

        return " OR ".join(quoted(words) + (" *" if kind == "prefix" else "") for kind, words in self.units())


def index(segments: DataFrame) -> DataFrame:
    """segments with `tokens` and their number `dl`."""
    return segments.withColumn("tokens", T.tokens(F.col("text"))).withColumn("dl", F.size("tokens"))


def postings(indexed: DataFrame) -> DataFrame:
    """video_id, idx, term, tf."""
    return indexed.select("video_id", "idx", F.explode("tokens").alias("term")).groupBy("video_id", "idx", "term").agg(F.count("*").alias("tf"))


def corpus_stats(indexed: DataFrame) -> DataFrame:
    """video_id, n_docs, avgdl."""
    return indexed.groupBy("video_id").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


BUCKETS = 64


def bucket_of(term: Column) -> Column:
    """The same for a word and for all stems that it begins with."""
    return F.pmod(F.xxhash64(F.left(term, F.lit(T.SHORTEST_STEM))), F.lit(BUCKETS)).cast("int")


def placed(indexed: DataFrame) -> DataFrame:
    """A12, to be stored by bucket: video_id, idx, dl, term, places (from 0, ascending), bucket."""
    each = indexed.select("video_id", "idx", "dl", F.posexplode("tokens").alias("place", "term"))
    own = each.groupBy("video_id", "idx", "term").agg(F.first("dl").alias("dl"), F.array_sort(F.collect_list("place")).alias("places"))
    return own.withColumn("bucket", bucket_of(F.col("term")))


def stored_frequencies(stored: DataFrame, stats: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """unit_frequencies() of an index with stats, from placed() and corpus_stats() as they were stored: video_id, idx, dl, n_docs, avgdl, query_id, unit, tf."""
    spark = stored.sparkSession
    specs = [(q, u, kind, words) for q, query in queries.items() for u, (kind, words) in enumerate(query.units())]
    words = sorted({w for *_, own in specs for w in own})
    if not words:
        return stored.limit(0).join(stats, "video_id").select("video_id", "idx", "dl", "n_docs", "avgdl", F.lit(0).alias("query_id"), F.lit(0).alias("unit"), F.lit(0).cast("long").alias("tf"))
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(bucket_of(F.col("w"))).distinct().collect()]
    own = stored.filter(F.col("bucket").isin(buckets))
    keys = ["video_id", "idx", "dl"]

    def single(kind: str) -> list[Column]:
        return [F.when((F.col("term") == w[0]) if k == "term" else F.startswith("term", F.lit(w[0])), F.struct(F.lit(q).alias("query_id"), F.lit(u).alias("unit"))) for q, u, k, w in specs if k == kind]

    met = own.select(*keys, F.size("places").alias("n"), F.explode(F.array_compact(F.array(*single("term"), *single("prefix")).cast("array<struct<query_id:int,unit:int>>"))).alias("u"))
    found = met.groupBy(*keys, "u").agg(F.sum("n").alias("tf")).select(*keys, "u.query_id", "u.unit", F.col("tf").cast("long").alias("tf"))
    for q, u, _, run in (x for x in specs if x[2] == "phrase"):
        at = own.filter(F.col("term").isin(run)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("m")).filter(F.size("m") == len(set(run)))
        begin = F.try_element_at("m", F.lit(run[0]))
        for i, w in enumerate(run[1:], 1):
            begin = F.array_intersect(begin, F.transform(F.try_element_at("m", F.lit(w)), _back(i)))
        found = found.unionByName(at.select(*keys, F.lit(q).alias("query_id"), F.lit(u).alias("unit"), F.size(begin).cast("long").alias("tf")).filter("tf > 0"))
    return found.join(stats, "video_id")


def _back(i: int):
    return lambda place: place - i


def query_units(spark: SparkSession, queries: dict[int, Query]) -> DataFrame:
    rows = [(q, u, kind, words) for q, query in queries.items() for u, (kind, words) in enumerate(query.units())]
    return spark.createDataFrame(rows, "query_id int, unit int, kind string, words array<string>")


#: Up to so many units, each is counted on a segment's tokens where they are; more are joined to exploded tokens.
COUNTED_IN_PLACE = 64


def unit_frequencies(indexed: DataFrame, queries: dict[int, Query], kinds: tuple[str, ...] = ("term", "prefix", "phrase")) -> DataFrame:
    """query_id, unit, tf beside the columns of indexed, for segments in which a unit of a query occurs.

    Counting in place moves nothing, so what follows by timeline stays where the timeline is.
    """
    specs = [(q, u, kind, words) for q, query in queries.items() for u, (kind, words) in enumerate(query.units()) if kind in kinds]
    if not specs or len(specs) > COUNTED_IN_PLACE:
        return _joined_frequencies(indexed, query_units(indexed.sparkSession, queries), kinds)

    def times(kind: str, words: list[str]) -> Column:
        if kind == "phrase":
            return T.phrase_count(F.col("tokens"), F.array(*map(F.lit, words)))
        return F.size(F.filter("tokens", lambda t: t.startswith(words[0]) if kind == "prefix" else t == words[0]))

    counts = F.array(*(F.struct(F.lit(q).alias("query_id"), F.lit(u).alias("unit"), times(kind, words).cast("long").alias("tf")) for q, u, kind, words in specs))
    # Most segments have none of the words: one look spares the counting.
    heads = sorted({words[0] for _, _, kind, words in specs if kind != "prefix"})
    stems = [words[0] for _, _, kind, words in specs if kind == "prefix"]
    some = F.arrays_overlap("tokens", F.array(*map(F.lit, heads))) if heads else F.lit(False)
    for stem in stems:
        some = some | F.exists("tokens", _begins(stem))
    found = indexed.filter(some).select("*", F.explode(F.filter(counts, lambda c: c["tf"] > 0)).alias("__u"))
    return found.select(*indexed.columns, "__u.query_id", "__u.unit", "__u.tf")


def _begins(stem: str):
    return lambda token: token.startswith(stem)


def _joined_frequencies(indexed: DataFrame, units: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The same for many queries at once, by one equi join of exploded tokens.

    A token is looked up as it is and by its first letters, as many as the shortest stem has; a
    phrase is looked up by its longest word and counted in the segments that have it.
    """
    head = T.SHORTEST_STEM
    first = F.get("words", F.lit(0))
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    at = F.when(F.col("kind") == "prefix", F.concat(F.lit("^"), F.left(first, F.lit(head)))).otherwise(F.concat(F.lit("="), F.when(F.col("kind") == "phrase", longest).otherwise(first)))
    wanted = units.filter(F.col("kind").isin(*kinds)).select("query_id", "unit", "kind", "words", at.alias("at"))
    words = indexed.select("video_id", "idx", F.explode("tokens").alias("term"))
    keys = F.array(F.concat(F.lit("="), "term"), F.concat(F.lit("^"), F.left("term", F.lit(head))))
    met = words.select("video_id", "idx", "term", F.explode(keys).alias("at")).join(wanted, "at")
    met = met.filter((F.col("kind") != "prefix") | F.startswith("term", first))
    found = met.groupBy("query_id", "unit", "video_id", "idx").agg(F.count("*").alias("tf"), F.first("kind").alias("kind"), F.first("words").alias("words"))
    out = indexed.join(found, ["video_id", "idx"]).withColumn("tf", F.when(F.col("kind") == "phrase", T.phrase_count(F.col("tokens"), F.col("words")).cast("long")).otherwise(F.col("tf")))
    return out.filter("tf > 0").select(*indexed.columns, "query_id", "unit", "tf")


def with_stats(indexed: DataFrame) -> DataFrame:
    """indexed with n_docs and avgdl of its timeline on every row."""
    own = W.partitionBy("video_id")
    return indexed.withColumn("n_docs", F.count("*").over(own)).withColumn("avgdl", F.avg("dl").over(own))


def bm25(found: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """M7: query_id, video_id, idx, score (higher is better), and columns of a segment to carry along.

    found: unit_frequencies() of an index with stats.
    """
    n = F.count("*").over(W.partitionBy("video_id", "query_id", "unit"))
    idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = F.when(idf > 0, idf).otherwise(1e-6) * F.col("tf") * (K1 + 1) / norm
    return found.withColumn("n", n).groupBy("query_id", "video_id", "idx").agg(F.sum(part).alias("score"), *(F.first(c).alias(c) for c in carry))
