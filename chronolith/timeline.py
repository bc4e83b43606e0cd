"""The front: timelines in a folder, and what one asks of them.

    t = Timelines(spark, "/data/meetings")
    t.index(segments)                       # rows with their timelines
    t.search("why did the deployment fail")
    t.context("why did the deployment fail")
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import export
from .operators import postings as P
from .operators.chunks import ChunkRules, chunks
from .operators.frames import select_frames
from .operators.postings import Query
from .plans import ask as A
from .plans import context as X
from .plans import ingest as G
from .plans import search as Q
from .sources.chat import Model
from .streaming.sinks import RunStore


class NotIndexed(LookupError):
    """There is nothing stored to answer from."""


class Timelines:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise NotIndexed(f"{self.path} has no {name}") from e
            raise

    def index(self, segments: DataFrame, rules: ChunkRules = ChunkRules()) -> None:
        """Stores segments, sorted by timeline and time so that files prune, their chunks, and the index that search reads."""
        ordered = segments.select("video_id", "idx", "start_s", "end_s", "text").repartition("video_id").sortWithinPartitions("video_id", "start_s")
        ordered.write.mode("overwrite").parquet(f"{self.path}/segments")
        chunks(self.transcript(), rules).write.mode("overwrite").parquet(f"{self.path}/chunks")
        indexed = P.index(self.transcript().drop("start_s", "end_s"))
        P.placed(indexed).repartition("bucket", "video_id").sortWithinPartitions("bucket", "term", "video_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        P.corpus_stats(indexed).write.mode("overwrite").parquet(f"{self.path}/stats")

    def index_frames(self, thumbs: DataFrame, width: int, strategy: str = "auto", interval: float = 10.0) -> None:
        if strategy != "off":
            select_frames(thumbs, width, strategy, interval).write.mode("overwrite").parquet(f"{self.path}/frames")

    def run(self, config: G.IngestConfig) -> RunStore:
        """The rows of one configuration; those of others are never mixed in."""
        return RunStore(self.spark, f"{self.path}/runs/{config.key()}")

    def ingest(self, folder: str, make: Callable[[], G.Recogniser], config: G.IngestConfig, pattern: str = "*", files: int = 64, stale_seconds: float | None = 3600.0) -> DataFrame:
        """C11: hears the files of a folder that the run of this configuration does not have, and gives the run's segments.

        A folder that was heard before costs a look at its names.  index() makes the segments searchable.
        """
        store = self.run(config)
        store.lock(stale_seconds)
        try:
            G.ingest(self.spark, store, folder, make, config, pattern, files)
        finally:
            store.unlock()
        return store.read("segments")

    def transcript(self, start: float | None = None, end: float | None = None) -> DataFrame:
        return self._read("segments").filter(Q.in_range(start, end))

    def chunks(self) -> DataFrame:
        return self._read("chunks")

    def frames(self, start: float | None = None, end: float | None = None) -> DataFrame:
        t = F.col("t")
        return self._read("frames").filter((t >= start if start is not None else F.lit(True)) & (t <= end if end is not None else F.lit(True)))

    def search(self, query: str, **options) -> DataFrame:
        """Results of each timeline, best first: rank, start_s, end_s, score, text, segment_ids, matched."""
        return self.search_all({0: Query.parse(query)}, **options).drop("query_id")

    def search_all(self, queries: dict[int, Query], **options) -> DataFrame:
        """search() for several queries in one plan."""
        chosen = Q.SearchOptions(**options)
        hits = Q.stored_candidates(self._read("postings"), self._read("stats"), self.transcript(), queries, chosen)
        return Q.search(self.transcript(), queries, chosen, hits)

    def context(self, query: str, options: X.ContextOptions = X.ContextOptions(), counter: X.TokenCounter = X.count_tokens) -> DataFrame:
        return self._context(self.transcript(), query, options, counter)

    @staticmethod
    def _context(rows: DataFrame, query: str, options: X.ContextOptions, counter: X.TokenCounter = X.count_tokens) -> DataFrame:
        parsed = {0: Query.parse(query)}
        facts = rows.groupBy("video_id").agg(F.max("end_s").alias("duration")).select("video_id", F.col("video_id").cast("string").alias("name"), "duration", F.lit(None).cast("string").alias("language"), F.lit("complete").alias("status"), F.col("duration").alias("indexed_until"))
        return X.assemble(X.passages(rows, parsed, options), facts, parsed, options, counter).drop("query_id")

    def info(self) -> DataFrame:
        rows = self.transcript().groupBy("video_id").agg(F.count("*").alias("segments"), F.max("end_s").alias("duration"))
        return rows.join(self.chunks().groupBy("video_id").agg(F.count("*").alias("chunks")), "video_id", "left")

    def export(self, kind: str) -> DataFrame:
        """kind: srt, vtt, md, txt or json."""
        makers: dict[str, Callable[[DataFrame], DataFrame]] = {"srt": export.to_srt, "vtt": export.to_vtt, "md": export.to_markdown, "txt": export.to_text, "json": export.to_json}
        return makers[kind](self.transcript())

    def ask(self, video_id: int, question: str, model: Model, evidence_tokens: int = 4000, **options) -> A.Answer:
        """C9 over one timeline, which fits the driver."""
        own = self.transcript().filter(F.col("video_id") == video_id)

        def retrieved() -> str:
            rows = self._context(own, question, X.ContextOptions(max_tokens=evidence_tokens)).collect()
            return rows[0]["text"] if rows else "No transcript passages matched this query."

        full = export.to_text(own).first()
        return A.ask(model, question, A.choose_evidence(f"VIDEO: {video_id}", full["txt"] if full else "", retrieved, evidence_tokens), **options)

    def explore(self, video_id: int, question: str, model: Model, **options) -> A.Answer:
        """C10 over one timeline."""
        own = self.transcript().filter(F.col("video_id") == video_id)

        def lines(rows) -> str:
            return "\n".join(f"[{r['start_s']:.1f}-{r['end_s']:.1f}] {r['text']}" for r in rows)

        def search(query: str) -> str:
            found = Q.search(own, {0: Query.parse(query)}, Q.SearchOptions(limit=8, expand=5.0))
            return lines(found.orderBy("rank").collect())

        def read(start: float, end: float) -> str:
            return lines(own.filter(Q.in_range(start, end)).orderBy("idx").collect())

        return A.explore(model, question, f"VIDEO: {video_id}", A.Toolbox(search, read), **options)
