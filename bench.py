"""Times the headline queries: BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]; prints one JSON line.

A query's time is that of a full run into a sink that drops the rows, after one run over the
smallest tables to start the engine.  `searches_per_s` counts one search as one query over one
timeline that has hits, which is what a single-file engine would be called for.  The total and
the headline queries derive their index in each query; `stored` gives the time to store an index
once, and of the same searches from it.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from chronolith.queries import QUERIES
from chronolith.queries.words import PARSED
from chronolith.sources import tables as S
from chronolith.timeline import Timelines

HEADLINES = ["search_topk", "search_timerange", "context_passages", "bm25_topk", "term_stats", "tokenize_unicode", "chunks", "chunk_backref", "hit_groups", "interval_merge", "interval_join", "asof_event", "vad_regions", "packs", "seam_trim", "frame_select", "export_srt", "best_run", "nest_words", "latency_percentiles"]


def stored(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    with tempfile.TemporaryDirectory() as folder:
        t = Timelines(spark, folder)
        began = time.perf_counter()
        t.index(S.segments(spark, sf_dir))
        indexed = time.perf_counter()
        t.search_all(PARSED).write.format("noop").mode("overwrite").save()
        done = time.perf_counter()
        searches = t.search_all(PARSED).filter("rank = 0").count()
    return {"index_s": round(indexed - began, 3), "search_s": round(done - indexed, 3), "searches": searches, "searches_per_s": round(searches / (done - indexed), 1)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus if cpus != "*" else "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = f"{os.path.dirname(sf_dir.rstrip('/'))}/sf0.001"
    times: dict[str, float] = {}
    for name in HEADLINES:
        if os.path.isdir(warm):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    searches = QUERIES["search_topk"](spark, sf_dir).filter("rank = 0").count()
    from_store = stored(spark, sf_dir)
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "searches_per_s": round(searches / times["search_topk"], 1), "stored": from_store}))
    spark.stop()


if __name__ == "__main__":
    main()
