"""Queries that do the whole of what others do for a part."""

from pyspark.sql import functions as F

from chronolith.queries import QUERIES
from chronolith.sources import tables as S

DATA = "/root/testdata/sf0.001"


def test_passages_are_found_by_any_part(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(30))
    short = "four words are enough"
    w = passage.split()
    docs = [(1, "so " + " ".join(w[11:22]) + " it ends"), (2, "Word0 " + " ".join(w[1:])), (3, " ".join(w[:7]) + " stop"), (4, f"here {short}\nas well"), (5, None), (6, passage + "\n" + short)]
    spark.createDataFrame([(1, passage), (2, short), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["video_id"]: r["items"] for r in QUERIES["passage_quotes"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 6: 2}


def test_every_window_is_assigned(spark):
    """All windows from the first pack of a stream on."""
    every = {(r["stream_id"], r["w"]): r["pack"] for r in QUERIES["batch_assignment"](spark, DATA).collect()}
    first = {}
    for stream, w in every:
        first[stream] = min(first.get(stream, w), w)
    last = {r["stream_id"]: r["w"] for r in S.speech_windows(spark, DATA).groupBy("stream_id").agg(F.max("w").alias("w")).collect()}
    assert every.keys() == {(s, w) for s, a in first.items() for w in range(a, last[s] + 1)}


def test_windows_from_every_segment(spark):
    segments = {(r["video_id"], r["idx"]) for r in S.segments(spark, DATA).collect()}
    for name, key in (("interval_join", "idx"), ("expand_join", "win"), ("index_range_join", "first_idx")):
        assert {(r["video_id"], r[key]) for r in QUERIES[name](spark, DATA).collect()} == segments, name
    found = QUERIES["asof_frame"](spark, DATA)
    assert found.count() == S.thumbnails(spark, DATA).count() and found.filter("frame_id is null").count() > 0
