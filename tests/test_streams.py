"""A stream gives what the batch gives, whatever the micro-batches."""

import os

import pytest
from pyspark.sql import functions as F

from chronolith.operators import speech as S
from chronolith.operators.chunks import chunks
from chronolith.operators.frames import select_frames
from chronolith.sources import media as M
from chronolith.streaming import operators as O
from chronolith.streaming.sinks import Locked, Progress, RunStore, source_options


def as_stream(spark, df, path, order, n=4):
    """df as n files that a stream takes one by one, in order."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
        for k, f in enumerate(sorted(os.listdir(f"{path}/{i:03d}"))):
            os.utime(f"{path}/{i:03d}/{f}", (1_000_000 + i * 10, 1_000_000 + i * 10))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def finish(spark, stream, tmp_path):
    store = RunStore(spark, str(tmp_path / "run"))
    q = store.write(stream, str(tmp_path / "check"))
    q.awaitTermination()
    return store


def test_chunk_stream(spark, tmp_path):
    segs = [(v, i, 4.0 * i, 4.0 * i + 3.5, "go on." if i % 3 == 0 else "and", i == 29) for v in (1, 2) for i in range(30)]
    df = spark.createDataFrame(segs, "video_id long, idx long, start_s double, end_s double, text string, last boolean")
    store = finish(spark, O.stream_chunks(as_stream(spark, df, str(tmp_path / "in"), "idx")), tmp_path)
    names = ["video_id", "idx", "start_s", "end_s", "text", "first_segment", "last_segment"]
    assert sorted(map(tuple, store.read().select(names).collect())) == sorted(map(tuple, chunks(df.drop("last")).select(names).collect()))


def test_region_stream(spark, tmp_path):
    p = [0.9 if (w // 60) % 2 else 0.1 for w in range(1000)]
    df = spark.createDataFrame([(1, w, v, w == 999) for w, v in enumerate(p)], "stream_id long, w long, p double, last boolean")
    store = finish(spark, O.stream_regions(as_stream(spark, df, str(tmp_path / "in"), "w", 3)), tmp_path)
    want = S.speech_regions(df.drop("last")).select("region", "start_sample", "end_sample")
    assert sorted(map(tuple, store.read().select("region", "start_sample", "end_sample").collect())) == sorted(map(tuple, want.collect()))


def test_pack_stream(spark, tmp_path):
    """Packs as in the batch; with marks of how far sound was heard, an open pack goes as soon as it can."""
    regs = [(1, i, 40_000 * i + (200_000 if i > 12 else 0), 40_000 * i + 30_000 + (200_000 if i > 12 else 0), i == 29) for i in range(30)]
    df = spark.createDataFrame(regs, "stream_id long, region long, start_sample long, end_sample long, last boolean")
    store = finish(spark, O.stream_packs(as_stream(spark, df, str(tmp_path / "in"), "region", 3)), tmp_path)
    batch = S.packs(df.drop("last")).groupBy("stream_id", "pack").agg(F.min("start_sample"), F.max("end_sample"), F.count("*").cast("int"), F.sum(F.col("end_sample") - F.col("start_sample")))
    names = ["stream_id", "pack", "start_sample", "end_sample", "regions", "samples"]
    assert sorted(map(tuple, store.read().select(names).collect())) == sorted(map(tuple, batch.collect()))
    marked = df.withColumn("position", F.col("end_sample") + 200_000).withColumn("frontier", F.col("end_sample") + F.lit(100_000))
    early = finish(spark, O.stream_packs(as_stream(spark, marked, str(tmp_path / "marked"), "region", 3)), tmp_path / "early")
    assert early.read().count() == 30  # nothing joins a region that heard 100,000 samples of silence after it


def test_frame_stream(spark, tmp_path):
    import numpy as np

    rng = [np.random.default_rng(s).integers(0, 255, 64) for s in range(6)]
    rows = [(v, i / 2, i, [int(x) for x in rng[(i // 20 + v) % 6]], i == 119) for v in (1, 2) for i in range(120)]
    df = spark.createDataFrame(rows, "video_id long, t double, frame_id long, pixels array<int>, last boolean")
    store = finish(spark, O.stream_frames(as_stream(spark, df, str(tmp_path / "in"), "t", 3), 8, "screen"), tmp_path)
    want = select_frames(df.drop("last"), 8, "screen").select("video_id", "frame_id", "t", "reason").collect()
    assert len(want) > 6 and sorted(map(tuple, store.read().select("video_id", "frame_id", "t", "reason").collect())) == sorted(map(tuple, want))


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    """Two runs of one query from one checkpoint give what a single one gives; a row that comes too late is an error."""
    segs = [(1, i, 4.0 * i, 4.0 * i + 3.5, "go on." if i % 3 == 0 else "and", i == 29) for i in range(30)]
    df = spark.createDataFrame(segs, "video_id long, idx long, start_s double, end_s double, text string, last boolean")
    store, at = RunStore(spark, str(tmp_path / "run")), str(tmp_path / "in")
    for k, part in enumerate((df.filter("idx < 11"), df.filter("idx >= 11"))):
        part.coalesce(1).write.parquet(f"{at}/{k}")
        source = spark.readStream.schema(df.schema).options(**source_options(files=1)).parquet(f"{at}/*")
        store.write(O.stream_chunks(source), str(tmp_path / "check")).awaitTermination()
    names = ["start_s", "end_s", "text", "first_segment", "last_segment"]
    assert sorted(map(tuple, store.read().select(names).collect())) == sorted(map(tuple, chunks(df.drop("last")).select(names).collect()))
    late = [x[:5] + (False,) for x in segs]
    first, then = (spark.createDataFrame(x, df.schema) for x in (late[5:9], late[2:3]))
    for k, part in enumerate((first, then)):
        part.coalesce(1).write.parquet(f"{at}-late/{k}")
        source = spark.readStream.schema(df.schema).parquet(f"{at}-late/*")
        q = RunStore(spark, str(tmp_path / "late")).write(O.stream_chunks(source), str(tmp_path / "check-late"))
        if k == 0:
            q.awaitTermination()
        else:
            with pytest.raises(Exception, match="came after"):
                q.awaitTermination()


def test_stale_locks_are_taken_over(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "run"))
    store.lock()
    os.utime(tmp_path / "run" / "writer.lock", (1_000_000, 1_000_000))
    store.renew()
    with pytest.raises(Locked):
        store.lock(stale_seconds=3600)
    os.utime(tmp_path / "run" / "writer.lock", (1_000_000, 1_000_000))
    store.lock(stale_seconds=3600)
    with pytest.raises(Locked):
        store.lock(stale_seconds=3600)


def test_commits_are_idempotent_and_locked(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "run"))
    with pytest.raises(FileNotFoundError):
        store.read()
    for _ in range(2):
        store.commit(spark.range(5), 0)
    store.commit(spark.range(3), 1)
    assert store.read().count() == 8
    store.lock()
    with pytest.raises(Locked):
        store.lock()
    store.unlock()
    store.lock()


def test_progress_listener_is_one():
    assert Progress(lambda *_: None).onQueryStarted(None) is None


def tone(path, events, seconds, rate=16_000):
    import math
    import wave

    import numpy as np

    x = np.zeros(seconds * rate)
    for at, f, d in events:
        t = np.arange(int(d * rate)) / rate
        x[int(at * rate) : int(at * rate) + len(t)] = 0.5 * np.sin(2 * math.pi * f * t)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x * 32000).astype("<i2").tobytes())


def test_sound_file_to_regions(spark, tmp_path):
    tone(tmp_path / "a.wav", [(2.0, 440, 3.0), (9.0, 660, 2.0)], 15)
    (tmp_path / "b.wav").write_bytes(b"no sound")
    found = M.files(spark, str(tmp_path), "*.wav")
    probes = {r["path"][-5:]: r for r in M.probe(found).collect()}
    assert probes["a.wav"]["duration"] == 15 and probes["a.wav"]["audio_streams"][0]["sample_rate"] == 16_000 and probes["b.wav"]["error"]
    good = found.filter(F.col("path").endswith("a.wav"))
    windows = M.loudness_windows(M.audio_blocks(good, 5.12)).select(F.lit(1).cast("long").alias("stream_id"), "w", "p")
    got = [(r["start_sample"] / S.RATE, r["end_sample"] / S.RATE) for r in S.speech_regions(windows).orderBy("region").collect()]
    assert got == [pytest.approx((1.8, 5.2), abs=0.05), pytest.approx((8.8, 11.2), abs=0.05)]


def test_sampled_fingerprint():
    import numpy as np

    data = np.random.default_rng(3).integers(0, 256, 8_000_000, dtype=np.uint8).tobytes()
    assert M.sampled_digest(data) == M.sampled_digest(data)
    assert M.sampled_digest(b"x" * 16 + data[16:]) != M.sampled_digest(data)
    assert M.sampled_digest(data, "two streams") != M.sampled_digest(data)
