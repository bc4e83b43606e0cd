"""C11: from sound files to stored segments.

files -> blocks -> speech probabilities -> regions -> packs -> recognised text -> segments.
Silence never reaches the recogniser, which is a plug-in and is loaded once in each worker.
A folder of files is taken as a stream: a batch of files is committed as one, and a run that was
stopped goes on with the files after its last commit.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import speech as S
from ..operators.chunks import ChunkRules, chunks
from ..sources import media as M
from ..streaming.sinks import RunStore, source_options


# U9, settings by profile, for recognisers that know these names.
PROFILES = {
    "fast": {"model": "base", "compute_type": "auto", "beam_size": 1},
    "balanced": {"model": "small", "compute_type": "auto", "beam_size": 1},
    "accurate": {"model": "medium", "compute_type": "auto", "beam_size": 5},
}


@dataclass(frozen=True)
class Word:
    """A word, in seconds from the start of the pack."""

    start: float
    end: float
    text: str
    probability: float | None = None


@dataclass(frozen=True)
class Heard:
    """What a recogniser found, in seconds from the start of the pack."""

    start: float
    end: float
    text: str
    avg_logprob: float | None = None
    no_speech_prob: float | None = None
    words: tuple[Word, ...] = ()


class Recogniser(Protocol):
    """U2.

    It may have `detect_language(samples) -> (language, probability)`, and
    `transcribe_batch(list of samples, list of languages)` with a `batch_size`.
    """

    identity: str

    def transcribe(self, samples: np.ndarray, language: str | None) -> list[Heard]: ...


@dataclass(frozen=True)
class IngestConfig:
    recogniser: str
    language: str | None = None
    profile: str = "balanced"
    speech: S.SpeechRules = S.SpeechRules()
    pack_seconds: float = 30.0
    first_pack_seconds: float = 10.0
    join_gap: float = 3.0
    detect_language: bool = False

    @property
    def settings(self) -> dict:
        """What the profile asks of a recogniser."""
        return PROFILES[self.profile]

    def key(self) -> str:
        """Rows of runs with different keys never mix."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:24]


def pack_audio(blocks: DataFrame, packed: DataFrame, block_samples: int) -> DataFrame:
    """path, pack, regions, samples: the regions' sound, one after the other.  A pack is at most `pack_seconds` long."""
    b = F.lit(block_samples)
    places = packed.withColumn("seq", F.explode(F.sequence(F.floor(F.col("start_sample") / b), F.floor((F.col("end_sample") - 1) / b))))
    parts = places.join(blocks.select("path", "seq", "samples"), ["path", "seq"])
    first = F.greatest(F.col("start_sample") - F.col("seq") * b, F.lit(0))
    last = F.least(F.col("end_sample") - F.col("seq") * b, F.size("samples"))
    parts = parts.withColumn("part", F.slice("samples", (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")))
    sound = parts.groupBy("path", "pack").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("region", "seq", "part"))), lambda x: x["part"])).alias("samples"))
    regions = S.pack_regions(packed.withColumnRenamed("path", "stream_id")).withColumnRenamed("stream_id", "path")
    return regions.join(sound, ["path", "pack"])


WORDS = "array<struct<start:double,end:double,text:string,probability:double>>"
HEARD = f"path string, pack int, regions array<struct<offset:double,start:double,length:double>>, language string, i int, a double, b double, text string, avg_logprob double, no_speech_prob double, words {WORDS}"
SPOKEN = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("text", pa.string()), ("probability", pa.float64())]))
PARTS = (("start", pa.float64()), ("end", pa.float64()), ("text", pa.string()), ("avg_logprob", pa.float64()), ("no_speech_prob", pa.float64()))


def languages(packs: DataFrame, make: Callable[[], Recogniser]) -> DataFrame:
    """path, language, language_probability: what the recogniser takes the first pack of each file for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make()
        for batch in batches:
            found = [backend.detect_language(np.asarray(x, np.float32)) for x in batch.column("samples").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["path", "language", "language_probability"])

    first = packs.groupBy("path").agg(F.min_by("samples", "pack").alias("samples"))
    return first.mapInArrow(run, "path string, language string, language_probability double")


def hear(backend: Recogniser, sounds: list[np.ndarray], spoken: list[str | None]) -> Iterator[list[Heard]]:
    """What is heard in each sound; as many at a time as a recogniser of batches asks for."""
    together = getattr(backend, "transcribe_batch", None)
    if together is None:
        yield from map(backend.transcribe, sounds, spoken)
        return
    size = max(1, int(getattr(backend, "batch_size", 1)))
    for i in range(0, len(sounds), size):
        yield from together(sounds[i : i + size], spoken[i : i + size])


def recognise(packs: DataFrame, make: Callable[[], Recogniser], language: str | None = None) -> DataFrame:
    """path, start_s, end_s, text, confidence, no_speech_prob, words, language: P5, P6, J9, J10 over what a recogniser hears.

    packs may have a column `language`, which holds where `language` is not given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make()
        for batch in batches:
            names = ["path", "pack", "regions", "language"]
            sounds = [np.asarray(x, np.float32) for x in batch.column("samples").to_pylist()]
            for k, heard in enumerate(hear(backend, sounds, batch.column("language").to_pylist())):
                rows = [batch.column(c).take(pa.array([k] * len(heard), pa.int32())) for c in names]
                rows += [pa.array(range(len(heard)), pa.int32()), *(pa.array([getattr(h, x) for h in heard], t) for x, t in PARTS)]
                rows.append(pa.array([[asdict(w) for w in h.words] for h in heard], SPOKEN))
                yield pa.RecordBatch.from_arrays(rows, names=[*names, "i", "a", "b", "text", "avg_logprob", "no_speech_prob", "words"])

    own = F.col("language") if "language" in packs.columns else F.lit(None)
    given = packs.withColumn("language", F.coalesce(F.lit(language).cast("string"), own.cast("string")))
    heard = given.select("path", "pack", "regions", "language", "samples").mapInArrow(run, HEARD)
    heard = heard.withColumn("text", T.strip(F.col("text"))).filter(F.length("text") > 0).withColumn("at", S.map_span(F.col("regions"), F.col("a"), F.col("b")))

    def placed(w):
        at = S.map_span(F.col("regions"), w["start"], w["end"])
        return F.struct(_rounded(at["start_s"], 1000).alias("start_s"), _rounded(at["end_s"], 1000).alias("end_s"), w["text"].alias("text"), w["probability"].alias("probability"))

    return heard.select(
        "path", "pack", "i", _rounded(F.col("at.start_s"), 1000).alias("start_s"), _rounded(F.col("at.end_s"), 1000).alias("end_s"), "text",
        _rounded(F.exp("avg_logprob"), 10_000).alias("confidence"), _rounded(F.col("no_speech_prob"), 10_000).alias("no_speech_prob"), F.transform("words", placed).alias("words"), "language",
    )


def _rounded(value: Column, parts: int) -> Column:
    return F.rint(value * parts) / parts


def transcribe(files: DataFrame, make: Callable[[], Recogniser], config: IngestConfig, probabilities: Callable[[DataFrame], DataFrame] = M.loudness_windows) -> DataFrame:
    """Segments of sound files (rows of media.files): path, video_id, idx, start_s, end_s, text, confidence, no_speech_prob, words, language, run_key."""
    size = 160 * S.WINDOW
    blocks = M.audio_blocks(files, size / M.RATE)
    windows = probabilities(blocks)
    ids = files.select("path", F.xxhash64("path").alias("stream_id"))
    regions = S.speech_regions(windows.join(ids, "path").select("stream_id", "w", "p"), config.speech)
    packed = S.packs(regions, config.pack_seconds, config.first_pack_seconds, config.join_gap).join(ids, "stream_id").drop("stream_id")
    sound = pack_audio(blocks, packed, size)
    if config.language is None and config.detect_language:
        sound = sound.join(languages(sound, make).select("path", "language"), "path", "left")
    found = recognise(sound, make, config.language)
    order = W.partitionBy("path").orderBy("pack", "i")
    return found.withColumn("idx", (F.row_number().over(order) - 1).cast("long")).select("path", F.xxhash64("path").alias("video_id"), "idx", "start_s", "end_s", "text", "confidence", "no_speech_prob", "words", "language", F.lit(config.key()).alias("run_key"))


def ingest(spark: SparkSession, store: RunStore, folder: str, make: Callable[[], Recogniser], config: IngestConfig, pattern: str = "*", files: int = 64, rules: ChunkRules = ChunkRules(), probabilities: Callable[[DataFrame], DataFrame] = M.loudness_windows) -> int:
    """C11, K1: takes the files of a folder that the run does not have yet, `files` at a time; gives the number of commits.

    A commit has the segments of its files and their chunks.  What was committed is not heard
    again: the checkpoint knows the files, and a restart goes on after the last commit.  The
    store is that of one configuration (O9); a second writer is turned away (ST11).
    """
    done = 0

    def commit(found: DataFrame, batch_id: int) -> None:
        nonlocal done
        segments = transcribe(found, make, config, probabilities)
        store.commit({"segments": segments, "chunks": lambda written: chunks(written["segments"], rules)}, batch_id)
        store.renew()
        done += 1

    stream = spark.readStream.format("binaryFile").schema(M.FILES).option("pathGlobFilter", pattern).options(**source_options(files=files)).load(folder)
    query = stream.writeStream.option("checkpointLocation", f"{store.path}/checkpoint").trigger(availableNow=True).foreachBatch(commit).start()
    query.awaitTermination()
    return done
