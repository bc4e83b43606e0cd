"""Media files as sources.

Files come through Spark's binaryFile reader, so any store that Spark reads will do.  WAV with
16-bit PCM is decoded here; other containers need a decoder plug-in, a callable from bytes to
the same things.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RATE = 16_000
MIB, PROBES, PROBE_BYTES = 1 << 20, 8, 64 << 10
FILES = "path string, modificationTime timestamp, length long, content binary"
PROBE = "path string, container string, duration double, size_bytes long, audio_streams array<struct<index:int,codec:string,sample_rate:int,channels:int,is_default:boolean>>, error string"


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def sampled_digest(content: bytes, signature: str = "") -> str:
    """Size, first and last MiB, eight probes evenly between them, and the stream signature."""
    h = hashlib.blake2b(digest_size=16)
    h.update(struct.pack("<Q", len(content)))
    h.update(content[:MIB])
    h.update(content[-MIB:])
    for i in range(1, PROBES + 1):
        at = len(content) * i // (PROBES + 1)
        h.update(content[at : at + PROBE_BYTES])
    h.update(signature.encode())
    return "s1-" + h.hexdigest()


@F.pandas_udf(StringType())
def _sampled(content: pd.Series, signature: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else sampled_digest(bytes(c), s or "") for c, s in zip(content, signature)])


def fingerprint(content: Column, strict: bool = False, signature: Column | None = None) -> Column:
    """SHA-256 of the whole content, or a digest of samples of it."""
    return F.sha2(content, 256) if strict else _sampled(content, signature if signature is not None else F.lit(""))


def probe(found: DataFrame) -> DataFrame:
    """What a container says of itself, without decoding; files that cannot be read have an error."""

    def one(path: str, content: bytes) -> tuple:
        try:
            with wave.open(io.BytesIO(content)) as w:
                stream = {"index": 0, "codec": f"pcm_s{8 * w.getsampwidth()}le", "sample_rate": w.getframerate(), "channels": w.getnchannels(), "is_default": True}
                return path, "wav", w.getnframes() / w.getframerate(), len(content), [stream], None
        except (wave.Error, EOFError, ZeroDivisionError) as e:
            return path, None, None, len(content), [], str(e) or type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "container", "duration", "size_bytes", "audio_streams", "error"]
        for b in batches:
            yield pd.DataFrame([one(p, c) for p, c in zip(b["path"], b["content"])], columns=names)

    return found.select("path", "content").mapInPandas(run, PROBE)


def decode_wav(content: bytes, rate: int = RATE) -> np.ndarray:
    """16-bit PCM as mono floats at `rate`, by linear interpolation."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("16-bit PCM only")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(1) / 32768.0
        own = w.getframerate()
    n = round(len(x) * rate / own)
    return (x if own == rate else np.interp(np.arange(n) * own / rate, np.arange(len(x)), x)).astype(np.float32)


BLOCKS = "path string, seq long, start_s double, sample_rate int, samples array<float>"


def audio_blocks(found: DataFrame, seconds: float = 5.0, start: float = 0.0, decoder: Callable[[bytes], np.ndarray] = decode_wav) -> DataFrame:
    """Mono blocks of `seconds`, from `start` on; the last may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, int(seconds * RATE))
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                x = decoder(content)[round(start * RATE) :]
                for seq, at in enumerate(range(0, len(x), size)):
                    part = pa.ListArray.from_arrays(pa.array([0, len(x[at : at + size])], pa.int32()), pa.array(x[at : at + size], pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([seq], pa.int64()), pa.array([start + at / RATE]), pa.array([RATE], pa.int32()), part], names=["path", "seq", "start_s", "sample_rate", "samples"])

    return found.select("path", "content").mapInArrow(run, BLOCKS)


def loudness_windows(blocks: DataFrame, window: int = 512, loud: float = 0.02) -> DataFrame:
    """U4 by energy: path, w, p (1 where a window's root mean square is above `loud`), for audio without a speech model."""
    squares = F.transform("samples", lambda x: x.cast("double") * x.cast("double"))
    begin = F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / window).cast("int"))
    own = blocks.select("path", F.col("start_s"), squares.alias("sq"), begin.alias("b")).select("path", "start_s", "sq", F.explode("b").alias("i"))
    part = F.slice("sq", F.col("i") * window + 1, F.lit(window))
    power = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)
    return own.select("path", (F.rint(F.col("start_s") * RATE / window) + F.col("i")).cast("long").alias("w"), F.when(F.sqrt(power) > loud, 1.0).otherwise(0.0).alias("p"))
