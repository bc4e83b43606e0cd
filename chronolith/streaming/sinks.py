"""Commits of micro-batches, and what readers and watchers see of a run.

K1, ST9: a micro-batch overwrites the folder of its own number, so a batch that is run again
after a failure leaves one copy; the checkpoint says which numbers are done.  ST10: readers see
whole batches only, those with a commit mark, which all tables of a batch share.  ST11: one writer a run, by a lock file that is
created atomically.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Locked(RuntimeError):
    """Another writer holds the run."""


class RunStore:
    """The rows of one processing run in a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _files(self, name: str):
        path = self.hadoop.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def lock(self, stale_seconds: float | None = None) -> None:
        """Takes the run.  A lock that its writer has not renewed for `stale_seconds` is that of a dead one, and is taken over."""
        files, path = self._files("writer.lock")
        if stale_seconds is not None and files.exists(path):
            age = time.time() - files.getFileStatus(path).getModificationTime() / 1000
            if age > stale_seconds:
                # Of several that see it, one renames it away.
                aside = self._files(f"stale-{uuid.uuid4().hex}.lock")[1]
                if files.rename(path, aside):
                    files.delete(aside, False)
        if not files.createNewFile(path):
            raise Locked(self.path)

    def renew(self) -> None:
        files, path = self._files("writer.lock")
        files.setTimes(path, int(time.time() * 1000), -1)

    def unlock(self) -> None:
        files, path = self._files("writer.lock")
        files.delete(path, False)

    def commit(self, tables: DataFrame | dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], batch_id: int) -> None:
        """K1: writes tables (a single one is `rows`), then the mark that makes all of them visible at once.

        A table may be a function of those written before it, which are then read, not computed again.
        """
        files, mark = self._files(f"commits/{batch_id}")
        files.delete(mark, False)
        written: dict[str, DataFrame] = {}
        for name, rows in (tables if isinstance(tables, dict) else {"rows": tables}).items():
            at = f"{self.path}/{name}/batch_id={batch_id}"
            (rows(written) if callable(rows) else rows).write.mode("overwrite").parquet(at)
            written[name] = self.spark.read.parquet(at)
        files.create(mark, True).close()

    def read(self, name: str = "rows") -> DataFrame:
        """Rows of a table in the batches with a commit mark."""
        files, path = self._files("commits")
        marks = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        done = [f"{self.path}/{name}/batch_id={n}" for n in sorted(marks) if n.isdigit()]
        if not done:
            raise FileNotFoundError(self.path)
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*done)

    def write(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Commits a stream.  ST12: what a micro-batch may take is for its source to say (source_options())."""
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda rows, n: self.commit(rows, n))
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def source_options(files: int | None = None, size: str | None = None) -> dict[str, str]:
    """ST12: options of a file source, so that a reader that falls behind takes at most so much at a time."""
    return {k: str(v) for k, v in (("maxFilesPerTrigger", files), ("maxBytesPerTrigger", size)) if v is not None}


class Progress(StreamingQueryListener):
    """U6, ST8: calls back with (batch, rows) after each micro-batch, idle ones included."""

    def __init__(self, callback: Callable[[int, int], None]) -> None:
        self.callback = callback

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.callback(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.callback(-1, 0)

    def onQueryTerminated(self, event) -> None: ...
