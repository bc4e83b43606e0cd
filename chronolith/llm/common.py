"""Shared pieces of the training-data operators.

Words everywhere are runs of characters other than the six ASCII blanks, which is what
``bytes.split()`` yields, so texts cross to Python as UTF-8 bytes and are never decoded
unless an operator needs code points.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLANKS = b" \t\n\r\x0b\x0c"
WORD = r"[^\x20\x09-\x0D]+"
#: A group with more than one row in this many counts as hot, so at most this many groups are hot.
HOT_GROUPS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Folders made where spark.checkpoint.dir is unset, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset, as in tests."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(context.applicationId)
    if not at:
        at = _OWN[context.applicationId] = tempfile.mkdtemp(prefix="shared-")
    return at.rstrip("/")


def _path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs start from files that survive lost executors.

    The files go when the driver ends, or with discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, at = _path(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table that materialise() wrote, once no later plan reads it."""
    remove(df.sparkSession, df.written_to)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _path(spark, path)
    files.delete(at, True)


def id_crc(column: str | Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit("")).cast("binary"))


def payload(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The named columns and the text as UTF-8 bytes (null: empty); other columns, whatever their names, stay behind."""
    return docs.select(*columns, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes, so that what Python makes of a batch stays small.

    A worker that waits for its next task keeps none of the memory that Arrow held for this one.
    """
    try:
        for b in batches:
            rows = max(1, b.num_rows * most // max(1, b.nbytes))
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        pa.default_memory_pool().release_unused()


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """For actions within: batches for Python have about `most` bytes, where Spark alone makes them of up to 64 MB.

    An executor holds a batch several times over, in Arrow's buffers, as it is sent and in Python.
    """
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def partitions(spark: SparkSession, size: int = 0, most: int = 64 << 20) -> int:
    """The number of shuffle partitions, or as many as leave at most about `most` of `size` bytes in each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // most))


def whole_row(docs: DataFrame) -> Column:
    """Every column of docs as one struct, so that no name of theirs meets one of an operator's."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the folder in it, for the driver and for Python workers."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = _path(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def skew_safe_lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Left-joins rows to a table with one row a key and the number of rows behind each key in `weight`.

    Keys behind more than a thousandth of all rows are at most HOT_GROUPS, so they are
    broadcast.  All others are sort-merge joined; rows already answered get join keys of
    their own there, so that neither a hot key nor a null key gathers in one task.
    `keep`, if given, drops rows of hot keys as soon as they are answered.

    Names of rows and of the table differ but for the keys: callers carry a table of unknown
    columns as one struct.
    """
    values = [c for c in table.columns if c not in keys]
    if clash := {c.lower() for c in rows.columns} & {c.lower() for c in values}:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    total = table.agg(F.sum(weight)).first()[0] or 0
    names = {c: f"__{c}" for c in values}
    renamed = table.select(*keys, *(F.col(c).alias(names[c]) for c in values), F.lit(True).alias("__hit"))
    hot = renamed.filter(F.col(names[weight]) * HOT_GROUPS > F.lit(total))
    cold = renamed.filter(F.col(names[weight]) * HOT_GROUPS <= F.lit(total)).drop("__hit")
    first = rows.join(F.broadcast(hot), keys, "left")
    if keep:
        settled = keep(first.select("*", *(F.col(names[c]).alias(c) for c in values)).filter("__hit")).drop(*values)
        first = settled.unionByName(first.filter("__hit is null"))
    first = first.withColumn("__spread", F.when(F.col("__hit"), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.lit(0)))
    cold = cold.select(*(F.col(k).alias(f"__k_{k}") for k in keys), *(F.col(n).alias(f"{n}_c") for n in names.values()), F.lit(0).cast("long").alias("__zero"))
    on = (F.col("__spread") == F.col("__zero")) & F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__k_{k}"))
    joined = first.join(cold, on, "left")
    out = joined.select(*rows.columns, *(F.coalesce(F.col(names[c]), F.col(f"{names[c]}_c")).alias(c) for c in values))
    return keep(out) if keep else out


def grouped_prefix(df: DataFrame, group: Column, key: Column, value: Column, tie: list[Column], rows_a_slice: int = 50_000) -> DataFrame:
    """Adds `rank` (from 0) and `before`, the sum of value over earlier rows of the group by (key, tie).

    key is a hex digest, even over its range, so its leading 32 bits cut every group into
    slices of about rows_a_slice rows.  Slice totals are summed to offsets in a small table;
    only then is each slice ordered.  No task holds a whole group.
    """
    cols = df.columns
    rows = df.select("*", group.alias("__g"), key.alias("__key"), value.cast("long").alias("__v"))
    rows = rows.withColumn("__h", F.conv(F.substring("__key", 1, 8), 16, 10).cast("long"))
    n = max(partitions(df.sparkSession), -(-df.count() // rows_a_slice))
    rows = rows.withColumn("__slice", F.floor(F.col("__h") * n / F.lit(2**32)))
    sums = rows.groupBy("__g", "__slice").agg(F.sum("__v").alias("__sv"), F.count("*").alias("__sn"))
    order = W.partitionBy("__g").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("__g", "__slice", F.coalesce(F.sum("__sv").over(order), F.lit(0)).alias("__ov"), F.coalesce(F.sum("__sn").over(order), F.lit(0)).alias("__on"))
    inner = W.partitionBy("__g", "__slice").orderBy("__key", *tie)
    ranked = rows.withColumn("__rn", F.row_number().over(inner) - 1).withColumn("__cv", F.sum("__v").over(inner.rowsBetween(W.unboundedPreceding, 0)) - F.col("__v"))
    a, b = ranked.alias("a"), offsets.alias("b")
    out = a.join(b, F.col("a.__g").eqNullSafe(F.col("b.__g")) & (F.col("a.__slice") == F.col("b.__slice")))
    return out.select(*(F.col(f"a.`{c}`") for c in cols), (F.col("b.__on") + F.col("a.__rn")).alias("rank"), (F.col("b.__ov") + F.col("a.__cv")).alias("before"))
