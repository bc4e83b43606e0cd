"""Sharding with size-tiered compaction.

append    arriving rows become small immutable shards: a task starts a new shard whenever the
          one it fills reaches `small` bytes of text.  No shuffle.
plan      shards of one size tier (powers of `fanin` over `small`) are put in runs where their
          running size crosses a multiple of `target`; a run of `fanin` shards or more, or of two
          or more that fill half a target, is merged, all others wait for more of their size.  A
          shard of half a target or more is done.  Running sizes are sums over slices, in the engine.
compact   runs are rewritten as shards of at most about `target`; what a merge makes is of a higher
          tier, where it may be merged with its like, so passes go on until no tier has a run.
commit    a new manifest version appears under its name at once or not at all, and not if that
          version exists, so of two writers one has to start over from the new version.

A manifest is a small file that names tables: live shards with their folder, size and rows, and
retired ones.  Readers take the newest, and files of older versions stay until vacuum().

Layout of a store: data/<folder>/shard=<name>/*.parquet, tables/<folder>, manifest/<version>.json.
A shard's rows are (row, bytes): all columns of a row as one struct.

Defined cases: rows of any content are kept as they are, nulls, repeated rows and extra columns of
any name included; a text longer than a shard has one of its own; ties in size are ordered by the
MD5 of the shard's name; an empty arrival leaves a version without new shards.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import grouped_prefix, new_folder, whole_row

SMALL = 1 << 20
TARGET = 16 << 20
FANIN = 4
ARRIVALS = 2
SHARDS = "shard string, folder string, bytes long, rows long"
DELETERS = 16


class Store:
    """A versioned set of shards in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self.fs.Path("/".join((self.path, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.conf)

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        at = self._path("manifest")
        if not self._files().exists(at):
            return 0
        return max([0, *(int(s.getPath().getName()[:8]) for s in self._files().listStatus(at) if s.getPath().getName().endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        """version; folders: the schema of the rows in each; live and retired: tables of shards."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "folders": {}, "live": [], "retired": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version:08d}.json", wholetext=True).first()[0])

    def commit(self, manifest: dict, after: int) -> int:
        """Makes version after + 1, if nobody has."""
        files, new = self._files(), after + 1
        aside, to = self._path("manifest", f".{uuid.uuid4().hex}"), self._path("manifest", f"{new:08d}.json")
        out = files.create(aside, False)
        out.write(bytearray(json.dumps(manifest | {"version": new}).encode()))
        out.close()
        if files.getUri().getScheme() == "file":  # a rename would replace; a second link to a name fails
            try:
                os.link(aside.toUri().getPath(), to.toUri().getPath())
                done = True
            except FileExistsError:
                done = False
            files.delete(aside, False)
        else:  # where a rename onto a file that exists fails, as on HDFS
            done = files.rename(aside, to)
            if not done:
                files.delete(aside, False)
        if not done:
            raise RuntimeError(f"version {new} was committed by another writer")
        return new

    def _table(self, name: str, rows: DataFrame) -> str:
        at = f"{self.path}/tables/{name}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(at)
        return at

    def _tables(self, paths: list[str], schema: str = SHARDS) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def shards(self, version: int | None = None) -> DataFrame:
        """The live shards: shard, folder, bytes, rows."""
        return self._tables(self.manifest(version)["live"])

    def _rows(self, folders: dict) -> DataFrame | None:
        """row, bytes, shard of everything in some folders."""
        out = None
        for folder, kind in folders.items():
            schema = T.StructType([T.StructField("row", T.StructType.fromJson(kind)), T.StructField("bytes", T.LongType()), T.StructField("shard", T.StringType())])
            rows = self.spark.read.option("basePath", folder).schema(schema).parquet(folder)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def rows(self, version: int | None = None) -> DataFrame | None:
        """The live rows: row, bytes, shard."""
        own = self.manifest(version)
        out = self._rows(own["folders"])
        if out is None or not own["retired"]:
            return out
        return out.join(self._tables(own["live"]).select("shard"), "shard", "left_semi").select("row", "bytes", "shard")

    def read(self, version: int | None = None) -> DataFrame | None:
        rows = self.rows(version)
        return None if rows is None else rows.select("row.*")

    def _write(self, rows: DataFrame, folder: str) -> str:
        """Writes (row, bytes, shard) and gives the table of what shards there are now."""
        rows.write.option("compression", "zstd").partitionBy("shard").parquet(folder)
        schema = T.StructType([T.StructField("bytes", T.LongType()), T.StructField("shard", T.StringType())])
        written = self.spark.read.option("basePath", folder).schema(schema).parquet(folder)
        return self._table("live", written.groupBy("shard").agg(F.lit(folder).alias("folder"), F.sum("bytes").alias("bytes"), F.count("*").alias("rows")))

    def _folder(self, version: int) -> str:
        return f"{self.path}/data/{version:08d}-{uuid.uuid4().hex[:8]}"

    def append(self, docs: DataFrame, small: int = SMALL, text: str = "text") -> int:
        """Adds rows as small shards and commits."""
        old = self.manifest()
        folder, tag = self._folder(old["version"] + 1), f"a{old['version'] + 1:08d}"
        rows = docs.select(whole_row(docs), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, filled, number = TaskContext.get().partitionId(), 0, 0
            for b in batches:
                names = []
                for s in b.column("bytes").to_pylist():
                    if filled and filled + s > small:
                        filled, number = 0, number + 1
                    filled += s
                    names.append(f"{tag}-{task:06d}-{number:06d}")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string())], names=["row", "bytes", "shard"])

        schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.StringType())])
        live = self._write(rows.mapInArrow(run, schema), folder)
        kind = json.loads(rows.schema["row"].dataType.json())
        return self.commit(old | {"folders": old["folders"] | {folder: kind}, "live": [*old["live"], live]}, old["version"])

    def compact(self, target: int = TARGET, fanin: int = FANIN, small: int = SMALL) -> int:
        """Merges runs of similarly sized shards, and what comes of it, until no tier has a run; a commit a pass."""
        while True:
            old = self.manifest()
            tag = f"c{old['version'] + 1:08d}"
            merges = self._table("merges", plan(self._tables(old["live"]), target, fanin, small, tag))
            merges = self._tables([merges], "shard string, into string, folder string, bytes long, rows long")
            size = merges.agg(F.sum("bytes")).first()[0]
            if size is None:
                return old["version"]
            folder = self._folder(old["version"] + 1)
            touched = {r["folder"] for r in merges.select("folder").distinct().collect()}
            moved = self._rows({f: k for f, k in old["folders"].items() if f in touched})
            # The filter is always true; with one, Spark lets the merges prune the folders of other shards.
            moved = moved.join(merges.filter("bytes >= 0").select("shard", "into"), "shard").select("row", "bytes", F.col("into").alias("shard"))
            # A task has about one new shard, whatever the size of the store, and writes it as one file.
            live = self._write(moved.repartition(max(1, -(-size // target)), "shard"), folder)
            stay = self._table("live", self._tables(old["live"]).join(merges, "shard", "left_anti"))
            gone = self._table("retired", merges.select("shard", "folder", "bytes", "rows"))
            kind = json.loads(moved.schema["row"].dataType.json())
            self.commit({"folders": old["folders"] | {folder: kind}, "live": [stay, live], "retired": [*old["retired"], gone]}, old["version"])

    def vacuum(self) -> int:
        """Deletes what the newest version does not use: retired shards, a whole folder at once where none in it is live; gives their number."""
        files, own = self._files(), self.manifest()
        if not own["version"]:
            return 0
        # The newest folder stays, as the columns are known from it, even with no shard live.
        used = {r["folder"] for r in self._tables(own["live"]).select("folder").distinct().collect()} | set([*own["folders"]][-1:])
        dead = [f for f in own["folders"] if f not in used]
        gone = self._tables(own["retired"])
        single = gone.filter(~F.col("folder").isin(dead)) if dead else gone
        n = gone.count()
        with ThreadPoolExecutor(DELETERS) as pool:
            drop = lambda at: files.delete(self.fs.Path(at), True)
            list(pool.map(drop, dead))
            list(pool.map(drop, (f"{r['folder']}/shard={r['shard']}" for r in single.toLocalIterator())))
        newest = self.commit(own | {"folders": {f: k for f, k in own["folders"].items() if f in used}, "retired": []}, own["version"])
        for s in files.listStatus(self._path("manifest")):
            if s.getPath().getName() < f"{newest:08d}":
                files.delete(s.getPath(), False)
        return n


def plan(shards: DataFrame, target: int, fanin: int, small: int, tag: str) -> DataFrame:
    """shard, into, folder, bytes, rows: for shards to be merged, the name of the new shard.

    Metadata of shards only; no task sorts a tier.
    """
    tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(small)) / F.lit(float(small))) / F.log(F.lit(float(fanin))) + 1e-9)
    rows = shards.filter(F.col("bytes") * 2 < target).withColumn("tier", tier)
    placed = grouped_prefix(rows, F.col("tier"), F.md5("shard"), F.col("bytes"), [F.col("shard")])
    placed = placed.withColumn("run", F.floor(F.col("before") / target))
    runs = placed.groupBy("tier", "run").agg(F.count("*").alias("members"), F.sum("bytes").alias("run_bytes"))
    runs = runs.filter((F.col("members") >= fanin) | ((F.col("members") > 1) & (F.col("run_bytes") * 2 >= target)))
    return placed.join(runs.select("tier", "run"), ["tier", "run"]).select("shard", F.format_string(f"{tag}-%02d-%08d", F.col("tier"), F.col("run")).alias("into"), "folder", "bytes", "rows")


def shard_documents(docs: DataFrame, path: str | None = None, small: int = SMALL, target: int = TARGET, fanin: int = FANIN, arrivals: int = ARRIVALS) -> DataFrame:
    """Appends docs to a new store in `arrivals` parts, compacts after each, and reads it back: doc_id, shard, version, shard_rows, shard_bytes for every row."""
    spark = docs.sparkSession
    store = Store(spark, path or new_folder(spark, "shards"))
    part = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.filter(part == k), small)
        store.compact(target, fanin, small)
    store.vacuum()
    sizes = store.shards().select("shard", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    rows = store.rows().select(F.col("row.doc_id").cast("long").alias("doc_id"), "shard")
    return rows.join(sizes, "shard").select("doc_id", "shard", F.lit(store.version()).cast("long").alias("version"), "shard_rows", "shard_bytes")
