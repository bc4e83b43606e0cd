"""WARC archives, and a normaliser for archives that were compressed as one gzip stream.

write_records   page rows -> .warc.gz files in the shared folder: every task writes its records
                one after the other into whole-file gzip streams, a new file about every
                `file_bytes`
normalise       archives of whatever gzip layout -> archives with one gzip member a record, each
                with a sidecar index beside it (offset, length, record id, type; one line a
                record).  A file is inflated once, part by part; records are cut from the inflated
                stream by their Content-Length, so neither file is ever held whole
read_records    index and archives -> records, each read from its place (offset, length)

Files are written by the tasks.  A task that is run again writes files of new names, and tables of
names and offsets are committed by Spark, so that what a lost executor left behind is in no table;
readers go by the tables.  The shared folder has to be one that pyarrow opens (a mounted path,
HDFS, S3 or GCS).

Of records with equal payloads of at least `min_bytes`, that with the greatest page_id is the
response; the others are revisit records, which name it and carry no payload.

Defined cases: null html has an empty payload; an empty payload is a response; a null page_id
is written as the id `null` and is smaller than any other; repeated rows are records of their
own, and of repeated greatest rows all are responses; a record is held whole while it is written
or read, whatever its length; an archive that ends early, in a gzip member or in a record, and a
record whose payload is not what its header says are errors; other columns are not read, and may
have any name; an empty table gives no rows and no files.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_folder, open_folder, partitions, remove, skew_safe_lookup

MIN_BYTES = 1000
#: Of records, before compression; a file is what one task normalises at a time.
FILE_BYTES = 32 << 20
PART_BYTES = 1 << 20
ARCHIVES = "file string, records long"
INDEX = "file string, offset long, length long, record_id string, record_type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    uri = re.sub(r"[\r\n]+", " ", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = payload if kind == "response" else b""
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class RecordCutter:
    """Cuts records from pieces of a WARC stream."""

    def __init__(self) -> None:
        self.held = bytearray()

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        at = 0
        while True:
            while self.held[at : at + 2] == b"\r\n":  # blank lines between records
                at += 2
            end = self.held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", self.held[at:end])
            if not m:
                raise ValueError("a WARC record without Content-Length")
            stop = end + 4 + int(m[1])
            if len(self.held) < stop:
                break
            yield bytes(self.held[at:stop]) + b"\r\n\r\n"
            at = stop
        del self.held[:at]

    def close(self) -> None:
        if self.held.strip():
            raise ValueError("the archive ends inside a record")


def inflate(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file given in parts, with one member or many; zeros after a member are padding."""
    z, begun = zlib.decompressobj(31), False
    for data in parts:
        while data := data if begun else data.lstrip(b"\0"):
            begun = True
            out = z.decompress(data, 4 << 20)
            if out:
                yield out
            if z.eof:
                data, z, begun = z.unused_data, zlib.decompressobj(31), False
            else:
                data = z.unconsumed_tail
    if begun:
        raise ValueError("the gzip stream ends inside a member")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, names)], names=[n for n, _ in names])


def resolve(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, body, digest, n_bytes, record_type, refers_to for each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("digest", F.sha1("body")).withColumn("n_bytes", F.octet_length("body").cast("long"))
    copies = rows.filter(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.max("page_id").alias("winner"), F.count("*").alias("copies")).filter("copies > 1")
    copies = materialise(copies, "copies")
    met = skew_safe_lookup(rows, copies, ["digest", "n_bytes"], "copies")
    revisit = F.col("winner").isNotNull() & ~F.col("winner").eqNullSafe(F.col("page_id"))
    return met.select("page_id", "url", "body", "digest", "n_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("winner")).alias("refers_to"))


def write_records(resolved: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes files of whole-file gzip streams into a shared folder; file (its name), records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        task, number, out = TaskContext.get().partitionId(), 0, None
        name, raw, n, z = "", 0, 0, zlib.compressobj(6, wbits=31)

        def close() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            return _batch([(name, n)], ARCHIVES)

        try:
            for b in batches:
                for page_id, url, body, digest, size, kind, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "body", "digest", "n_bytes", "record_type", "refers_to"))):
                    if out is None:
                        name = f"pages-{task:06d}-{number:04d}-{uuid.uuid4().hex[:8]}.warc.gz"
                        out, raw, n, z = files.open_output_stream(f"{base}/{name}", compression=None), 0, 0, zlib.compressobj(6, wbits=31)
                    data = record(kind, page_id, url, body, digest, size, refers)
                    raw, n = raw + len(data), n + 1
                    out.write(z.compress(data))
                    if raw >= file_bytes:
                        yield close()
                        out, number = None, number + 1
            if out is not None:
                yield close()
                out = None
        finally:
            if out is not None:
                out.close()

    return resolved.mapInArrow(run, ARCHIVES)


def _pieces(source) -> Iterator[bytes]:
    while data := source.read(PART_BYTES):
        yield data


def normalise(archives: DataFrame, folder: str, into: str) -> DataFrame:
    """Rewrites the files named in archives (a table of `file`) with one gzip member a record; the index of all records.

    A task takes one file after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        target, place = open_folder(into)
        for b in batches:
            for name in b.column("file").to_pylist():
                new = f"{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
                cutter, offset, rows = RecordCutter(), 0, []
                with files.open_input_stream(f"{base}/{name}", compression=None) as source, target.open_output_stream(f"{place}/{new}", compression=None) as out, target.open_output_stream(f"{place}/{new}.idx", compression=None) as sidecar:
                    for piece in inflate(_pieces(source)):
                        for rec in cutter.feed(piece):
                            h = headers(rec[: rec.index(b"\r\n\r\n")])
                            z = zlib.compressobj(6, wbits=31)
                            member = z.compress(rec) + z.flush()
                            out.write(member)
                            sidecar.write(f"{offset} {len(member)} {h['warc-record-id']} {h['warc-type']}\n".encode())
                            rows.append((new, offset, len(member), h["warc-record-id"], h["warc-type"]))
                            offset += len(member)
                            if len(rows) >= 10_000:
                                yield _batch(rows, INDEX)
                                rows = []
                    cutter.close()
                yield _batch(rows, INDEX)

    return archives.select("file").repartition(max(1, archives.count())).mapInArrow(run, INDEX)


def read_sidecar(spark: SparkSession, into: str) -> DataFrame:
    """The index from the sidecar files of a folder, for archives whose table is not at hand."""
    lines = spark.read.text(f"{into}/*.idx").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.idx$", 1).alias("file"), F.split("value", " ").alias("x"))
    return lines.select("file", F.col("x")[0].cast("long").alias("offset"), F.col("x")[1].cast("long").alias("length"), F.col("x")[2].alias("record_id"), F.col("x")[3].alias("record_type"))


def read_records(index: DataFrame, into: str) -> DataFrame:
    """The records behind an index: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A payload at hand is measured and hashed anew and has to agree with its headers.
    """

    def page(urn: str | None) -> int | None:
        value = (urn or "<urn:page:null>")[10:-1]
        return None if value == "null" else int(value)

    def one(member: bytes) -> tuple:
        z = zlib.decompressobj(31)
        rec = z.decompress(member)
        if not z.eof or z.unused_data:
            raise ValueError("an index entry is not one gzip member")
        end = rec.index(b"\r\n\r\n")
        h, body = headers(rec[:end]), rec[end + 4 : -4]
        size, digest = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")
        if h["warc-type"] == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
            raise ValueError(f"record {h['warc-record-id']} is damaged")
        return page(h["warc-record-id"]), size, digest, h["warc-type"], page(h.get("warc-refers-to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(into)
        name, source = None, None
        try:
            for b in batches:
                out = []
                for own, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))):
                    if own != name:
                        if source:
                            source.close()
                        name, source = own, files.open_input_file(f"{base}/{own}")
                    out.append(one(source.read_at(length, offset)))
                yield _batch(out, RECORDS)
        finally:
            if source:
                source.close()

    many = partitions(index.sparkSession, index.agg(F.sum("length")).first()[0] or 0, PART_BYTES * 16)
    return index.select("file", "offset", "length").repartition(many, "file").sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages as whole-file gzip archives, normalises these, and reads the records back by their offsets."""
    spark = pages.sparkSession
    first, second = new_folder(spark, "archives"), new_folder(spark, "normalised")
    archives = materialise(write_records(resolve(pages, min_bytes), first, file_bytes), "archive-names")
    index = materialise(normalise(archives, first, second), "index")
    remove(spark, first)
    return read_records(index, second)


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM w
"""
