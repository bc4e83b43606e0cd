"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles, as 64-bit hashes.  Two sets of n and m
tokens with Jaccard similarity t or more have a = ceil(t (n + m) / (1 + t)) tokens in common,
and if both are ordered by the same total order they share l tokens among the first n - a + l
of one and m - a + l of the other, for any l.  Each document takes the l that lowers its
estimated cost: the other sets on the postings of its prefix, and the candidates to verify, of
which there can be at most that number divided by l.  A pair then has to share the lesser of
its two l's.

The order is by how often a token occurs, rarest first, from counts in 2 ** SKETCH_BITS
buckets over all documents (a fixed size; one byte a bucket is broadcast), then by hash.

Only components are asked for, so links inside a known component need no verification:
1. sets are folded to one for each distinct content;
2. for each prefix token one set is the hub, that whose prefix is met by most others, so that
   originals come before their edited copies; each set meets the hub it has most tokens in
   common with (a star, not all pairs); verified links give a first partition;
3. tokens whose sets lie in more than one part make candidate pairs across parts, the token's
   most frequent part being on one side at most; a pair is made at the first token it has in
   common, if it has as many as it asks for, and all of these are verified.
Any link joins sets that are in one part after 2, or are a candidate in 3, so none is lost.

Where a token, a hub or a set is behind many rows, these are dealt over salts, and what they meet
goes to every salt once; each pair still meets in exactly one place.  Sizes of what is sent to all
tasks: the sketch, 2 ** SKETCH_BITS bytes; the filter of ids, at most 2 ** FILTER_BITS bits.

Defined cases: null and blank texts have an empty set and are linked with nothing; texts of
fewer words than a shingle are one shingle; a component of null ids only has a null id;
repeated rows are in one component, and dedup_documents keeps one of them; texts of any length
give all their shingles; of sets that could be a hub or give a component its id alike, the order
of numbers and ids decides; other columns are not read, and those that dedup_documents hands on
may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, partitions, payload, skew_safe_lookup, slices, small_batches, whole_row
from .components import components

SKETCH_BITS = 24
CHUNKS = 64
#: The sketches of so many tasks are added by one task, and of these again, in LEVELS steps.
TREE_BITS, LEVELS = 6, 3
MOST_MATCHES = 8
VERIFY_WEIGHT = 20.0
WORD_HASHES = 300_000
#: The filter of ids has 16 bits an id, as long as that is within so many bits (8 an id for 10 ** 8 of them); with more ids it lets more sets through, and loses none.
FILTER_BITS = 30
FILTER_CHUNK_BITS = 20
#: Rows of one token, or pairs of one hub, for each salt.
SALT_ROWS = 500
#: Of each prefix so many tokens go along with candidates at most; pairs that need more are counted after the join.
HEAD = 64
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_HASHES:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes, width: int, hashes: _Hashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.lower().split()
    n = len(words)
    if n < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)] if words else [], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    x = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        x += h[j : n - width + 1 + j] * FACTORS[j % len(FACTORS)] ^ np.uint64(j)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return np.unique(x)


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(s.tobytes())


def packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash; a chance match adds to an overlap once in some 10 ** 9 pairs and never takes from it."""
    return (s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def frequency_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """log2 of the number of sets with a token in each bucket, in eighths: one byte a bucket.

    Every task counts into a sketch of its own; these are added chunk by chunk in a tree, so no
    task adds more than 2 ** TREE_BITS of them.
    """
    buckets = 1 << SKETCH_BITS
    own = buckets // CHUNKS
    schema = "task long, chunk int, data binary"

    def rows(task: int, chunks: list[int], parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([task] * len(chunks), pa.int64()), pa.array(chunks, pa.int32()), pa.array(parts, pa.binary())], names=["task", "chunk", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(buckets, np.uint32), _Hashes()
        for b in slices(batches):
            held: list[np.ndarray] = []
            for t in b.column("text").to_pylist():
                held.append(shingles(t, width, hashes) >> np.uint64(64 - SKETCH_BITS))
            if held:
                at, n = np.unique(np.concatenate(held), return_counts=True)
                total[at.astype(np.int64)] += n.astype(np.uint32)
        if total.any():
            yield rows(TaskContext.get().partitionId(), list(range(CHUNKS)), [zlib.compress(total[i * own : (i + 1) * own].astype(np.uint64).tobytes(), 1) for i in range(CHUNKS)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            for task, chunk, data in zip(*(b.column(c).to_pylist() for c in ("task", "chunk", "data"))):
                part = np.frombuffer(zlib.decompress(data), np.uint64)
                if at == (task, chunk):
                    total += part
                    continue
                if at:
                    yield rows(at[0], [at[1]], [zlib.compress(total.tobytes(), 1)])
                at, total = (task, chunk), part.copy()
        if at:
            yield rows(at[0], [at[1]], [zlib.compress(total.tobytes(), 1)])

    parts = payload(docs).mapInArrow(count, schema)
    for level in range(LEVELS):
        task = F.shiftright("task", TREE_BITS) if level < LEVELS - 1 else F.lit(0).cast("long")
        parts = parts.withColumn("task", task).repartition(partitions(docs.sparkSession), "task", "chunk").sortWithinPartitions("task", "chunk").mapInArrow(add, schema)
    out = np.zeros(buckets, np.uint8)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.frombuffer(zlib.decompress(x), np.uint64) for x in b.column("data").to_pylist()]
            yield rows(0, b.column("chunk").to_pylist(), [zlib.compress(np.minimum(255, np.round(8 * np.log2(1.0 + v))).astype(np.uint8).tobytes(), 1) for v in got])

    for r in parts.mapInArrow(levels, schema).collect():
        out[r["chunk"] * own : (r["chunk"] + 1) * own] = np.frombuffer(zlib.decompress(bytes(r["data"])), np.uint8)
    return out


def noise(sketch: np.ndarray) -> float:
    """What a bucket holds of other tokens: the mean and two deviations."""
    # Levels are counted chunk by chunk: as floating point the whole sketch takes eight times its bytes, and more than once.
    levels = sum(np.bincount(part, minlength=256) for part in np.array_split(sketch, CHUNKS))
    mean = float(levels @ (2.0 ** (np.arange(256) / 8.0) - 1.0)) / len(sketch)
    return mean + 2 * mean**0.5


def prefix(s: np.ndarray, sketch: np.ndarray, percent: int, floor: float = 0.0) -> tuple[int, float, np.ndarray]:
    """The number of matches that a set asks for, the estimated number of others its prefix meets, and the prefix."""
    n = len(s)
    level = sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    least = -(-percent * n // 100)
    longest = min(n, n - least + MOST_MATCHES)
    # Levels ascending, hashes ascending within: s is sorted, so a stable sort does it.
    order = np.argsort(level, kind="stable")[:longest]
    others = np.cumsum(np.maximum(0.0, 2.0 ** (level[order] / 8.0) - 2.0 - floor))
    m = np.arange(1, min(MOST_MATCHES, least) + 1)
    lists = others[n - least + m - 1]
    best = int(m[np.argmin(lists + VERIFY_WEIGHT * lists / m)])
    return best, float(lists[best - 1]), s[order[: n - least + best]]


def _keyed(docs: DataFrame, width: int) -> DataFrame:
    """Columns row (all of docs), id, key and n (of the shingle set)."""
    frame = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in slices(batches):
            sets = [shingles(t, width, hashes) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], names=["row", "id", "key", "n"])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:2], T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType())]))


def _id_filter(ids: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """A Bloom filter over n ids (the column doc_id): its number of bits as a power of two, and the bits.

    Places go to the task of their chunk, so what a task makes is as large as its chunks.
    """
    bits = min(FILTER_BITS, max(FILTER_CHUNK_BITS, (16 * n).bit_length()))
    own = 1 << (FILTER_CHUNK_BITS - 3)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_places(b.column("doc_id"), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> FILTER_CHUNK_BITS, pa.int32()), pa.array(at & ((1 << FILTER_CHUNK_BITS) - 1), pa.int32())], names=["chunk", "place"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for b in batches:
            chunk, at = (b.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "place"))
            for i in np.unique(chunk).tolist():
                mine = at[chunk == i]
                np.bitwise_or.at(chunks.setdefault(i, np.zeros(own, np.uint8)), mine >> 3, np.left_shift(1, mine & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in chunks.values()], pa.binary())], names=["chunk", "data"])

    found = np.zeros(1 << (bits - 3), np.uint8)
    dealt = ids.mapInArrow(places, "chunk int, place int").repartition(1 << min(8, bits - FILTER_CHUNK_BITS), "chunk")
    for r in dealt.mapInArrow(build, "chunk int, data binary").collect():
        found[r["chunk"] * own : (r["chunk"] + 1) * own] = np.frombuffer(zlib.decompress(bytes(r["data"])), np.uint8)
    return bits, found


def _places(ids: pa.Array, bits: int) -> list[np.ndarray]:
    """The two places of each id; a null id has those of -1."""
    x = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    out = []
    for factor in FACTORS[:2]:
        y = (x + np.uint64(1)) * factor
        y ^= y >> np.uint64(29)
        out.append((y * FACTORS[3] >> np.uint64(64 - bits)).astype(np.int64))
    return out


def _salts(rows: Column) -> Column:
    return F.ceil(rows / SALT_ROWS).cast("int")


def _own_salt(by: Column, salts: Column) -> Column:
    return F.pmod(F.xxhash64(by), salts).cast("int")


def _every_salt(salts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), salts - 1))


def _verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose similarity reaches the threshold.

    Texts are not shuffled: the ids of the sets wanted pass a Bloom filter to the scan, which
    hands on the sets of the documents that it lets through.  A set's tokens go once to its key,
    and from there, as a, to b.  Hubs are b, so the pairs of one b are dealt over salts.
    """

    def end(side: str) -> DataFrame:
        n = pairs.groupBy(side).agg(F.count("*").alias(f"{side}_n"))
        return materialise(n.join(sets.select(F.col("sid").alias(side), F.col("key").alias(f"{side}_key"), F.col("doc_id").alias(f"{side}_id")), side), "ends")

    ends = {side: end(side) for side in "ab"}
    named = pairs.select("a", "b")
    for side in "ab":
        named = skew_safe_lookup(named, ends[side].drop(f"{side}_id"), [side], f"{side}_n")
    named = named.withColumn("salt", _own_salt(F.col("a"), _salts(F.col("b_n"))))
    ids = ends["a"].select(F.col("a_id").alias("doc_id")).union(ends["b"].select("b_id"))
    sent = docs.sparkSession.sparkContext.broadcast(_id_filter(ids, ends["a"].count() + ends["b"].count()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (bits, found) = _Hashes(), sent.value
        for b in slices(batches):
            let = np.ones(b.num_rows, bool)
            for at in _places(b.column("doc_id"), bits):
                let &= (found[at >> 3] >> (at & 7)) & 1 == 1
            own = [shingles(t, width, hashes) for t in b.filter(pa.array(let)).column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in own], pa.binary()), pa.array([packed(s) for s in own], pa.binary())], names=["key", "tokens"])

    full = payload(docs, "doc_id").mapInArrow(build, "key binary, tokens binary").dropDuplicates(["key"])
    left = full.withColumnRenamed("key", "a_key").join(named, "a_key").select("a", "b", "salt", F.col("tokens").alias("ta"))
    right = full.withColumnRenamed("key", "b_key").join(ends["b"], "b_key").select("b", F.col("tokens").alias("tb"), _every_salt(_salts(F.col("b_n"))).alias("salt"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keep = []
            for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist()):
                both = len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True))
                keep.append(100 * both >= percent * ((len(x) + len(y)) // 6 - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return left.join(right, ["b", "salt"]).select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """Tokens that sets of n and m tokens have in common at least, if they link."""
    return F.ceil((n + m) * percent / F.lit(100 + percent))


def _may_link(x: dict[str, Column], y: dict[str, Column], percent: int) -> Column:
    """Whether a token at these places of two sets is one of those that a link between them has to share."""
    a, asked = _overlap(x["n"], y["n"], percent), F.least(x["matches"], y["matches"])
    sizes = (x["n"] * 100 >= y["n"] * percent) & (y["n"] * 100 >= x["n"] * percent)
    return sizes & (x["pos"] < x["n"] - a + asked) & (y["pos"] < y["n"] - a + asked)


def _lengths(x: dict[str, Column], y: dict[str, Column], percent: int) -> tuple[Column, Column, Column]:
    """The lengths of the two prefixes that a pair compares, and how many common tokens it asks for."""
    a, asked = _overlap(x["n"], y["n"], percent), F.least(x["matches"], y["matches"])
    return (x["n"] - a + asked).cast("int"), (y["n"] - a + asked).cast("int"), asked


def _matches(x: dict[str, Column], y: dict[str, Column], percent: int) -> Column:
    """At the first token that a pair has in common: whether it has as many as it asks for.

    True at every token where one is enough, or where HEAD tokens do not tell.
    """
    p, q, asked = _lengths(x, y, percent)
    both = F.array_intersect(F.slice(x["head"], F.lit(1), p), F.slice(y["head"], F.lit(1), q))
    return (asked == 1) | (p > HEAD) | (q > HEAD) | ((F.size(both) >= asked) & (F.get(both, F.lit(0)) == x["token"]))


def _asked_now(x: dict[str, Column], y: dict[str, Column], percent: int) -> Column:
    """How many rows a pair still has to have after the join: 1 where it was counted in it."""
    p, q, asked = _lengths(x, y, percent)
    return F.when((p > HEAD) | (q > HEAD), asked).otherwise(F.lit(1))


def classes(docs: DataFrame, width: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): rows has doc_id, __key, __n for each row of docs; sets has __key, component_id, keep_key, weight for each set."""
    with small_batches(docs.sparkSession):
        return _classes(docs, width, percent)


def _classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    sketch = frequency_sketch(docs, width)
    sent = spark.sparkContext.broadcast((sketch, noise(sketch)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (sketch, floor), hashes, told = sent.value, _Hashes(), set()
        for b in slices(batches):
            keys, sizes, matches, mass, tokens, offsets = [], [], [], [], [], [0]
            for t in b.column("text").to_pylist():
                s = shingles(t, width, hashes)
                keys.append(key := set_key(s))
                sizes.append(len(s))
                m, others, p = prefix(s, sketch, percent, floor) if len(s) and key not in told else (0, 0.0, s[:0])
                told.add(key)
                matches.append(m)
                mass.append(others)
                tokens.append(p)
                offsets.append(offsets[-1] + len(p))
            if len(told) > 1_000_000:
                told.clear()
            flat = pa.array(np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(matches, pa.int32()), pa.array(mass, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["doc_id", "__key", "__n", "matches", "mass", "tokens"])

    table = materialise(payload(docs, "doc_id").mapInArrow(run, "doc_id long, __key binary, __n long, matches int, mass double, tokens array<long>"), "prefixes")
    sent.destroy()
    # Tasks describe a set once each; one description is enough.  Its number, sid, is fixed by writing it.
    described = table.filter("matches > 0").dropDuplicates(["__key"]).select(F.monotonically_increasing_id().alias("sid"), F.col("__key").alias("key"), F.col("__n").cast("int").alias("n"), "matches", F.col("mass").cast("float").alias("mass"), "tokens")
    described = materialise(described, "described")
    counted = table.filter("__n > 0").groupBy(F.col("__key").alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight"))
    sets = materialise(counted.join(described.select("sid", "key"), "key"), "sets")
    postings = described.select("sid", "n", "matches", "mass", F.posexplode("tokens").alias("pos", "token"))
    # Most tokens are in one prefix only; they are found by tokens alone.
    shared = materialise(postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    met = skew_safe_lookup(postings, shared, ["token"], "df", keep=lambda rows: rows.filter("df is not null"))
    met = materialise(met.drop("df"), "postings")
    hubs = met.groupBy("token").agg(F.max(F.struct("mass", "sid", "n", "matches", "pos")).alias("hub"), F.count("*").alias("df"))
    hubs = materialise(hubs, "hubs")

    hub = {c: F.col(f"hub.{c}") for c in ("sid", "n", "matches", "pos")}
    mine = {c: F.col(c) for c in hub}
    stars = skew_safe_lookup(met, hubs, ["token"], "df").filter((F.col("sid") != hub["sid"]) & _may_link(mine, hub, percent)).groupBy("sid", hub["sid"].alias("other")).agg(F.count("*").alias("common"))
    first = stars.groupBy(F.col("sid").alias("a")).agg(F.max(F.struct("common", "other"))["other"].alias("b"))
    first = materialise(first, "stars")
    links = materialise(_verify(first, docs, sets, width, percent), "links")
    parts = materialise(components(links), "parts")

    parts = parts.withColumnRenamed("key", "sid")
    labelled = met.join(parts, "sid", "left").select("token", "sid", "n", "matches", "pos", F.coalesce("root", "sid").alias("part"))
    counted = labelled.groupBy("token", "part").agg(F.count("*").alias("c"))
    mixed = counted.groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("c", "part")).alias("most"), F.sum("c").alias("all")).filter("parts > 1")
    # In how many salts all rows of a token are dealt, and those that are not in its main part.
    mixed = materialise(mixed.select("token", "all", F.col("most.part").alias("main_part"), _salts(F.col("all")).alias("all_salts"), _salts(F.col("all") - F.col("most.c")).alias("other_salts")), "mixed")
    across = skew_safe_lookup(labelled, mixed, ["token"], "all", keep=lambda rows: rows.filter("main_part is not null"))
    across = across.withColumn("main", F.col("part") == F.col("main_part")).drop("main_part", "all")
    across = materialise(across.join(described.select("sid", F.when(F.col("matches") > 1, F.slice("tokens", 1, HEAD)).alias("head")), "sid"), "across")
    # The smaller set of a pair (by size, then number) needs a shorter prefix than the larger.
    short = across.filter(F.col("pos") < F.col("n") - _overlap(F.col("n"), F.col("n"), percent) + F.col("matches"))
    fields = ("sid", "token", "n", "matches", "pos", "part", "head")

    def meet(xs: DataFrame, x_salts: str, ys: DataFrame, y_salts: str) -> DataFrame:
        """Pairs of a token's rows, each in the cell of its two salts."""
        x = xs.select(*(F.col(c).alias(f"x_{c}") for c in fields), _own_salt(F.col("sid"), F.col(x_salts)).alias("u"), _every_salt(F.col(y_salts)).alias("v"))
        y = ys.select(*(F.col(c).alias(f"y_{c}") for c in fields), _own_salt(F.col("sid"), F.col(y_salts)).alias("v"), _every_salt(F.col(x_salts)).alias("u"))
        at = [{c: F.col(f"{side}_{c}") for c in fields} for side in "xy"]
        smaller = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_sid") < F.col("y_sid")))
        met = x.withColumnRenamed("x_token", "token").join(y.withColumnRenamed("y_token", "token"), ["token", "u", "v"])
        at = [d | {"token": F.col("token")} for d in at]
        return met.filter((F.col("x_part") != F.col("y_part")) & smaller & _may_link(*at, percent) & _matches(*at, percent)).select(F.col("x_sid").alias("a"), F.col("y_sid").alias("b"), _asked_now(*at, percent).alias("asked"))

    other, main = "other_salts", "all_salts"
    rows = meet(short.filter("not main"), other, across, main).unionByName(meet(short.filter("main"), main, across.filter("not main"), other))
    pairs = materialise(rows.groupBy("a", "b").agg(F.count("*").alias("common"), F.first("asked").alias("asked")).filter("common >= asked").select("a", "b"), "pairs")
    more = _verify(pairs, docs, sets, width, percent)
    every = materialise(links.unionByName(more), "links")
    roots = components(every)

    named = sets.join(roots.withColumnRenamed("key", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("m"))
    out = named.join(best, "root").select(F.col("key").alias("__key"), F.col("m.doc_id").alias("component_id"), F.col("m.key").alias("keep_key"), "weight")
    result = materialise(out, "classes")
    for t in (described, shared, met, hubs, first, mixed, across, pairs):
        discard(t)
    return table.select("doc_id", "__key", "__n"), result


def join_classes(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    rows, sets = classes(docs, width, percent)
    found = skew_safe_lookup(rows, sets.drop("keep_key"), ["__key"], "weight")
    return found.select("doc_id", F.col("__n").alias("n_shingles"), F.when(F.col("__n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def dedup_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with its columns: of each component that with the smallest id, and all without words."""
    _, sets = classes(docs, width, percent)

    def own(df: DataFrame) -> DataFrame:
        return df.filter((F.col("n") == 0) | ((F.col("key") == F.col("keep_key")) & F.col("id").eqNullSafe(F.col("component_id"))))

    found = skew_safe_lookup(_keyed(docs, width), sets.withColumnRenamed("__key", "key"), ["key"], "weight", keep=own)
    alone = F.when(F.col("n") == 0, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    first = W.partitionBy("key", "alone").orderBy("id")
    return found.withColumn("alone", alone).withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("row.*")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
c AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * k >= 90 * (cx.n + cy.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS top FROM c UNION SELECT e.y, r.top FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, any_value(n)::BIGINT AS n_shingles, min(top) AS component_id FROM c JOIN r USING (doc_id) GROUP BY doc_id
"""
