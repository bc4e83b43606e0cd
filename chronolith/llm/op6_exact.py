r"""Exact dedup with Patricia tries.

Texts are compared after deleting the six ASCII blanks; whole byte strings decide, no digest.

fold     every map task puts its texts into compressed radix tries, one for each length.  A
         row is known from then on by the number of its terminal node, and each terminal holds
         its best row (most code points, smallest id, first read) and the number of rows, so
         that copies met in one task leave it as one row
merge    terminals go to partitions by (length, leading bits of a content hash); each such
         bucket fills a trie of its own, whose terminals take together what the tasks' terminals
         hold: the owner, the size of the group, and the numbers of the nodes behind it
spill    when a bucket's trie passes its byte budget, its heaviest subtree is cut off: the
         terminals in it, and all that arrives for it later, are written out unresolved, and the
         next round deals them by more bits of the hash.  The last round has all 64 and cuts
         nothing: by then a bucket is one text, but for chance

Rows find their owner by the number of their node.  A node has rows of one task only, so a text
that a third of all rows hold gathers nowhere.

Defined cases: null text counts as empty, and all empty texts are one group; of rows equal in
code points and id, the one read first stays and the others go, so exactly one row of each group
is kept; a null id is larger than any other; texts of any length are compared whole; columns of
docs may have any name, also one that is used here; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, discard, materialise, partitions, slices, whole_row

TRIE_BYTES = 32 << 20
#: Leading bits of the content hash that deal out terminals, by round.
ROUNDS = (16, 32, 64)
#: Stands for a null id while owners are compared.
NO_ID = (1 << 63) - 1
NODE_BYTES = 200
TERMINAL = [("n_len", T.LongType()), ("hash", T.LongType()), ("body", T.BinaryType()), ("points", T.LongType()), ("id", T.LongType()), ("uid", T.LongType()), ("rows", T.LongType()), ("nodes", T.ArrayType(T.LongType()))]
OWNER = [("node", T.LongType()), ("keep_id", T.LongType()), ("keep_uid", T.LongType()), ("group_size", T.LongType()), ("sha", T.BinaryType())]

#: What a terminal holds: code points, id and number of its best row, the number of its rows, the nodes behind it.
Value = tuple[int, int, int, int, list[int]]


class Patricia:
    """A radix trie over byte strings.  A node is [edge, children by first byte, value]; None stands for a subtree cut off."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.bytes = 0

    @staticmethod
    def _shared(edge: bytes, key: bytes, at: int) -> int:
        """How many bytes of edge agree with key from `at` on, by halving."""
        low, high = 0, min(len(edge), len(key) - at)
        if edge[:high] == key[at : at + high]:
            return high
        while high - low > 1:
            mid = (low + high) // 2
            if edge[low:mid] == key[at + low : at + mid]:
                low = mid
            else:
                high = mid
        return low

    def insert(self, key: bytes, value: Value) -> list | None:
        """Puts value at key, or merges it there; gives the terminal node, or None where the key's subtree was cut off."""
        node, at = self.root, 0
        while at < len(key):
            if key[at] not in node[1]:
                leaf = [key[at:], {}, value]
                node[1][key[at]] = leaf
                self.bytes += len(key) - at + NODE_BYTES
                return leaf
            child = node[1][key[at]]
            if child is None:
                return None
            edge = child[0]
            k = self._shared(edge, key, at)
            if k < len(edge):
                upper = [edge[:k], {edge[k]: child}, None]
                child[0] = edge[k:]
                node[1][key[at]] = upper
                self.bytes += NODE_BYTES
                child = upper
            node, at = child, at + k
        node[2] = value if node[2] is None else better(node[2], value)
        return node

    @staticmethod
    def terminals(node: list, path: bytes = b"") -> Iterator[tuple[bytes, Value]]:
        """The keys and values in a subtree; path is what leads to its node."""
        todo = [(node, path)]
        while todo:
            node, path = todo.pop()
            path += node[0]
            if node[2] is not None:
                yield path, node[2]
            todo += [(child, path) for child in node[1].values() if child is not None]

    @staticmethod
    def _weight(node: list) -> int:
        total, todo = 0, [node]
        while todo:
            node = todo.pop()
            total += len(node[0]) + NODE_BYTES
            todo += [child for child in node[1].values() if child is not None]
        return total

    def cut(self) -> list[tuple[bytes, Value]]:
        """Cuts off the heaviest subtree at the first branching and gives its terminals; none if a single text is left."""
        node, path = self.root, b""
        while node[2] is None and len(node[1]) == 1:
            (child,) = node[1].values()
            if child is None:
                return []
            node, path = child, path + child[0]
        weights = {first: self._weight(child) for first, child in node[1].items() if child is not None}
        if not weights:
            return []
        first = max(weights, key=lambda x: (weights[x], x))
        out = list(self.terminals(node[1][first], path))
        node[1][first] = None
        self.bytes -= weights[first]
        return out


def better(a: Value, b: Value) -> Value:
    x, y = (a, b) if (-a[0], a[1], a[2]) <= (-b[0], b[1], b[2]) else (b, a)
    x[4].extend(y[4])
    return x[0], x[1], x[2], a[3] + b[3], x[4]


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _batch(rows: list[tuple], fields: list[tuple[str, T.DataType]], others: list[pa.Field], others_first: bool) -> pa.RecordBatch:
    """Rows of one half of a table, the other half null."""
    kinds = {T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}
    cols = list(zip(*rows)) or [[]] * len(fields)
    mine = [(name, pa.array(col, kinds[kind])) for col, (name, kind) in zip(cols, fields)]
    rest = [(f.name, pa.nulls(len(rows), f.type)) for f in others]
    both = rest + mine if others_first else mine + rest
    return pa.RecordBatch.from_arrays([x for _, x in both], names=[name for name, _ in both])


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def fold(docs: DataFrame, carry: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Rows (row, uid, node) and, where `body` is not null, the terminals of each task's tries.

    carry: docs as `row`, doc_id (long) and text (bytes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[int, Patricia] = {}
        held, uid = 0, TaskContext.get().partitionId() << 33
        node = uid

        def flush() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            size = 0
            for trie in tries.values():
                for body, v in trie.terminals(trie.root):
                    out.append((len(body), _signed(xxhash.xxh64_intdigest(body)), body, v[0], v[1], v[2], v[3], v[4]))
                    size += len(body) + 100
                    if size > 4 << 20:
                        yield _batch(out, TERMINAL, rows, True)
                        out, size = [], 0
            yield _batch(out, TERMINAL, rows, True)

        rows: list[pa.Field] = []
        for b in slices(batches):
            rows = rows or [pa.field("row", b.schema.field("row").type), pa.field("task_uid", pa.int64()), pa.field("node", pa.int64())]
            mine, first = [], uid
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                body = text.translate(None, BLANKS)
                trie = tries.setdefault(len(body), Patricia())
                size = trie.bytes
                value = (code_points(text), NO_ID if doc_id is None else doc_id, uid, 1, [node])
                end = trie.insert(body, value)
                if end[2] is value:
                    node += 1
                else:
                    end[2][4].remove(node)  # the node was there already
                mine.append(end[2][4][0])
                held += trie.bytes - size
                uid += 1
            terminals = [pa.nulls(b.num_rows, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(range(first, uid), pa.int64()), pa.array(mine, pa.int64()), *terminals], names=["row", "task_uid", "node", *(name for name, _ in TERMINAL)])
            if held > trie_bytes:
                yield from flush()
                tries, held = {}, 0
        if tries:
            yield from flush()

    schema = _schema(("row", carry.schema["row"].dataType), ("task_uid", T.LongType()), ("node", T.LongType()), *TERMINAL)
    return materialise(carry.mapInArrow(run, schema), "folded")


def owners(terminals: DataFrame, trie_bytes: int = TRIE_BYTES, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """node, keep_id, keep_uid, group_size, sha for every node behind the terminals."""
    spark, out = terminals.sparkSession, None
    names = [name for name, _ in TERMINAL]
    for i, bits in enumerate(rounds):
        last = i == len(rounds) - 1

        def run(batches: Iterator[pa.RecordBatch], last=last) -> Iterator[pa.RecordBatch]:
            trie, bucket, size = Patricia(), None, 0
            done: list[tuple] = []
            left: list[tuple] = []
            owner_fields, terminal_fields = ([pa.field(n, {T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}[k]) for n, k in f] for f in (OWNER, TERMINAL))

            def settle() -> None:
                nonlocal size
                for body, v in trie.terminals(trie.root):
                    sha = hashlib.sha256(body).digest()
                    done.extend((n, v[1], v[2], v[3], sha) for n in v[4])
                    size += 100 * len(v[4])

            def written() -> Iterator[pa.RecordBatch]:
                yield _batch(done, OWNER, terminal_fields, False)
                yield _batch(left, TERMINAL, owner_fields, True)

            for b in slices(batches):
                for n_len, h, body, points, doc_id, uid, n_rows, nodes, part in zip(*(b.column(c).to_pylist() for c in (*names, "part"))):
                    if (n_len, part) != bucket:
                        settle()
                        trie, bucket = Patricia(), (n_len, part)
                    if trie.insert(body, (points, doc_id, uid, n_rows, nodes)) is None:
                        left.append((n_len, h, body, points, doc_id, uid, n_rows, nodes))
                        size += n_len + 100
                    while not last and trie.bytes > trie_bytes and (cut := trie.cut()):
                        left.extend((n_len, _signed(xxhash.xxh64_intdigest(k)), k, *v) for k, v in cut)
                        size += sum(n_len + 100 for _ in cut)
                    if size > 4 << 20:
                        yield from written()
                        done, left, size = [], [], 0
            settle()
            yield from written()

        part = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")
        size = terminals.agg(F.sum("n_len")).first()[0] or 0
        dealt = terminals.select(*names, part.alias("part")).repartition(partitions(spark, size), "n_len", "part").sortWithinPartitions("n_len", "part")
        both = materialise(dealt.mapInArrow(run, _schema(*OWNER, *TERMINAL)), "owners")
        found = both.filter("node is not null").select(*(name for name, _ in OWNER))
        out = found if out is None else out.unionByName(found)
        terminals = both.filter("n_len is not null").select(*names)
        if last or terminals.isEmpty():
            return out
    raise AssertionError


def _owned(docs: DataFrame, row, trie_bytes: int, rounds: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (row, task_uid, node), and the owners by node."""
    carry = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    table = fold(docs, carry, trie_bytes)
    found = owners(table.filter("n_len is not null").select(*(name for name, _ in TERMINAL)), trie_bytes, rounds)
    return table.filter("task_uid is not null").select("row", "task_uid", "node"), found


def dedup(docs: DataFrame, trie_bytes: int = TRIE_BYTES, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    rows, found = _owned(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), trie_bytes, rounds)
    met = rows.join(found, "node")
    keep = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return met.select("row.doc_id", keep.alias("keep_id"), "group_size", (F.col("task_uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def dedup_documents(docs: DataFrame, trie_bytes: int = TRIE_BYTES, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """The rows of docs that stay, one for each distinct text, with its columns."""
    rows, found = _owned(docs, whole_row(docs), trie_bytes, rounds)
    gone = rows.select("task_uid", "node").join(found.select("node", "keep_uid"), "node").filter("task_uid <> keep_uid").select("task_uid")
    return rows.join(gone, "task_uid", "left_anti").select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY points DESC, doc_id)
"""
