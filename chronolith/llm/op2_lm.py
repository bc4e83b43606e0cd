"""Language-model scoring by subword lattice likelihood.

Every token of a text is an arc of its own with the token's discounted count over all
training tokens, or any path of vocabulary pieces.  The forward recursion sums all of them, so
a token's probability is

    max(c - D, 0) / N + (D * V / N) * sum over segmentations of the product of piece weights

and a text's is the product over its tokens and one end.  Pieces and their weights are the
vocabulary's, as they are; what is learnt from the corpus are the counts of whole tokens, which
grow with it.  D is n1 / (n1 + 2 n2) from the counts of counts.

Counts: a token counted often enough to be among about `head` tokens (the threshold comes
from a histogram of counts in 1/8 powers of two, so the head is bounded) is broadcast with
its logarithms.  All other tokens of a text go by their bytes to their counts in a shuffle.

Defined cases: null text counts as empty, its score is that of one end; a null id counts as
the empty text in the split; repeated rows are scored apart, and alike; tokens and texts of any
length are summed whole; with nothing to learn from, a text's score is that of its lattice; other
columns are not read, and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, materialise, payload, slices
from .lattice import VOCABULARY, Lattice, vocabulary

HEAD = 300_000
LOCAL_TOKENS = 400_000
#: The end of a text as a token; no other token is empty.
END = b""


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def count_tokens(rows: DataFrame) -> DataFrame:
    """word, c over the column `text` (bytes) of rows; each text has one END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for b in slices(batches):
            for t in b.column("text").to_pylist():
                seen.update(tokens(t))
                seen[END] += 1
                if len(seen) > LOCAL_TOKENS:
                    yield flush()
                    seen.clear()
        yield flush()

    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Model:
    """What scoring needs: piece weights, totals and the discount.  Bounded by the vocabulary."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray, n: int, v: int, discount: float) -> None:
        self.pieces, self.logp, self.n, self.v, self.discount = pieces, logp, n, v, discount

    def base(self, c: int) -> float:
        return math.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def score(self, c: np.ndarray, sub: np.ndarray) -> np.ndarray:
        """log10 probability from counts and log piece marginals."""
        if not self.n:
            return sub / math.log(10)
        known = np.maximum(c - self.discount, 0.0) / self.n
        rest = math.log(self.discount * self.v / self.n)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(known), rest + sub) / math.log(10)


def fit(counts: DataFrame, path: str = VOCABULARY) -> Model:
    total = counts.agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first()
    n, v, once, twice = (int(x or 0) for x in total)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
    return Model(*vocabulary(path), n, v, discount)


def _with_marginals(rows: DataFrame, model: Model, only_unknown: bool) -> DataFrame:
    """Adds `sub`, the log piece marginal of `word`, to rows (all columns of rows are kept); equal neighbours are summed once."""
    sent = rows.sparkSession.sparkContext.broadcast((model.pieces, model.logp))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logp = sent.value
        lattice, logp = Lattice(pieces), logp[:, None]
        last: dict[bytes, float] = {}
        for b in batches:
            words = b.column("word").to_pylist()
            known = b.column("sub").to_pylist() if only_unknown else [None] * len(words)
            want = list({w for w, k in zip(words, known) if k is None and w is not None and w not in last})
            got = dict(zip(want, lattice.forward(want, logp)[:, 0])) if want else {}
            last = {w: last[w] if w in last else got[w] for w, k in zip(words, known) if k is None and w is not None}
            sub = [k if k is not None else last.get(w) for w, k in zip(words, known)]
            columns = [b.column(c) for c in names if c != "sub"] + [pa.array(sub, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[c for c in names if c != "sub"] + ["sub"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names if c != "sub") + ", sub double")


def score_documents(docs: DataFrame, path: str = VOCABULARY, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = payload(docs.filter(id_crc("doc_id") % 10 != 0)).select("text")
    counts = materialise(count_tokens(train), "counts")
    model = fit(counts, path)
    known = materialise(_with_marginals(counts, model, False), "tokens")

    steps = known.groupBy(F.floor(F.log2("c") * 8).alias("step")).count().orderBy(F.desc("step")).collect()
    taken, lowest = 0, None
    for r in steps:
        if (taken := taken + r["count"]) > head:
            break
        lowest = r["step"]
    in_head = F.floor(F.log2("c") * 8) >= (lowest if lowest is not None else 1 << 30)
    # At most `head` rows, whatever the corpus.
    table = known.filter(in_head).toPandas()
    c = table["c"].to_numpy(np.int64)
    values = dict(zip(table["word"], zip(np.log10((c + 0.1) / (model.n + 0.1 * (model.v + 1))).tolist() if model.n else [], model.score(c.astype(float), table["sub"].fillna(0.0).to_numpy()).tolist())))
    ends = known.filter(F.col("word") == F.lit(END)).select("c").first()
    c_end = ends[0] if ends else 0
    end_sub = -math.log(model.v + 1.0)
    end = (model.base(c_end) if model.n else 0.0, float(model.score(np.array([float(c_end)]), np.array([end_sub]))[0]), int(c_end > 0))
    values.pop(END, None)
    sent = spark.sparkContext.broadcast(values)
    del table, values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = sent.value
        uid = TaskContext.get().partitionId() << 34
        for b in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = Counter(tokens(text))
                n, base, score, seen = 1, end[0], end[1], end[2]
                for w, k in found.items():
                    n += k
                    v = heads.get(w)
                    if v is None:
                        out.append((uid, doc_id, w, k, None, None, None))
                    else:
                        base += k * v[0]
                        score += k * v[1]
                        seen += k
                # A blank is in no token, so this row meets no count.
                out.append((uid, doc_id, b" %d" % uid, n, seen, base, score))
                uid += 1
                if len(out) > 100_000:
                    yield batch(out)
                    out = []
            yield batch(out)

    kinds = [("uid", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("k", pa.int64()), ("seen", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(cols, kinds)], names=[x for x, _ in kinds])

    rows = payload(docs, "doc_id").mapInArrow(run, "uid long, doc_id long, word binary, k long, seen long, base double, score double")
    tail = known.filter(~in_head).select("word", "c", "sub")
    met = rows.join(tail, "word", "left").withColumn("word", F.when(F.col("seen").isNull(), F.col("word")))
    met = _with_marginals(met.select("uid", "doc_id", "k", "seen", "base", "score", "word", "c", "sub"), model, True)

    ln10, scale = math.log(10), float(model.n + 0.1 * (model.v + 1)) or 1.0
    is_doc = F.col("seen").isNotNull()
    count = F.coalesce(F.col("c"), F.lit(0)).cast("double")
    base = F.log10((count + 0.1) / scale)
    if model.n:
        high = F.greatest(count - model.discount, F.lit(0.0)) / model.n
        low = F.col("sub") + math.log(model.discount * model.v / model.n)
        # Through the larger term, since exp(low) may fall to 0.
        prob = F.when(high > 0, F.log10(high + F.exp(low))).otherwise(low / ln10)
    else:
        prob = F.col("sub") / ln10
    per = met.select(
        "uid", "doc_id",
        F.when(is_doc, F.col("k")).otherwise(0).alias("n_tokens"),
        F.when(is_doc, F.col("seen")).when(count > 0, F.col("k")).otherwise(0).alias("n_known"),
        F.when(is_doc, F.col("base")).otherwise(F.col("k") * base).alias("base_score"),
        F.when(is_doc, F.col("score")).otherwise(F.col("k") * prob).alias("score"),
    )
    sums = per.groupBy("uid", "doc_id").agg(*(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")))
    return sums.select("doc_id", (id_crc("doc_id") % 10 == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
