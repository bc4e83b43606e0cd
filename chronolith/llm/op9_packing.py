"""Packing by optimal length buckets.

The global histogram of lengths, one entry a length that occurs, decides the buckets: dynamic
programming chooses at most `buckets` boundaries so that padding every document to its bucket's
boundary adds the fewest tokens.  For a fixed number of buckets the cost of ending one at a length
is linear in that length for each place where it may begin, so the least is on the lower hull of
lines and a layer takes time linear in the number of distinct lengths.  These are what the driver
holds: at most the square root of twice all tokens, since d distinct lengths have d * d / 2 tokens
at least.

Inside a bucket documents are shuffled by the MD5 of their ids, ranked by slice totals (no
task holds a bucket), and cut into batches of floor(budget / boundary) documents, so that a
padded batch keeps to the token budget.  A document longer than the budget is a batch of its
own when its bucket's boundary exceeds the budget.

Defined cases: null text has length 0; lengths of 0 are padded to their boundary as others
are, which may be 0, and then share batches of `budget` documents; a null id has the key of
its text; repeated rows are packed apart, and which of them has which slot is open, as they are
alike; of boundaries that pad alike the fewest are taken; texts of any length are counted whole;
other columns are not read, and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, grouped_prefix, materialise

BUCKETS = 16
BUDGET = 65_536


def boundaries(tops: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The bucket boundaries (a subset of tops, ascending) with the least padding: sum of boundary - length.

    tops: the lengths that occur, ascending; counts: documents of each.  Of equal solutions one
    with fewest buckets is taken.  Whole numbers throughout, so the least is exact.
    """
    tops, d = [int(x) for x in tops], len(tops)
    if not d:
        return []
    n, s = [0], [0]
    for x, c in zip(tops, counts):
        n.append(n[-1] + int(c))
        s.append(s[-1] + x * int(c))
    # Padding of the first j lengths in b buckets: the least over i of before[i] + s[i] - x * n[i], with
    # x * n[j] - s[j] added, where x is the greatest of the j lengths and i is where the last bucket begins.
    before: list[int | None] = [0] + [None] * d
    cuts, totals = [], []
    for _ in range(min(buckets, d)):
        now: list[int | None] = [None] * (d + 1)
        cut = [0] * (d + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, height, i), slopes falling
        at = 0
        for j in range(1, d + 1):
            i = j - 1
            if before[i] is not None:
                m, h = -n[i], before[i] + s[i]
                while len(hull) > 1 and (h - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, h, i))
                at = min(at, len(hull) - 1)
            if hull:
                x = tops[j - 1]
                while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                    at += 1
                now[j] = hull[at][0] * x + hull[at][1] + x * n[j] - s[j]
                cut[j] = hull[at][2]
        before = now
        cuts.append(cut)
        totals.append(now[d])
    b, j, out = min(range(len(totals)), key=lambda k: (totals[k] is None, totals[k] or 0, k)), d, []
    while j:
        out.append(tops[j - 1])
        b, j = b - 1, cuts[b][j]
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), padded_len, batch_id (bucket-number), slot for every row."""
    length = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)) if length is None else length
    # Texts are read once; what follows works on two numbers and a key a document.
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.cast("long").alias("n_tokens"), key.alias("key")), "lengths")
    histogram = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()
    tops = boundaries(histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy(), buckets)
    edges = F.array(*map(F.lit, tops)).cast("array<bigint>")
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("n_tokens"))))
    rows = rows.withColumn("padded_len", F.try_element_at(edges, F.col("bucket") + 1))
    ranked = grouped_prefix(rows, F.col("bucket"), F.col("key"), F.col("n_tokens"), [F.col("doc_id"), F.col("n_tokens")])
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_len"), F.lit(1))))
    return ranked.select("doc_id", "n_tokens", "bucket", "padded_len", F.concat_ws("-", "bucket", F.floor(F.col("rank") / size).cast("string")).alias("batch_id"), (F.col("rank") % size).cast("long").alias("slot"))
