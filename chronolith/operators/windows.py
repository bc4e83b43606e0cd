"""Order-dependent grouping of intervals.

Rules whose cap depends on where a group began are not gaps and islands, so they are folds
over the ordered rows of one timeline, inside the JVM.  A fold keeps what the rule needs and a
mark for each group begun; rows are not copied into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hit_groups(hits: DataFrame, keys: list[str], merge_gap: Column | float, max_window: Column | float, start: str = "start_s", end: str = "end_s", idx: str = "idx") -> DataFrame:
    """Adds `grp`, the idx at which a hit's group begins.

    In order of idx a hit joins the group if it starts at most merge_gap after the group's
    greatest end and ends at most max_window after the group's start.
    """
    gap = F.lit(merge_gap) if not isinstance(merge_gap, Column) else merge_gap
    most = F.lit(max_window) if not isinstance(max_window, Column) else max_window
    ordered = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(start).alias("s"), F.col(end).alias("e")))).alias("__h"))
    kind = dict(hits.dtypes)
    zero = F.struct(F.lit(None).cast(kind[start]).alias("s"), F.lit(None).cast(kind[end]).alias("e"), F.array().cast(f"array<{kind[idx]}>").alias("begun"))

    def step(a: Column, h: Column) -> Column:
        joins = a["s"].isNotNull() & (h["s"] - a["e"] <= gap) & (h["e"] - a["s"] <= most)
        return F.struct(F.when(joins, a["s"]).otherwise(h["s"]).alias("s"), F.when(joins, F.greatest(a["e"], h["e"])).otherwise(h["e"]).alias("e"), F.when(joins, a["begun"]).otherwise(F.array_append(a["begun"], h["i"])).alias("begun"))

    begun = ordered.select(*keys, F.explode(F.aggregate("__h", zero, step)["begun"]).alias(idx), F.lit(True).alias("__first"))
    marked = hits.join(begun, [*keys, idx], "left")
    order = W.partitionBy(*keys).orderBy(idx).rowsBetween(W.unboundedPreceding, 0)
    return marked.withColumn("grp", F.last(F.when(F.col("__first"), F.col(idx)), ignorenulls=True).over(order)).drop("__first")


def group_marks(ordered: Column, merge_gap: float, max_window: float) -> Column:
    """W1 over an array of (s, e) in order: the places (from 1) at which groups begin."""
    zero = F.struct(F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("e"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("begun"))

    def step(a: Column, h: Column) -> Column:
        joins = a["s"].isNotNull() & (h["s"] - a["e"] <= merge_gap) & (h["e"] - a["s"] <= max_window)
        place = a["n"] + 1
        return F.struct(F.when(joins, a["s"]).otherwise(h["s"]).alias("s"), F.when(joins, F.greatest(a["e"], h["e"])).otherwise(h["e"]).alias("e"), place.alias("n"), F.when(joins, a["begun"]).otherwise(F.array_append(a["begun"], place)).alias("begun"))

    return F.aggregate(ordered, zero, step)["begun"]


def interval_merge(rows: DataFrame, keys: list[str], slack: float, start: str = "start_s", end: str = "end_s", tie: str = "rank") -> DataFrame:
    """Merges intervals that start at most slack after the greatest end so far; start, end, least `tie`."""
    order = W.partitionBy(*keys).orderBy(start, tie)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) <= reach + slack, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__i", island).groupBy(*keys, "__i").agg(F.min(start).alias(start), F.max(end).alias(end), F.min(tie).alias(tie), F.count("*").alias("parts")).drop("__i")


def overlap_join(windows: DataFrame, segments: DataFrame, keys: list[str], bucket: float = 60.0) -> DataFrame:
    """Pairs of windows (w_start, w_end) and segments that overlap, ends included.

    A segment is put into every time bucket it touches and so is a window; the pair is kept in
    the first bucket both touch.  The join is an equi join on keys and bucket.
    """
    n = lambda x: F.floor(F.col(x) / bucket)
    w = windows.withColumn("__b", F.explode(F.sequence(n("w_start"), n("w_end"))))
    s = segments.withColumn("__b", F.explode(F.sequence(n("start_s"), n("end_s"))))
    first = F.col("__b") == F.greatest(n("w_start"), n("start_s"))
    return w.join(s, [*keys, "__b"]).filter((F.col("end_s") >= F.col("w_start")) & (F.col("start_s") <= F.col("w_end")) & first).drop("__b")


def assign_earliest(windows: DataFrame, segments: DataFrame, keys: list[str], segment_keys: list[str]) -> DataFrame:
    """Each segment with the earliest window that it overlaps."""
    joined = overlap_join(windows, segments, keys)
    first = W.partitionBy(*dict.fromkeys([*keys, *segment_keys])).orderBy("w_start", "w_end")
    return joined.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, value: str, tolerance: float | None = None) -> DataFrame:
    """For each left row, `value` and time of the last right row at or before it (within tolerance), else null.

    One shuffle by key: both sides in one order, the last right row carried forward.
    """
    mark = F.struct(F.col(right_at).alias("at"), F.col(value).alias("value"))
    names = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(at).cast("double").alias("__t"), F.lit(1).alias("__side"), F.struct(*names).alias("__row"))
    b = right.select(*keys, F.col(right_at).cast("double").alias("__t"), F.lit(0).alias("__side"), mark.alias("__mark"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy("__t", "__side", F.col("__mark.value")).rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("__m", F.last("__mark", ignorenulls=True).over(order)).filter("__side = 1")
    near = F.lit(True) if tolerance is None else F.col("__t") - F.col("__m.at") <= tolerance
    return met.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in names), F.when(near, F.col("__m.value")).alias(value), F.when(near, F.col("__m.at")).alias(right_at))


def even_indices(n: Column, k: Column | int) -> Column:
    """K evenly spread places of n (0-based), all where n <= k; halves go to the even place."""
    k = F.lit(k) if isinstance(k, int) else k
    spread = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.rint(i * ((n - 1) / F.greatest(k - 1, F.lit(1)))).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= k, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(spread)


def budget_pack(rows: DataFrame, keys: list[str], order: str, cost: str, budget: Column) -> DataFrame:
    """Adds `taken`: in order, a row is taken if it still fits; one that does not is skipped, not the end."""
    ordered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c")))).alias("__r"), F.first(budget).alias("__b"))
    kind = dict(rows.dtypes)[order]
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("got"))
    done = ordered.select(*keys, F.explode(F.aggregate("__r", F.struct(zero["used"].alias("used"), zero["got"].alias("got"), F.col("__b").cast("long").alias("b")), lambda a, r: F.struct(F.when(a["used"] + r["c"] <= a["b"], a["used"] + r["c"]).otherwise(a["used"]).alias("used"), F.when(a["used"] + r["c"] <= a["b"], F.array_append(a["got"], r["o"])).otherwise(a["got"]).alias("got"), a["b"].alias("b")))["got"]).alias(order), F.lit(True).alias("taken"))
    return rows.join(done, [*keys, order], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
