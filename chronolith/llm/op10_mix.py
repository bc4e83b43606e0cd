r"""Mixing sources to target weights, by hash-random keys and distributed prefix sums.

Each document gets the MD5 of its id as a random key (a null id that of its text).  Within its
source the documents are ordered by (key, id, size).  A source with target b over size s is taken
floor(b / s) times whole, then cut at the exact remainder: slices of the key's range are summed,
prefix sums of these tell in which slice the cut falls, and only that slice is put in order, to
find the document at the cut.  All documents before it are taken once more, and that one in
part.  So no task sees a whole source, and no text is ever shuffled.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a
source of size 0 has target 0; repeated rows are separate documents, and where the cut falls
among equal ones, so many of them are taken as fit; texts of any length are counted whole; other
columns are not read, and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, discard, materialise, skew_safe_lookup, whole_row

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
ROWS_A_SLICE = 50_000
#: What one row a source may take, in bytes, to be broadcast; more of it is joined by source, hot sources apart.
BROADCAST_BYTES = 8 << 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, ...) with target, by water-filling.

    Source i is capped at max_epochs * size.  In order of cap / weight, the level left for
    the uncapped after capping the first k is (total - caps) / (weights left); the first
    source whose ratio reaches its level, and all after it, take weight * level.  That is
    where repeated resharing of the excess ends.  One row a source: one task orders them, as
    the order of all sources decides their weights.
    """
    by_code = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ordered = sizes.withColumn("i", (F.row_number().over(by_code) - 1) % len(weights))
    ordered = ordered.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") + 1).cast("int")).cast("double"))
    ordered = ordered.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = W.orderBy("ratio", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before, everything = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    levels = ordered.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    return levels.withColumn("at", level).select(*sizes.columns, F.least("cap", F.coalesce(F.col("w") * F.col("at"), F.col("cap"))).alias("target"))


def _measured(docs: DataFrame, size: Column | None, *carry: Column) -> DataFrame:
    """doc_id, source, src (never null), size, key of every row, beside the columns of carry."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)) if size is None else size
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    source = F.col("source").cast("string")
    return docs.select(*carry, "doc_id", source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("src"), size.cast("long").alias("size"), key.alias("key"))


def _by_source(rows: DataFrame, table: DataFrame, weight: str) -> DataFrame:
    """rows with what a table of one row a source says of theirs."""
    if (table.agg(F.sum(F.octet_length("src") + 200)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), "src")
    return skew_safe_lookup(rows, table, ["src"], weight)


def budgets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, rows_a_slice: int = ROWS_A_SLICE) -> DataFrame:
    """One row a source: src, docs, source_size, target, epochs, rest, cut (key, doc_id, size), cut_at, equal.

    `cut` is the document at which the rest ends, `cut_at` the size before the first document
    equal to it, `equal` how many there are.  rows: _measured(), written.
    """
    sizes = rows.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = source_targets(sizes, weights, max_epochs).drop("source")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    plan = materialise(plan.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "targets")

    cut_in = plan.filter("rest > 0").select("src", "docs", "rest", F.ceil(F.col("docs") / rows_a_slice).alias("n"))
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("n") / F.lit(2**32))
    dealt = _by_source(rows, cut_in, "docs").withColumn("slice", place)
    sums = dealt.groupBy("src", "slice").agg(F.sum("size").alias("s"), F.first("rest").alias("left"))
    earlier = W.partitionBy("src").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(earlier), F.lit(0)))
    hit = sums.filter("before < left and left <= before + s").select("src", "slice", "left", "before")
    inside = dealt.select("src", "slice", "key", "doc_id", "size").join(hit, ["src", "slice"])
    order = W.partitionBy("src").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    alike = inside.groupBy("src", "key", "doc_id", "size").agg(F.min("at").alias("cut_at"), F.count("*").alias("equal"), F.first("left").alias("left"))
    cut = alike.filter("cut_at < left and left <= cut_at + size * equal").select("src", F.struct("key", "doc_id", "size").alias("cut"), "cut_at", "equal")
    return materialise(plan.join(cut, "src", "left"), "budgets")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with source_size, target and taken."""
    met = _by_source(rows, plan, "docs")
    own = F.struct("key", "doc_id", "size")
    part = lambda at: F.least(F.greatest(F.col("rest") - at, F.lit(0)), F.col("size"))
    keep = [*rows.columns, "source_size", "target"]

    def out(df: DataFrame, extra: Column) -> DataFrame:
        return df.select(*keep, (F.col("epochs") * F.col("size") + F.coalesce(extra, F.lit(0))).cast("long").alias("taken"))

    other = F.when(own < F.col("cut"), F.col("size")).when(own == F.col("cut"), part(F.col("cut_at")))
    if plan.filter("equal > 1").isEmpty():
        return out(met, other)
    # Equal documents share what is left from the first on.
    same = F.coalesce((own == F.col("cut")) & (F.col("equal") > 1), F.lit(False))
    number = F.row_number().over(W.partitionBy("src").orderBy("key")) - 1
    return out(met.filter(~same), other).unionByName(out(met.filter(same).withColumn("nth", number), part(F.col("cut_at") + F.col("nth") * F.col("size"))))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, rows_a_slice: int = ROWS_A_SLICE) -> DataFrame:
    """doc_id, source, size, source_size, target (its source's), taken for every row."""
    rows = materialise(_measured(docs, size), "sizes")
    return _taken(rows, budgets(rows, weights, max_epochs, rows_a_slice)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, rows_a_slice: int = ROWS_A_SLICE) -> DataFrame:
    """The rows of docs that the mix takes, each once for every epoch begun on it, with the columns of docs.

    A document cut by its source's budget is kept whole; one of size 0 is taken in no epoch and goes.
    """
    rows = materialise(_measured(docs, None), "sizes")
    plan = budgets(rows, rows_a_slice=rows_a_slice)
    discard(rows)
    out = _taken(_measured(docs, None, whole_row(docs)), plan).filter("taken > 0")
    times = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    return out.select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, CAST([1, 2, 3][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, cap / w AS ratio,
  (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
t AS (SELECT source, source_size, least(cap, coalesce(w * (SELECT arg_min(level, ratio) FROM l WHERE ratio >= level), cap)) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(floor(target) / source_size) * size
    + least(greatest(floor(target) - floor(floor(target) / source_size) * source_size - before, 0), size) AS BIGINT) END AS taken
FROM r
"""
