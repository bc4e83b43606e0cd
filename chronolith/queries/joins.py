"""Ordered scans and set queries that the timeline store answers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import tables as S
from .base import CONV, SEG, query


@query(f"WITH {SEG} SELECT video_id, idx, start_s, row_number() OVER (PARTITION BY video_id ORDER BY start_s, idx) - 1 AS place FROM seg")
def ordered_scan(spark, d):
    """L3, S9."""
    order = W.partitionBy("video_id").orderBy("start_s", "idx")
    return S.segments(spark, d).select("video_id", "idx", "start_s", (F.row_number().over(order) - 1).alias("place"))


@query(f"WITH {CONV} SELECT video_id, idx, left(text, 120) AS shown FROM conv QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY idx DESC) <= 4")
def tool_caps(spark, d):
    """The last rows a tool may show; the cap is the feature."""
    order = W.partitionBy("video_id").orderBy(F.desc("idx"))
    rows = S.conversation_segments(spark, d).withColumn("n", F.row_number().over(order)).filter("n <= 4")
    return rows.select("video_id", "idx", F.left("text", F.lit(120)).alias("shown"))


#: Words of a run by which a passage is recognised; a shorter passage is looked for whole.
RUN = 8
_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


@query(f"""WITH b AS (SELECT item_id, {_WORDS} AS w, least({RUN}, len({_WORDS})) AS n FROM benchmark),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b WHERE n > 0)),
d AS (SELECT doc_id AS video_id, {_WORDS} AS w FROM documents),
dg AS (SELECT DISTINCT video_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bg)))
SELECT video_id, count(DISTINCT item_id) AS items FROM dg JOIN bg USING (n, gram) GROUP BY video_id""")
def passage_quotes(spark, d):
    """Timelines that quote any part of a known passage: a run of eight words from any place of it."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    grams = lambda: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " ")))).alias("gram")
    b = S.table(spark, d, "benchmark").select("item_id", words.alias("w")).withColumn("n", F.least(F.lit(RUN), F.size("w"))).filter("n > 0")
    # At most eight numbers.
    lengths = F.array(*(F.lit(r["n"]) for r in b.select("n").distinct().collect())).cast("array<int>")
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), words.alias("w"), F.explode(lengths).alias("n")).filter("size(w) >= n")
    hits = docs.select("video_id", "n", grams()).join(b.select("item_id", "n", grams()), ["n", "gram"]).select("video_id", "item_id").distinct()
    return hits.groupBy("video_id").agg(F.count("*").alias("items"))
