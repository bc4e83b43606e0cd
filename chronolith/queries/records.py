"""Runs, sinks and counts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import runs as O
from ..sources import tables as S
from .base import RUNS, SEG, query


@query(f"WITH {RUNS} SELECT kind, run_id, status, processed_until FROM runs QUALIFY row_number() OVER (PARTITION BY kind ORDER BY (run_id % 1000 = 7) DESC, (status = 'complete') DESC, processed_until DESC, updated_at DESC, run_id) = 1")
def best_run(spark, d):
    """L2."""
    return O.best_run(S.runs(spark, d), ["kind"], F.col("run_id") % 1000 == 7)


@query(f"WITH {RUNS} SELECT kind, status, count(*) AS n, max(processed_until) AS farthest, round(avg(processed_until), 4) AS mean FROM runs GROUP BY ALL")
def run_stats(spark, d):
    """A1."""
    return S.runs(spark, d).groupBy("kind", "status").agg(F.count("*").alias("n"), F.max("processed_until").alias("farthest"), F.round(F.avg("processed_until"), 4).alias("mean"))


@query("SELECT c.c_custkey, coalesce(max(o.o_orderkey) + 1, 0) AS next_idx FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def next_index(spark, d):
    """A2."""
    orders = S.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return O.next_index(orders, S.table(spark, d, "customer"), ["c_custkey"], "o_orderkey")


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events")
def running_counters(spark, d):
    """A3."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return S.table(spark, d, "events").select("user_id", "event_id", F.round(F.sum("value").over(order), 4).alias("total"), F.count("*").over(order).alias("n"))


@query(f"""WITH {RUNS}, n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
x AS (SELECT run_id, CASE WHEN run_id % 13 = 0 THEN NULL WHEN run_id % 11 = 0 THEN 'failed' ELSE status END AS status, coalesce(n, 0) AS n FROM runs LEFT JOIN n ON run_id = l_orderkey)
SELECT run_id, CASE WHEN status IS NULL OR status = 'complete' AND n = 0 THEN 'empty' WHEN status IN ('complete', 'failed', 'running') THEN status ELSE 'partial' END AS shown FROM x""")
def run_status(spark, d):
    """P9."""
    n = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("n"))
    status = F.when(F.col("run_id") % 13 == 0, None).when(F.col("run_id") % 11 == 0, "failed").otherwise(F.col("status"))
    rows = S.runs(spark, d).join(n, "run_id", "left").withColumn("status", status)
    return rows.select("run_id", O.shown_status(F.col("status"), F.coalesce("n", F.lit(0))).alias("shown"))


@query("""WITH old AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)""")
def upsert_video(spark, d):
    """K3."""
    c = S.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.filter("c_custkey % 2 = 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return O.upsert(c.filter("c_custkey % 3 <> 0"), new, "c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def delete_run_rows(spark, d):
    """K4, J4."""
    gone = S.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return O.without_runs(S.table(spark, d, "lineitem"), gone, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT o.o_orderkey, coalesce(string_agg(l.l_linenumber::VARCHAR || ':' || l.l_partkey::VARCHAR, ',' ORDER BY l.l_linenumber, l.l_partkey), '') AS words FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey")
def nest_words(spark, d):
    """J3."""
    words = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    out = O.nest_words(S.table(spark, d, "orders").select("o_orderkey"), words, ["o_orderkey"])
    return out.select("o_orderkey", F.array_join(F.transform("words", lambda w: F.concat(w["l_linenumber"].cast("string"), F.lit(":"), w["l_partkey"].cast("string"))), ",").alias("words"))


@query("SELECT o_orderpriority, count(*) AS words FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def word_counts(spark, d):
    """J2."""
    return S.table(spark, d, "lineitem").join(S.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("words"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_linenumber) = 1")
def stream_pick(spark, d):
    """S5."""
    return O.pick_stream(S.table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", F.col("l_returnflag") == "R")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS views, count(*) AS n FROM events GROUP BY user_id")
def evidence_counts(spark, d):
    """A13."""
    kind = F.col("event_type")
    return S.table(spark, d, "events").groupBy("user_id").agg(F.count_if(kind == "error").alias("errors"), F.count_if(kind == "view").alias("views"), F.count("*").alias("n"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    """A14."""
    # Values are counted first, so that a few hot types send each of theirs once.
    n = S.table(spark, d, "events").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    return n.groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5), F.col("n")), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95), F.col("n")), 6).alias("p95"))


@query("SELECT user_id, sum((props ->> '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY user_id")
def usage_sum(spark, d):
    """Integers of nested usage records."""
    return S.table(spark, d, "events").groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k, coalesce(props ->> '$.missing', 'none') AS other FROM events")
def json_parse(spark, d):
    """A field, and a default where there is none."""
    parsed = F.from_json("props", "k long, missing string")
    return S.table(spark, d, "events").select("event_id", parsed.k.alias("k"), F.coalesce(parsed.missing, F.lit("none")).alias("other"))


@query("SELECT conv_id, turn, '{\"conv_id\":' || conv_id::VARCHAR || ',\"turn\":' || turn::VARCHAR || ',\"role\":\"' || role || '\",\"language\":null}' AS js FROM conversations")
def to_json(spark, d):
    """Nulls are written."""
    row = F.struct("conv_id", "turn", "role", F.lit(None).cast("string").alias("language"))
    return S.table(spark, d, "conversations").select("conv_id", "turn", F.to_json(row, {"ignoreNullFields": "false"}).alias("js"))


@query(f"WITH {SEG} SELECT video_id, count(*) AS segments, max(end_s) AS until, round(sum(end_s - start_s), 4) AS seconds FROM seg GROUP BY video_id")
def timeline_stats(spark, d):
    """A1, A5, A15."""
    return S.segments(spark, d).groupBy("video_id").agg(F.count("*").alias("segments"), F.max("end_s").alias("until"), F.round(F.sum(F.col("end_s") - F.col("start_s")), 4).alias("seconds"))


@query("SELECT item_id, lower(sha256(text)) AS strict FROM benchmark")
def fingerprint_strict(spark, d):
    """Of the whole content."""
    from ..sources.media import fingerprint

    b = S.table(spark, d, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("content"))
    return b.select("item_id", fingerprint(F.col("content"), strict=True).alias("strict"))
