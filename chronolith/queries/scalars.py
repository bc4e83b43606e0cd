"""Projections, filters, times and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock as C
from ..functions import text as T
from ..operators.chunks import segment_ids
from ..plans.search import in_range
from ..sources import tables as S
from .base import CONV, SEG, query


@query(f"WITH {SEG} SELECT video_id, idx, start_s, end_s FROM seg WHERE end_s >= 30.0 AND start_s <= 60.0")
def interval_filter(spark, d):
    """P1."""
    return S.segments(spark, d).filter(in_range(30.0, 60.0)).select("video_id", "idx", "start_s", "end_s")


@query("SELECT label AS video_id, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS t FROM embeddings QUALIFY t BETWEEN 5 AND 20")
def point_range_filter(spark, d):
    """P2."""
    return S.thumbnails(spark, d).filter(F.col("t").between(5, 20)).select("video_id", F.col("frame_id").alias("vec_id"), "t")


@query(f"WITH {CONV} SELECT video_id, idx, text FROM conv WHERE idx BETWEEN 1 AND 3")
def index_range(spark, d):
    """P3."""
    return S.conversation_segments(spark, d).filter(F.col("idx").between(1, 3)).select("video_id", "idx", "text")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unassigned_rows(spark, d):
    """Rows without a back-reference."""
    return S.table(spark, d, "documents").join(S.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang")


@query(f"""WITH x AS (SELECT conv_id, turn, chr(160) || text || chr(9) || chr(8195) AS text FROM conversations UNION ALL SELECT conv_id, turn, chr(9) || chr(12288) FROM conversations)
SELECT conv_id, turn, regexp_replace(text, '^[{T.BLANKS}]+|[{T.BLANKS}]+$', '', 'g') AS text FROM x WHERE NOT regexp_full_match(text, '[{T.BLANKS}]*')""")
def strip_and_drop_empty(spark, d):
    """P5: blanks of any script at both ends go, and texts of nothing else."""
    turns = S.table(spark, d, "conversations").select("conv_id", "turn", "text")
    rows = turns.withColumn("text", F.concat(F.lit("\u00a0"), "text", F.lit("\t\u2003"))).unionByName(turns.withColumn("text", F.lit("\t\u3000")))
    return rows.withColumn("text", T.strip(F.col("text"))).filter(F.length("text") > 0)


@query("SELECT event_id, round_even(exp(-value / 100) * 10000, 0) / 10000 AS confidence, CASE WHEN event_type = 'error' THEN NULL ELSE round_even(value * 10, 0) / 10000 END AS no_speech FROM events")
def confidence(spark, d):
    """A null stays null."""
    e = S.table(spark, d, "events")
    return e.select("event_id", (F.rint(F.exp(-F.col("value") / 100) * 10000) / 10000).alias("confidence"), F.when(F.col("event_type") != "error", F.rint(F.col("value") * 10) / 10000).alias("no_speech"))


@query(f"WITH {CONV} SELECT video_id, idx, 'seg_' || lpad(idx::VARCHAR, 5, '0') AS seg_id, CASE WHEN idx = 0 THEN 'seg_00000' ELSE 'seg_00000–seg_' || lpad(idx::VARCHAR, 5, '0') END AS range_id FROM conv")
def id_format(spark, d):
    """P7."""
    return S.conversation_segments(spark, d).select("video_id", "idx", C.numbered_id("seg", F.col("idx")).alias("seg_id"), C.range_id("seg", F.lit(0), F.col("idx")).alias("range_id"))


@query("SELECT o_orderkey, array_to_string(list_transform(range(o_custkey % 7, o_custkey % 7 + 1 + o_orderkey % 5), lambda i: 'seg_' || lpad(i::VARCHAR, 5, '0')), ',') AS ids FROM orders")
def segment_id_list(spark, d):
    """P8."""
    first = F.col("o_custkey") % 7
    return S.table(spark, d, "orders").select("o_orderkey", F.array_join(segment_ids(first, first + F.col("o_orderkey") % 5), ",").alias("ids"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 AND l_tax <> 0 THEN round(l_discount / l_tax, 6) END AS rtf FROM lineitem")
def real_time_factor(spark, d):
    """P10."""
    return S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.ratio(F.col("l_discount"), F.col("l_tax")), 6).alias("rtf"))


@query("SELECT c_custkey, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, c_acctbal / 5000)), 6) AS progress FROM customer")
def progress_fraction(spark, d):
    """P11."""
    return S.table(spark, d, "customer").select("c_custkey", F.round(C.fraction(F.col("c_acctbal"), F.lit(5000.0)), 6).alias("progress"))


@query("""WITH a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 500)::VARCHAR WHEN 1 THEN (event_id % 90)::VARCHAR || ':' || (event_id % 60)::VARCHAR
  WHEN 2 THEN '01:' || (event_id % 60)::VARCHAR || ':30.5' ELSE '1:x' END AS arg FROM events)
SELECT event_id, arg, CASE event_id % 4 WHEN 0 THEN (event_id % 500)::DOUBLE WHEN 1 THEN ((event_id % 90) * 60 + event_id % 60)::DOUBLE WHEN 2 THEN 3600 + (event_id % 60) * 60 + 30.5::DOUBLE END AS seconds FROM a""")
def time_parse(spark, d):
    """P12."""
    i = F.col("event_id")
    s = lambda x: x.cast("string")
    arg = F.when(i % 4 == 0, s(i % 500)).when(i % 4 == 1, F.concat(s(i % 90), F.lit(":"), s(i % 60))).when(i % 4 == 2, F.concat(F.lit("01:"), s(i % 60), F.lit(":30.5"))).otherwise("1:x")
    return S.table(spark, d, "events").select("event_id", arg.alias("arg")).withColumn("seconds", C.parse_time(F.col("arg")))


_T10 = "(round_even(greatest(t, 0) * 10, 0))::BIGINT"


@query(f"""WITH x AS (SELECT event_id, value * 37 - 100 AS t FROM events), y AS (SELECT event_id, {_T10} AS k FROM x)
SELECT event_id, CASE WHEN k >= 36000 THEN (k // 36000)::VARCHAR || ':' || lpad((k % 36000 // 600)::VARCHAR, 2, '0') ELSE (k // 600)::VARCHAR END || ':' || lpad((k % 600 // 10)::VARCHAR, 2, '0') || '.' || (k % 10)::VARCHAR AS stamp FROM y""")
def fmt_timestamp(spark, d):
    """M1."""
    return S.table(spark, d, "events").select("event_id", C.format_timestamp(F.col("value") * 37 - 100).alias("stamp"))


@query("""WITH x AS (SELECT event_id, greatest(floor(value * 37 - 100), 0)::BIGINT AS k FROM events)
SELECT event_id, lpad((k // 3600)::VARCHAR, 2, '0') || ':' || lpad((k % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((k % 60)::VARCHAR, 2, '0') AS clock FROM x""")
def fmt_clock(spark, d):
    """M2."""
    return S.table(spark, d, "events").select("event_id", C.format_clock(F.col("value") * 37 - 100).alias("clock"))


_CUE = "lpad((k // 3600000)::VARCHAR, 2, '0') || ':' || lpad((k % 3600000 // 60000)::VARCHAR, 2, '0') || ':' || lpad((k % 60000 // 1000)::VARCHAR, 2, '0') || '{}' || lpad((k % 1000)::VARCHAR, 3, '0')"


@query(f"""WITH x AS (SELECT event_id, greatest(round_even((value * 37 - 100) * 1000, 0), 0)::BIGINT AS k FROM events)
SELECT event_id, {_CUE.format(',')} AS srt, {_CUE.format('.')} AS vtt FROM x""")
def fmt_srt_time(spark, d):
    """M3."""
    t = F.col("value") * 37 - 100
    return S.table(spark, d, "events").select("event_id", C.format_cue_time(t, ",").alias("srt"), C.format_cue_time(t, ".").alias("vtt"))


def stamp_sql(t: str) -> str:
    k = f"(round_even(greatest({t}, 0) * 10, 0))::BIGINT"
    return f"(CASE WHEN {k} >= 36000 THEN ({k} // 36000)::VARCHAR || ':' || lpad(({k} % 36000 // 600)::VARCHAR, 2, '0') ELSE ({k} // 600)::VARCHAR END || ':' || lpad(({k} % 600 // 10)::VARCHAR, 2, '0') || '.' || ({k} % 10)::VARCHAR)"


@query(f"WITH {CONV} SELECT video_id, idx, {stamp_sql('start_s')} || '–' || {stamp_sql('end_s')} AS span FROM conv")
def fmt_span(spark, d):
    """M4."""
    return S.conversation_segments(spark, d).select("video_id", "idx", C.format_span(F.col("start_s"), F.col("end_s")).alias("span"))


@query("SELECT user_id, substr(sha256(string_agg(props, ';' ORDER BY event_id)), 1, 24) AS config_key FROM events GROUP BY user_id")
def config_hash(spark, d):
    """M8."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda x: x["props"])
    return S.table(spark, d, "events").groupBy("user_id").agg(C.config_key(F.array_join(rows, ";")).alias("config_key"))


@query(f"WITH {SEG} SELECT video_id, idx, ceil(length(text) / 3.5)::BIGINT AS n_tokens FROM seg")
def estimate_tokens(spark, d):
    """T12."""
    return S.segments(spark, d).select("video_id", "idx", T.estimate_tokens(F.col("text")).alias("n_tokens"))


@query(f"""WITH {SEG} SELECT video_id, idx, regexp_matches(rtrim(text), '[.!?。！？…؟।]["''”’»)\\]]*$') AS ends FROM seg""")
def ends_sentence(spark, d):
    """T10."""
    return S.segments(spark, d).select("video_id", "idx", T.ends_sentence(F.col("text")).alias("ends"))


@query("SELECT doc_id, right(text, 200) AS tail, left(text, 12000) AS head FROM documents")
def truncate_text(spark, d):
    """The length of what is shown, which is the feature."""
    return S.table(spark, d, "documents").select("doc_id", F.right("text", F.lit(200)).alias("tail"), F.left("text", F.lit(12000)).alias("head"))


@query("SELECT item_id, 'data:text/plain;base64,' || to_base64(encode(text)) AS url FROM benchmark")
def data_url(spark, d):
    """T16."""
    return S.table(spark, d, "benchmark").select("item_id", F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "")).alias("url"))
