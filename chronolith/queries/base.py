"""Registration, and the SQL of the derived timeline tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def _timed(source: str, target: str) -> str:
    return f"""{target}_t AS (SELECT *, 400 + 60 * length(text) AS dur_ms, CASE WHEN idx % 7 = 6 THEN 9000 WHEN idx % 3 = 2 THEN 700 ELSE 100 END AS gap_ms FROM {source}),
{target}_m AS (SELECT video_id, idx, text, dur_ms, coalesce(sum(dur_ms + gap_ms) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM {target}_t),
{target} AS (SELECT video_id, idx, start_ms / 1000.0::DOUBLE AS start_s, (start_ms + dur_ms) / 1000.0::DOUBLE AS end_s, text FROM {target}_m)"""


SEG = (
    """line AS (SELECT doc_id AS video_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
lines AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY pos) - 1 AS idx, text FROM line WHERE length(trim(text)) > 0),
"""
    + _timed("lines", "seg")
)
CONV = "turns AS (SELECT conv_id AS video_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, text FROM conversations),\n" + _timed("turns", "conv")
TOK = SEG + r""",
tok AS (SELECT *, regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[\p{L}\p{N}\p{M}]+') AS tokens FROM seg)"""
SPEECH = """ev AS (SELECT user_id % 10 AS stream_id, event_id, event_type, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS w FROM events),
speech AS (SELECT stream_id, w, CASE WHEN (w + 7 * stream_id) % 97 < 61 THEN CASE WHEN event_type = 'error' THEN 0.3::DOUBLE ELSE 0.9::DOUBLE END
  WHEN event_type = 'error' AND event_id % 11 = 0 THEN 0.6::DOUBLE WHEN event_type = 'error' THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END AS p FROM ev)"""
THUMB = """thumb AS (SELECT label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, vec_id AS frame_id,
  list_transform(embedding, lambda e: floor((e::DOUBLE + 1) * 127.5)::INTEGER) AS pixels FROM embeddings)"""
SPANS = """spans AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + round_even(value * 1000, 0)::BIGINT AS end_ms FROM events)"""
RUNS = """runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS kind, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'partial' END AS status,
  o_totalprice::DOUBLE AS processed_until, o_orderdate AS updated_at FROM orders)"""
