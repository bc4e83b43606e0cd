"""Chunks, exports, speech regions, packs and time maps."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as K
from ..operators import export as E
from ..operators import speech as P
from ..sources import tables as S
from .base import CONV, SEG, SPEECH, query
from .scalars import _CUE, stamp_sql


@query(f"WITH {SEG} SELECT video_id, array_to_string(list_filter(list(trim(text) ORDER BY idx), lambda x: x <> ''), ' ') AS text FROM seg GROUP BY video_id")
def join_texts(spark, d):
    """T11, A7."""
    return S.segments(spark, d).groupBy("video_id").agg(T.join_texts(K.ordered_texts()).alias("text"))


@query(f"WITH {SEG} SELECT video_id, idx, round(start_s - lag(end_s) OVER (PARTITION BY video_id ORDER BY idx), 6) AS gap FROM seg")
def segment_gap(spark, d):
    """W7."""
    return S.segments(spark, d).select("video_id", "idx", F.round(F.col("start_s") - F.lag("end_s").over(W.partitionBy("video_id").orderBy("idx")), 6).alias("gap"))


def chunk_sql(source: str) -> str:
    """The rows of a relation with first_segment, by recursion over its rows."""
    close = "g.first_s IS NULL OR o.end_s - g.first_s > 60 OR (o.start_s - g.last_s >= 8 AND g.last_s - g.first_s >= 10) OR (o.start_s - g.last_s >= 0.5 AND g.last_s - g.first_s >= 40)"
    first = f"CASE WHEN {close} THEN o.start_s ELSE g.first_s END"
    done = "(({e} - {f} >= 20 AND {stop}) OR {e} - {f} >= 60)"
    return f"""st AS (SELECT *, regexp_matches(rtrim(text), '[.!?。！？…؟।]["''”’»)\\]]*$') AS stop FROM {source}),
ch AS (SELECT video_id, idx, idx AS first_segment, CASE WHEN {done.format(e='end_s', f='start_s', stop='stop')} THEN NULL ELSE start_s END AS first_s, end_s AS last_s FROM st WHERE idx = 0
  UNION ALL SELECT o.video_id, o.idx, CASE WHEN {close} THEN o.idx ELSE g.first_segment END,
    CASE WHEN {done.format(e='o.end_s', f='(' + first + ')', stop='o.stop')} THEN NULL ELSE {first} END, o.end_s FROM ch g JOIN st o ON o.video_id = g.video_id AND o.idx = g.idx + 1)"""


_CHUNKS = f"""{SEG}, {chunk_sql('seg')},
chunks AS (SELECT video_id, first_segment, max(s.idx) AS last_segment, min(s.start_s) AS start_s, max(s.end_s) AS end_s,
  array_to_string(list_filter(list(trim(s.text) ORDER BY s.idx), lambda x: x <> ''), ' ') AS text FROM seg s JOIN ch USING (video_id, idx) GROUP BY video_id, first_segment)"""


@query(f"WITH RECURSIVE {_CHUNKS} SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY first_segment) - 1 AS idx FROM chunks")
def chunks(spark, d):
    """C1, W3."""
    return K.chunks(S.segments(spark, d))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT s.video_id, s.idx, row_number() OVER (PARTITION BY s.video_id, s.idx) AS n, c.first_segment, c.last_segment FROM seg s JOIN chunks c ON c.video_id = s.video_id AND s.idx BETWEEN c.first_segment AND c.last_segment")
def chunk_backref(spark, d):
    """A segment's chunk, by range of index: the range is exploded into an equi join."""
    seg = S.segments(spark, d)
    own = K.chunks(seg).select("video_id", "first_segment", "last_segment", F.explode(F.sequence("first_segment", "last_segment")).alias("idx"))
    out = seg.join(own, ["video_id", "idx"])
    return out.select("video_id", "idx", F.row_number().over(W.partitionBy("video_id", "idx").orderBy("first_segment")).alias("n"), "first_segment", "last_segment")


def _cue(t: str, mark: str) -> str:
    return "(" + _CUE.format(mark).replace("(k ", f"((greatest(round_even({t} * 1000, 0), 0)::BIGINT) ") + ")"


@query(f"""WITH {CONV} SELECT video_id, string_agg((idx + 1)::VARCHAR || chr(10) || {_cue('start_s', ',')} || ' --> ' || {_cue('end_s', ',')} || chr(10) || text || chr(10), chr(10) ORDER BY idx) AS srt FROM conv GROUP BY video_id""")
def export_srt(spark, d):
    """K7."""
    return E.to_srt(S.conversation_segments(spark, d))


@query(f"""WITH {CONV} SELECT video_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_cue('start_s', '.')} || ' --> ' || {_cue('end_s', '.')} || chr(10) || text || chr(10), chr(10) ORDER BY idx) AS vtt FROM conv GROUP BY video_id""")
def export_vtt(spark, d):
    """K7."""
    return E.to_vtt(S.conversation_segments(spark, d))


@query(f"""WITH {CONV} SELECT video_id, '# Transcript' || chr(10) || chr(10) || string_agg('**[' || {stamp_sql('start_s')} || ']** ' || text, chr(10) || chr(10) ORDER BY idx) || chr(10) AS md FROM conv GROUP BY video_id""")
def export_md(spark, d):
    """K7."""
    return E.to_markdown(S.conversation_segments(spark, d))


@query(f"WITH {CONV} SELECT video_id, string_agg(text, chr(10) ORDER BY idx) AS txt FROM conv GROUP BY video_id")
def export_text(spark, d):
    """K7."""
    return E.to_text(S.conversation_segments(spark, d))


@query(f"""WITH {CONV} SELECT video_id, '{{"segments":[' || string_agg('{{"id":"seg_' || lpad(idx::VARCHAR, 5, '0') || '","start":' || start_s::VARCHAR || ',"end":' || end_s::VARCHAR || ',"text":' || to_json(text)::VARCHAR || ',"language":null}}', ',' ORDER BY idx) || ']}}' AS json FROM conv GROUP BY video_id""")
def export_json(spark, d):
    """Nulls are kept."""
    return E.to_json(S.conversation_segments(spark, d))


_PIECES = """pieces AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, value AS v, event_type FROM events)"""


def _pieces(spark, d):
    e = S.table(spark, d, "events")
    return e.select(F.col("user_id").alias("stream_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("seq"), F.col("value").alias("v"), "event_type")


@query(f"""WITH RECURSIVE {_PIECES}, b AS (SELECT stream_id, seq, seq * 2 + CASE event_type WHEN 'error' THEN -1.5 WHEN 'click' THEN 0.5 ELSE 0 END::DOUBLE AS pos, 2.0::DOUBLE AS dur FROM pieces),
r AS (SELECT stream_id, seq, pos + dur AS due, true AS kept, 0.0::DOUBLE AS gap FROM b WHERE seq = 0
  UNION ALL SELECT b.stream_id, b.seq, CASE WHEN b.pos - r.due < -0.1 THEN r.due ELSE b.pos + b.dur END, b.pos - r.due >= -0.1, CASE WHEN b.pos - r.due > 0.1 THEN b.pos - r.due ELSE 0 END FROM r JOIN b ON b.stream_id = r.stream_id AND b.seq = r.seq + 1)
SELECT stream_id, seq, gap FROM r WHERE kept""")
def gap_fill(spark, d):
    """S3, ST3."""
    shift = F.when(F.col("event_type") == "error", -1.5).when(F.col("event_type") == "click", 0.5).otherwise(0.0)
    blocks = _pieces(spark, d).select("stream_id", "seq", (F.col("seq") * 2 + shift).alias("at"), F.lit(2.0).alias("dur"))
    return P.align(blocks).select("stream_id", "seq", "gap")


@query(f"""WITH {_PIECES}, p AS (SELECT *, 500 + (v * 7)::INTEGER % 900 AS n FROM pieces), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 5000 AS block FROM p)
SELECT stream_id, block::BIGINT AS block, sum(n)::BIGINT AS samples, min(seq) AS first_seq FROM c GROUP BY stream_id, block""")
def block_assembly(spark, d):
    """S4."""
    pieces = _pieces(spark, d).withColumn("n", 500 + F.rint(F.col("v") * 7).cast("int") % 900)
    return P.assemble_blocks(pieces, 5000).groupBy("stream_id", "block").agg(F.sum("n").alias("samples"), F.min("seq").alias("first_seq"))


#: The detector, one window a step, then padding and merging, one span a step.  Samples: 28 s 448000, padding 3200,
#: least speech 4000, least silence 8000, silence to cut at 1568, merge gap 5600.
_VAD = f"""{SPEECH},
det AS (SELECT stream_id, -1::BIGINT AS w, NULL::BIGINT AS onset, 0::BIGINT AS quiet, 0::BIGINT AS cut, 0::BIGINT AS resume, NULL::BIGINT AS s, NULL::BIGINT AS e FROM speech WHERE w = 0
  UNION ALL SELECT stream_id, w, CASE WHEN fin THEN NULL ELSE onset2 END, CASE WHEN fin THEN 0 ELSE quiet3 END, CASE WHEN fin THEN 0 ELSE cut3 END, CASE WHEN fin THEN 0 ELSE resume2 END,
    CASE WHEN over THEN onset1 WHEN fin AND quiet3 - onset2 > 4000 THEN onset2 END, CASE WHEN over AND cut = 0 THEN now WHEN over THEN cut WHEN fin AND quiet3 - onset2 > 4000 THEN quiet3 END
  FROM (SELECT *, now - quiet3 >= 8000 AND low AS fin, CASE WHEN low AND now - quiet3 > 1568 THEN quiet3 ELSE cut2 END AS cut3
    FROM (SELECT *, CASE WHEN low AND quiet2 = 0 THEN now ELSE quiet2 END AS quiet3
      FROM (SELECT *, onset2 IS NOT NULL AND NOT begun AND p < 0.35 AS low
        FROM (SELECT *, CASE WHEN begun THEN now WHEN over AND cut = 0 THEN NULL WHEN over THEN CASE WHEN resume1 < cut THEN NULL ELSE resume1 END ELSE onset1 END AS onset2,
            CASE WHEN over THEN 0 ELSE quiet1 END AS quiet2, CASE WHEN over THEN 0 ELSE cut END AS cut2, CASE WHEN over THEN 0 ELSE resume1 END AS resume2
          FROM (SELECT o.stream_id, o.w, o.p, o.w * 512 AS now, g.onset AS onset1, g.cut, o.p >= 0.5 AND g.onset IS NULL AS begun, coalesce(o.w * 512 - g.onset > 448000 - 512 - 6400, false) AS over,
              CASE WHEN o.p >= 0.5 THEN 0 ELSE g.quiet END AS quiet1, CASE WHEN o.p >= 0.5 AND g.quiet > 0 AND g.resume < g.cut THEN o.w * 512 ELSE g.resume END AS resume1
            FROM det g JOIN speech o ON o.stream_id = g.stream_id AND o.w = g.w + 1)))))),
ends AS (SELECT stream_id, (max(w) + 1) * 512 AS total FROM speech GROUP BY stream_id),
spans AS (SELECT stream_id, s, e FROM det WHERE s IS NOT NULL
  UNION ALL SELECT d.stream_id, d.onset, n.total FROM det d JOIN ends n ON n.stream_id = d.stream_id AND d.w = n.total // 512 - 1 WHERE n.total - d.onset > 4000),
num AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY s) AS k FROM spans),
reg AS (SELECT stream_id, k, greatest(s - 3200, 0) AS a, e + 3200 AS b, e AS raw, 0::BIGINT AS settled, NULL::BIGINT AS x, NULL::BIGINT AS y FROM num WHERE k = 1
  UNION ALL SELECT stream_id, k, CASE WHEN joins THEN a WHEN lo < b THEN mid ELSE greatest(lo, b) END, CASE WHEN joins THEN greatest(b, hi) ELSE hi END, e,
    CASE WHEN joins THEN settled WHEN lo < b THEN mid ELSE b END, CASE WHEN joins THEN NULL ELSE a END, CASE WHEN joins THEN NULL WHEN lo < b THEN mid ELSE b END
  FROM (SELECT *, lo - b <= 5600 AND hi - a <= 448000 AS joins, greatest(a + 1, (raw + s) // 2) AS mid
    FROM (SELECT n.stream_id, n.k, n.s, n.e, g.a, g.b, g.raw, g.settled, greatest(n.s - 3200, g.settled, 0) AS lo, n.e + 3200 AS hi FROM reg g JOIN num n ON n.stream_id = g.stream_id AND n.k = g.k + 1))),
found AS (SELECT stream_id, x AS s, y AS e FROM reg WHERE x IS NOT NULL UNION ALL SELECT stream_id, a, b FROM reg QUALIFY k = max(k) OVER (PARTITION BY stream_id))"""


@query(f"""WITH RECURSIVE {_VAD} SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY s) - 1 AS region, s AS start_sample, least(e, total) AS end_sample
FROM found JOIN ends USING (stream_id) WHERE least(e, total) > s""")
def vad_regions(spark, d):
    """C4."""
    return P.speech_regions(S.speech_windows(spark, d))


@query(f"""WITH {SPEECH}, t AS (SELECT stream_id, (max(w) + 1) * 512 AS total FROM speech GROUP BY stream_id),
r AS (SELECT stream_id, unnest(range(0, (total - 1) // 80000 + 1)) AS region, total FROM t)
SELECT stream_id, region, region * 80000 AS start_sample, least((region + 1) * 80000, total) AS end_sample FROM r WHERE least((region + 1) * 80000, total) - region * 80000 >= 3200""")
def vad_fixed(spark, d):
    """C5, ST4, over windows of 5 s."""
    return P.fixed_regions(S.speech_windows(spark, d), 5.0)


#: Regions as (stream_id, region, start_sample, end_sample), cut from runs of loud windows.
_REGIONS = f"""{SPEECH}, loud AS (SELECT stream_id, w, w - row_number() OVER (PARTITION BY stream_id ORDER BY w) AS island FROM speech WHERE p >= 0.5),
runs AS (SELECT stream_id, min(w) * 512 AS start_sample, (max(w) + 1) * 512 AS end_sample FROM loud GROUP BY stream_id, island),
region AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_sample) - 1 AS region, start_sample, end_sample FROM runs)"""


def _regions(spark, d):
    loud = S.speech_windows(spark, d).filter("p >= 0.5")
    island = F.col("w") - F.row_number().over(W.partitionBy("stream_id").orderBy("w"))
    runs = loud.withColumn("island", island).groupBy("stream_id", "island").agg((F.min("w") * 512).cast("long").alias("start_sample"), ((F.max("w") + 1) * 512).cast("long").alias("end_sample"))
    return runs.select("stream_id", (F.row_number().over(W.partitionBy("stream_id").orderBy("start_sample")) - 1).alias("region"), "start_sample", "end_sample")


@query(f"WITH {_REGIONS} SELECT * FROM region")
def loud_runs(spark, d):
    """Runs of loud windows, as regions."""
    return _regions(spark, d)


_LIMIT = "CASE WHEN g.sent = 0 THEN 32000 ELSE 96000 END"
_CLOSE = f"(g.size > 0 AND (g.size + o.n > {_LIMIT} OR o.start_sample - g.last > 16000))"
_PACKS = f"""{_REGIONS}, o AS (SELECT *, end_sample - start_sample AS n FROM region),
pk AS (SELECT stream_id, region, CASE WHEN n >= 32000 THEN 0 ELSE n END AS size, end_sample AS last, CASE WHEN n >= 32000 THEN 1 ELSE 0 END AS sent, 0 AS pack FROM o WHERE region = 0
  UNION ALL SELECT o.stream_id, o.region,
    CASE WHEN {_CLOSE} THEN o.n WHEN g.size + o.n >= {_LIMIT} THEN 0 ELSE g.size + o.n END, o.end_sample,
    g.sent + CASE WHEN {_CLOSE} OR g.size + o.n >= {_LIMIT} THEN 1 ELSE 0 END,
    g.pack + CASE WHEN {_CLOSE} OR g.size = 0 THEN 1 ELSE 0 END FROM pk g JOIN o ON o.stream_id = g.stream_id AND o.region = g.region + 1),
packed AS (SELECT o.stream_id, pack, region, start_sample, end_sample, coalesce(sum(n) OVER (PARTITION BY o.stream_id, pack ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM o JOIN pk USING (stream_id, region))"""


def _packs(spark, d):
    return P.packs(_regions(spark, d), most=6.0, first=2.0, join_gap=1.0)


@query(f"WITH RECURSIVE {_PACKS} SELECT * FROM packed")
def packs(spark, d):
    """C6."""
    return _packs(spark, d)


@query(f"""WITH RECURSIVE {_PACKS}, q AS (SELECT DISTINCT stream_id, pack, unnest([0.0, 0.4, 1.024, 2.5, 99.0])::DOUBLE AS t FROM packed),
a AS (SELECT q.*, p."offset", p.start_sample, p.end_sample - p.start_sample AS n FROM q JOIN packed p USING (stream_id, pack) WHERE p."offset" <= q.t * 16000 QUALIFY row_number() OVER (PARTITION BY q.stream_id, q.pack, q.t ORDER BY p."offset" DESC) = 1)
SELECT stream_id, pack, t, round((start_sample + least(t * 16000 - "offset", n)) / 16000, 6) AS media_s FROM a""")
def pack_time_map(spark, d):
    """J9."""
    times = F.explode(F.array(*map(F.lit, (0.0, 0.4, 1.024, 2.5, 99.0))))
    rows = P.pack_regions(_packs(spark, d)).withColumn("t", times)
    return rows.select("stream_id", "pack", "t", F.round(P.media_time(F.col("regions"), F.col("t") * 16000, False) / 16000, 6).alias("media_s"))


@query(f"""WITH RECURSIVE {_PACKS}, q AS (SELECT DISTINCT stream_id, pack, unnest([0.0, 0.3, 0.7, 1.5])::DOUBLE AS a FROM packed), sp AS (SELECT *, a * 16000 AS s, (a + 1.2) * 16000 AS e FROM q),
c AS (SELECT sp.*, p."offset", p.start_sample, p.end_sample - p.start_sample AS n, least(e, p."offset" + p.end_sample - p.start_sample) - greatest(s, p."offset") AS cov FROM sp JOIN packed p USING (stream_id, pack)),
agg AS (SELECT stream_id, pack, a, count(*) FILTER (cov > 0) AS k, min("offset") FILTER (cov >= least(16000, 0.25 * (e - s)) AND cov > 0) AS f, max("offset" + n) FILTER (cov >= least(16000, 0.25 * (e - s)) AND cov > 0) AS l,
  min("offset") FILTER (cov > 0) AS f0, max("offset" + n) FILTER (cov > 0) AS l0 FROM c GROUP BY ALL),
x AS (SELECT sp.stream_id, sp.pack, sp.a, CASE WHEN k > 1 THEN greatest(s, coalesce(f, f0)) ELSE s END AS s, CASE WHEN k > 1 THEN least(e, coalesce(l, l0)) ELSE e END AS e FROM sp JOIN agg USING (stream_id, pack, a)),
m AS (SELECT x.stream_id, x.pack, x.a, max_by(p.start_sample + least(greatest(x.s - p."offset", 0), p.end_sample - p.start_sample), p."offset") FILTER (p."offset" <= x.s) AS b,
  max_by(p.start_sample + least(greatest(x.e - p."offset", 0), p.end_sample - p.start_sample), p."offset") FILTER (p."offset" < x.e) AS c FROM x JOIN packed p USING (stream_id, pack) GROUP BY ALL)
SELECT stream_id, pack, a, round(b / 16000, 6) AS start_s, round(greatest(b, c) / 16000, 6) AS end_s FROM m""")
def seam_trim(spark, d):
    """J10."""
    rows = P.pack_regions(_packs(spark, d)).withColumn("a", F.explode(F.array(*map(F.lit, (0.0, 0.3, 0.7, 1.5)))))
    rows = rows.withColumn("x", P.map_span(F.col("regions"), F.col("a"), F.col("a") + 1.2))
    return rows.select("stream_id", "pack", "a", F.round("x.start_s", 6).alias("start_s"), F.round("x.end_s", 6).alias("end_s"))


def _assigned(spark, d, windows):
    from ..operators.windows import asof_backward

    begins = _packs(spark, d).groupBy("stream_id", "pack").agg((F.min("start_sample") / 16000.0).alias("begin_s"))
    q = windows.select("stream_id", "w", (F.col("w") * 512 / 16000.0 + 0.001).alias("t"))
    return asof_backward(q, begins, ["stream_id"], "t", "begin_s", "pack").filter("pack is not null").select("stream_id", "w", "pack")


_ASSIGNED = f"""WITH RECURSIVE {_PACKS}, q AS (SELECT stream_id, w, w * 512 / 16000.0::DOUBLE AS t FROM speech), off AS (SELECT stream_id, pack, min(start_sample) / 16000.0::DOUBLE AS begin_s FROM packed GROUP BY ALL)
SELECT q.stream_id, q.w, max(off.pack) AS pack FROM q JOIN off ON off.stream_id = q.stream_id AND off.begin_s <= q.t + 0.001 GROUP BY ALL"""


@query(_ASSIGNED)
def batch_assignment(spark, d):
    """Results of a batch, every window, to the pack that begins last before them, with a millisecond of slack."""
    return _assigned(spark, d, S.speech_windows(spark, d))


@query(f"WITH {_REGIONS} SELECT stream_id, count(*) AS regions, round(sum(end_sample - start_sample) / 16000, 6) AS speech_s, round(sum(end_sample - start_sample) / max(end_sample), 6) AS density FROM region GROUP BY stream_id")
def speech_seconds(spark, d):
    """A15."""
    n = F.sum(F.col("end_sample") - F.col("start_sample"))
    return _regions(spark, d).groupBy("stream_id").agg(F.count("*").alias("regions"), F.round(n / 16000, 6).alias("speech_s"), F.round(n / F.max("end_sample"), 6).alias("density"))
