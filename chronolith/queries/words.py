"""Tokens, stems, terms and the statistics behind BM25."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import postings as P
from ..plans import search as Q
from ..sources import tables as S
from .base import SEG, TOK, query

#: The queries that the search operators answer here.
TEXTS = {0: "thanedble eriner thtion", 1: "attion ertion", 2: "of the"}
PARSED = {q: P.Query.parse(t) for q, t in TEXTS.items()}


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def units_sql() -> str:
    rows = ", ".join(f"({q}, {u}, '{kind}', {sql_list(words)})" for q, x in PARSED.items() for u, (kind, words) in enumerate(x.units()))
    return f"units(query_id, unit, kind, words) AS (VALUES {rows})"


FREQ = TOK + f""",
{units_sql()},
freq AS (SELECT * FROM (SELECT u.query_id, u.unit, u.kind, t.video_id, t.idx, len(t.tokens) AS dl, CASE u.kind WHEN 'term' THEN len(list_filter(t.tokens, lambda x: x = u.words[1]))
  WHEN 'prefix' THEN len(list_filter(t.tokens, lambda x: starts_with(x, u.words[1])))
  ELSE len(list_filter(range(1, len(t.tokens) - len(u.words) + 2), lambda i: t.tokens[i:i + len(u.words) - 1] = u.words)) END AS tf FROM tok t, units u) WHERE tf > 0),
stats AS (SELECT video_id, count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM tok GROUP BY video_id)"""


def bm25_sql(where: str = "true") -> str:
    return f"""scored AS (SELECT f.query_id, f.video_id, f.idx, sum(CASE WHEN ln((s.n_docs - n.n + 0.5) / (n.n + 0.5)) > 0 THEN ln((s.n_docs - n.n + 0.5) / (n.n + 0.5)) ELSE 1e-6 END
  * f.tf * 2.2 / (f.tf + 1.2 * (1 - 0.75 + 0.75 * f.dl / s.avgdl))) AS score
  FROM freq f JOIN stats s USING (video_id) JOIN (SELECT query_id, unit, video_id, count(*) AS n FROM freq GROUP BY ALL) n USING (query_id, unit, video_id)
  WHERE {where} GROUP BY f.query_id, f.video_id, f.idx)"""


@query(f"WITH {SEG} SELECT video_id, idx, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS tokens FROM seg WHERE regexp_full_match(text, '[\\x00-\\x7F]*')")
def tokenize_ascii(spark, d):
    """T3 over ASCII text."""
    return S.segments(spark, d).filter(F.col("text").rlike(T.ASCII_ONLY)).select("video_id", "idx", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query(f"WITH {TOK} SELECT video_id, idx, array_to_string(tokens, ' ') AS tokens FROM tok")
def tokenize_unicode(spark, d):
    """T1, T3."""
    return S.segments(spark, d).select("video_id", "idx", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT doc_id, strip_accents(replace(lower(text), 'ß', 'ss')) AS folded FROM documents")
def fold_accents(spark, d):
    """T4."""
    return S.table(spark, d, "documents").select("doc_id", T.fold_accents(F.col("text")).alias("folded"))


@query(f"""WITH {TOK}, w AS (SELECT DISTINCT unnest(tokens) AS word FROM tok)
SELECT word, CASE WHEN length(word) < 5 OR NOT regexp_full_match(word, '\\p{{L}}+') THEN NULL
  WHEN regexp_matches(word, '^.{{4,}}({'|'.join(T.suffixes())})$') THEN (SELECT left(word, length(word) - max(length(s))) FROM (SELECT unnest({sql_list(T.suffixes())}) AS s) WHERE suffix(word, s) AND length(word) - length(s) >= 4)
  WHEN regexp_matches(word, '[^s]s$') THEN left(word, length(word) - 1) END AS stem FROM w""")
def light_stem(spark, d):
    """T6 over every distinct token."""
    words = P.index(S.segments(spark, d)).select(F.explode("tokens").alias("word")).distinct()
    return words.select("word", T.light_stem(F.col("word")).alias("stem"))


@query(f"""WITH {TOK}, c AS (SELECT video_id, idx, tokens, list_filter(tokens, lambda x: NOT list_contains({sql_list(T.stop_words())}, x)) AS content FROM tok)
SELECT video_id, idx, array_to_string(CASE WHEN len(content) > 0 THEN content ELSE tokens END, ' ') AS words FROM c""")
def stopword_filter(spark, d):
    """T5."""
    return P.index(S.segments(spark, d)).select("video_id", "idx", F.array_join(T.without_stop_words(F.col("tokens")), " ").alias("words"))


@query("WITH t AS (SELECT vec_id, left('部署失败我们讨论', (vec_id % 9)::INTEGER) AS run FROM embeddings) SELECT vec_id, run, CASE WHEN length(run) = 0 THEN '' WHEN length(run) <= 2 THEN run ELSE array_to_string(list_transform(range(1, length(run)), lambda i: substring(run, i, 2)), ' ') END AS grams FROM t")
def cjk_bigrams(spark, d):
    """T7, T2."""
    run = F.left(F.lit("部署失败我们讨论"), (F.col("vec_id") % 9).cast("int"))
    return S.table(spark, d, "embeddings").select("vec_id", run.alias("run")).withColumn("grams", F.array_join(T.cjk_bigrams(F.col("run")), " "))


@query(f"""WITH t(query_id, pos, term, stem) AS (VALUES {', '.join(f"({q}, {i}, '{t.text}', {repr(t.stem) if t.stem else 'NULL'})" for q, x in PARSED.items() for i, t in enumerate(x.terms))}) SELECT * FROM t""")
def match_terms(spark, d):
    """A query's terms and stems, by the rules of the batch functions."""
    rows = spark.createDataFrame([(q, t) for q, t in TEXTS.items()], "query_id int, text string")
    words = rows.select("query_id", F.posexplode(F.array_distinct(T.without_stop_words(T.tokens(F.col("text"))))).alias("pos", "term"))
    return words.withColumn("stem", T.light_stem(F.col("term")))


_MATCHED = " || ".join(
    f"""CASE WHEN query_id = {q} THEN array_to_string(list_filter([{', '.join(f"CASE WHEN list_contains(tokens, '{t.text}')" + (f" OR len(list_filter(tokens, lambda x: starts_with(x, '{t.stem}'))) > 0" if t.stem else "") + f" THEN '{t.text}' END" for t in x.terms)}], lambda x: x IS NOT NULL), ' ') ELSE '' END"""
    for q, x in PARSED.items()
)


@query(f"WITH {TOK}, q(query_id) AS (VALUES {', '.join(f'({q})' for q in TEXTS)}) SELECT query_id, video_id, idx, {_MATCHED} AS matched FROM tok, q WHERE ({_MATCHED}) <> ''")
def matched_terms(spark, d):
    """For each query, segments with at least one term, and their terms."""
    tokens = P.index(S.segments(spark, d)).select("video_id", "idx", "tokens")
    rows = tokens.withColumn("query_id", F.explode(F.array(*map(F.lit, TEXTS))))
    return rows.select("query_id", "video_id", "idx", F.array_join(Q.matched_terms(F.col("query_id"), F.col("tokens"), PARSED), " ").alias("matched")).filter("matched <> ''")


@query(f"WITH {TOK} SELECT video_id, idx, contains(' ' || array_to_string(tokens, ' ') || ' ', ' of the ') AS has_phrase FROM tok")
def contains_phrase(spark, d):
    """T9."""
    return P.index(S.segments(spark, d)).select("video_id", "idx", T.contains_phrase(F.col("tokens"), F.lit("of the")).alias("has_phrase"))


@query(f"WITH {TOK}, w AS (SELECT video_id, idx, unnest(tokens) AS term FROM tok) SELECT video_id, term, count(DISTINCT idx) AS df, count(*) AS tf FROM w GROUP BY video_id, term")
def term_stats(spark, d):
    """A11, A12."""
    return P.postings(P.index(S.segments(spark, d))).groupBy("video_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"WITH {TOK} SELECT video_id, count(*) AS n_docs, round(avg(len(tokens)), 6) AS avgdl FROM tok GROUP BY video_id")
def corpus_stats(spark, d):
    """A11."""
    return P.corpus_stats(P.index(S.segments(spark, d))).select("video_id", "n_docs", F.round("avgdl", 6).alias("avgdl"))


def _scored(spark, d, kinds):
    out = P.bm25(P.unit_frequencies(P.with_stats(P.index(S.segments(spark, d))), PARSED, kinds))
    return out.select("query_id", "video_id", "idx", F.round("score", 6).alias("score"))


def _bm25(kind):
    return f"WITH {FREQ}, {bm25_sql(f'''f.kind = '{kind}' ''')} SELECT query_id, video_id, idx, round(score, 6) AS score FROM scored"


@query(_bm25("term"))
def bm25_term(spark, d):
    """M7, J1, J12."""
    return _scored(spark, d, ("term",))


@query(_bm25("prefix"))
def bm25_prefix(spark, d):
    return _scored(spark, d, ("prefix",))


@query(_bm25("phrase"))
def bm25_phrase(spark, d):
    return _scored(spark, d, ("phrase",))


@query(f"WITH {FREQ}, {bm25_sql()} SELECT query_id, video_id, idx, round(score, 6) AS score FROM scored")
def bm25_joined(spark, d):
    """M7, J1, J12 by the plan for many queries."""
    found = P._joined_frequencies(P.with_stats(P.index(S.segments(spark, d))), P.query_units(spark, PARSED), ("term", "prefix", "phrase"))
    return P.bm25(found).select("query_id", "video_id", "idx", F.round("score", 6).alias("score"))


#: Hits with their segments, best first, at most 80 a query and timeline, whatever the number of results.
CANDIDATES = 80
HITS = FREQ + ", " + bm25_sql() + """,
hits AS (SELECT s.query_id, s.video_id, s.idx, s.score, t.start_s, t.end_s, t.text, t.tokens,
  row_number() OVER (PARTITION BY s.query_id, s.video_id ORDER BY round(s.score, 9) DESC, s.idx) AS hit_rank FROM scored s JOIN tok t USING (video_id, idx) QUALIFY hit_rank <= 80)"""


@query(f"WITH {HITS} SELECT query_id, video_id, idx, round(score, 6) AS score, hit_rank FROM hits")
def bm25_topk(spark, d):
    """L1."""
    return Q.candidates(S.segments(spark, d), PARSED).select("query_id", "video_id", "idx", F.round("score", 6).alias("score"), "hit_rank")
