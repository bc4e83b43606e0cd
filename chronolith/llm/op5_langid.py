"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary; for each language, a probability for each piece.  A word's
likelihood under a language is the sum over all its segmentations, by the forward algorithm;
a text's log likelihood is the sum over its words.

Fit: at most about `sample` labelled documents a language, chosen by a hash of the id, give
word counts by language; expectation steps from the vocabulary's own scores give piece
counts; each language is smoothed with the pool of all.  What leaves the executors, and what is
sent to them, is a matrix of pieces by languages: 32,000 rows, and a column for each value of lang.

The score is the posterior of the predicted language, with log likelihoods divided by
max(1, words / 20), since words of a text are not independent.

Defined cases: null text and text without a letter give `und` with score 0; nothing to learn
from gives `und`, too; a null id counts as the empty text in the split; repeated rows are
judged alike; of languages that are as likely the first by code point is predicted; words and
texts of any length are summed whole; other columns are not read, and may have any name; an empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, payload, slices
from .lattice import VOCABULARY, Lattice, vocabulary

SAMPLE = 2000
ITERATIONS = 2
CACHE_WORDS = 250_000
POOL_WEIGHT = 2000.0
#: Log likelihoods of words already met, for each model, kept while a task lasts.
_MET: dict[str, tuple[dict[bytes, int], np.ndarray]] = {}


def fit(docs: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE, iterations: int = ITERATIONS) -> tuple[list[str], list[bytes], np.ndarray, np.ndarray]:
    """languages, pieces, log probabilities (pieces, languages), log priors."""
    spark = docs.sparkSession
    own = docs.filter((id_crc("doc_id") % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    pieces, start = vocabulary(path)
    if not langs:
        return [], pieces, np.zeros((len(pieces), 0)), np.zeros(0)
    share = F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))))
    chosen = own.filter(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[bytes]] = {}
        for b in slices(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, seen.values())) > 300_000:
                for lang, c in seen.items():
                    yield rows(lang, c)
                seen = {}
        for lang, c in seen.items():
            yield rows(lang, c)

    def rows(lang: str, c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    words = payload(chosen, "lang").mapInArrow(count, "lang string, word binary, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")).persist()
    index = {k: i for i, k in enumerate(langs)}
    logp = start
    for _ in range(iterations):
        sent = spark.sparkContext.broadcast((pieces, logp))

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            vocab, weights = sent.value
            lattice, total = Lattice(vocab), np.zeros((len(vocab), len(langs)))
            for b in batches:
                own = b.column("word").to_pylist()
                w = np.zeros((len(own), len(langs)))
                w[np.arange(len(own)), [index[x] for x in b.column("lang").to_pylist()]] = b.column("n").to_numpy(zero_copy_only=False)
                total += lattice.expected(own, w, weights[:, None])
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], names=["piece", "lang", "uses"])

        got = words.mapInArrow(step, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        sent.unpersist()
        uses = np.zeros((len(pieces), len(langs)))
        uses[got["piece"], got["lang"]] = got["uses"]
        pool = (uses / np.maximum(uses.sum(0), 1e-9)).sum(1) + np.exp(start) * 1e-2
        pool /= pool.sum()
        logp = np.log(pool)
    words.unpersist()
    by_lang = (uses + POOL_WEIGHT * pool[:, None]) / (uses.sum(0) + POOL_WEIGHT)
    n = np.array([sizes[k] for k in langs], float)
    return langs, pieces, np.log(by_lang), np.log((n + 1) / (n + 1).sum())


def identify(docs: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    langs, pieces, logp, prior = fit(docs, path, sample)
    sent = docs.sparkSession.sparkContext.broadcast((pieces, logp))
    model = str(sent.id if hasattr(sent, "id") else id(sent)) + docs.sparkSession.sparkContext.applicationId

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, weights = sent.value
        lattice, g = Lattice(vocab), max(1, len(langs))
        for key in [k for k in _MET if k != model]:
            del _MET[key]
        place, known = _MET.get(model, ({}, np.zeros((1024, g))))
        for b in slices(batches):
            texts = [t.lower().split() for t in b.column("text").to_pylist()]
            if len(place) > CACHE_WORDS:
                place = {}
            if langs:
                new = list({w for t in texts for w in t if w not in place})
                if new:
                    first, last = len(place), len(place) + len(new)
                    if last > len(known):
                        known = np.concatenate([known, np.zeros((max(last, 2 * len(known)) - len(known), g))])
                    known[first:last] = lattice.forward(new, weights)
                    place.update(zip(new, range(first, last)))
                _MET[model] = place, known
            names, scores = [], []
            for raw, t in zip(b.column("text").to_pylist(), texts):
                if not langs or not any(ch.isalpha() for ch in raw.decode("utf-8", "replace")):
                    names.append("und")
                    scores.append(0.0)
                    continue
                total = known[np.fromiter((place[w] for w in t), np.int64, len(t))].sum(0)
                z = (total - total.max()) / max(1.0, len(t) / 20) + prior
                p = np.exp(z - z.max())
                p /= p.sum()
                k = int(p.argmax())
                names.append(langs[k])
                scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return payload(docs.withColumn("held_out", id_crc("doc_id") % 4 == 2), "doc_id", "held_out").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
