"""Toxicity of texts restored by a noisy-channel decoder.

Channel: a written token is a lattice.  A letter stands for itself; a letter equal to the one
before may be a repetition and stand for nothing; digits and symbols may stand for letters, be
separators inside a word and stand for nothing, or end a word.  Symbols at a token's edges are
read twice, as punctuation and as letters, and so are tokens without letters, as they stand and
as letters; both readings count.  Runs of three or more single characters, spaced out by blanks
of any number and kind, form one lattice, the blanks being separators.  Viterbi search over
states of the last three letters finds the restoration that is likeliest under the channel and
a character 4-gram model counted over all documents.

Score: restored words and their beginnings of four to seven bytes carry shrunken log odds of
toxic documents; a logistic regression over a document's largest odds gives the score.

Fit: at most about `sample` labelled rows of each class, chosen by a hash of the id (labels of
ids whose crc32 is 0 mod 5 are never used).  Rows of the class that is sampled at the higher
rate weigh less in odds and regression, so that both keep the shares they have among all labels
and scores do not drift with the size of the input.  In fitting, a row's own label is taken out
of the odds it is described by.  The classifier keeps the `n_features` largest odds, and no more
than the words of its sample have.  The character model has a class for each letter of ASCII and
one for all bytes beyond it, so words of other scripts are neither helped nor hindered by it.

Defined cases: null and empty texts get the score of a text without words; an id labelled
twice is toxic if any label says so; a null label does not count; a null id counts as the
empty text in the split; repeated rows are scored alike; of restorations that are as likely the
search, whose order is fixed, takes the same one each time; texts and tokens of any length are decoded whole; without labels
of both classes every score is the share of toxic labels (0 without any); other columns are not
read, and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, payload, slices

SAMPLE = 20_000
FEATURES = 100_000
CACHE_WORDS = 500_000
#: Letters for which a character is written.
LEET = {b"0": b"o", b"1": b"il", b"2": b"z", b"3": b"e", b"4": b"a", b"5": b"s", b"6": b"gb", b"7": b"t", b"8": b"b", b"9": b"g", b"@": b"a", b"$": b"s", b"!": b"i", b"|": b"il", b"+": b"t", b"(": b"c", b"<": b"c", b"&": b"e", b"%": b"x"}
LEET_COST, DROP_COST, BREAK_COST, DOUBLE_COST, RUN_COST = -1.0, -1.5, -8.0, -3.0, -0.5
#: Bytes of a token after which the part that all paths share is set aside.
SETTLE = 64
SEPARATORS = frozenset(b" .-_*~'`^,:;/\\=#\"")
LEADING, TRAILING = b".,;:?\"'()[]{}*%&#<>-_~`", b".,;:?!\"')]}*%&#|$-_~`<>+="
#: What LEET does not map: a symbol that may be a letter is stripped in one reading only.
NO_LETTER = bytes(c for c in {*LEADING, *TRAILING} if bytes([c]) not in LEET)
#: A letter of ASCII, a character of LEET, or a letter beyond ASCII (without the blocks of Latin-1, general and CJK punctuation and of symbols).
SINGLE = rb"(?:[A-Za-z0-9@$!|+(<&%]|[\xc3-\xdf][\x80-\xbf]|(?:[\xe0\xe1\xe4-\xef][\x80-\xbf]|\xe2[\xb0-\xbf]|\xe3[\x81-\xbf])[\x80-\xbf]|[\xf0-\xf4][\x80-\xbf]{3})"
SPACED = re.compile(rb"(?<!\S)" + SINGLE + rb"(?:\s+" + SINGLE + rb"){2,}(?!\S)")
TABLE = np.zeros(256, np.int64)
TABLE[97:123] = np.arange(1, 27)
TABLE[65:91] = np.arange(1, 27)
TABLE[128:] = 27
SYMBOLS = 28
#: For each model, tokens known to carry no odds, and the restored words and odds of the others; kept while a task lasts.
_CACHE: dict[str, tuple[set[bytes], dict[bytes, tuple[tuple[bytes, float], ...]]]] = {}


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(d | a, b, c) over 28 classes (break, a to z, any byte beyond ASCII), from all documents; 28 ** 4 floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**4, np.int64)
        for b in slices(batches):
            joined = b"  ".join(b.column("text").to_pylist())
            for at in range(0, len(joined), 4 << 20):
                x = TABLE[np.frombuffer(joined[at : at + (4 << 20) + 3], np.uint8)]
                x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])] if len(x) else x
                if len(x) > 3:
                    total += np.bincount(((x[:-3] * SYMBOLS + x[1:-2]) * SYMBOLS + x[2:-1]) * SYMBOLS + x[3:], minlength=SYMBOLS**4)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["gram", "n"])

    got = payload(docs).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    four = np.zeros(SYMBOLS**4)
    four[got["gram"].to_numpy()] = got["n"].to_numpy()
    four = four.reshape((SYMBOLS,) * 4)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        c = four.sum(axis=axes) if axes else four
        kinds = (c > 0).sum(-1, keepdims=True)  # Witten-Bell
        p = (c + kinds * p) / np.maximum(c.sum(-1, keepdims=True) + kinds, 1e-9) + np.where(kinds == 0, p, 0)
    return np.log(p).astype(np.float32)


#: Tokens whose lattice has one path: ASCII letters and bytes beyond ASCII, none twice running.
PLAIN = re.compile(rb"(?:([a-z\x80-\xff])(?!\1))+")


def decode(token: bytes, lm: list, edges: bool = False) -> bytes:
    """The likeliest restoration of a lower-case token: words between single blanks.  lm: nested lists of the character model.

    edges: symbols at the edges, or without any letter, are read like symbols between letters.
    """
    n = len(token)
    has = [97 <= c <= 122 or c > 127 for c in token]
    if not edges and not any(has):
        return token
    first, last = (-1, n) if edges else (has.index(True), n - 1 - has[::-1].index(True))
    states: dict[tuple[int, int, int], tuple[float, bytes]] = {(0, 0, 0): (0.0, b"")}
    settled: list[bytes] = []
    for i, c in enumerate(token):
        options: list[tuple[int, bytes, float]] = []
        if has[i]:
            k = 27 if c > 127 else c - 96
            options.append((k, token[i : i + 1], 0.0))
            if c < 128 and i and token[i - 1] == c:
                run = (i > 1 and token[i - 2] == c) or (i + 1 < n and token[i + 1] == c)
                options.append((-1, b"", RUN_COST if run else DOUBLE_COST))
        else:
            # In front of letters and between them a symbol is rarely the end of a word.
            inside = i < last and (i > first or i == first - 1)
            separator = c in SEPARATORS
            options.append((0, b" ", BREAK_COST if inside and not separator else 0.0))
            options += [(x - 96, bytes([x]), LEET_COST if inside else 2 * LEET_COST) for x in LEET.get(token[i : i + 1], b"")]
            if inside and (separator or i and token[i - 1] == c):
                options.append((-1, b"", DROP_COST))
        new: dict[tuple[int, int, int], tuple[float, bytes]] = {}
        for (a, b, d), (score, text) in states.items():
            row = lm[a][b][d]
            for k, out, cost in options:
                if k < 0 or k == 0 and d == 0:
                    key, s, t = (a, b, d), score + cost, text
                else:
                    key, s, t = (b, d, k), score + cost + row[k], text + out
                old = new.get(key)
                if old is None or s > old[0]:
                    new[key] = s, t
        states = new
        if i % SETTLE == SETTLE - 1:  # what all paths share is settled, so tokens of any length take linear time
            cut = len(commonprefix([t for _, t in states.values()]))
            settled.append(next(iter(states.values()))[1][:cut])
            states = {key: (s, t[cut:]) for key, (s, t) in states.items()}
    best = max((s + (lm[a][b][d][0] if d else 0.0), t) for (a, b, d), (s, t) in states.items())
    return (b"".join(settled) + best[1]).strip()


def restore(token: bytes, lm: list) -> list[bytes]:
    """The words for which a written token (lower case) stands."""
    token = token.rstrip(TRAILING).lstrip(LEADING)
    if not token or PLAIN.fullmatch(token):
        return [token] if token else []
    return decode(token, lm).split()


def readings(token: bytes, lm: list) -> list[bytes]:
    """The words of restore(), where symbols at the edges are punctuation, and those with such symbols, or a token without letters, read as letters."""
    words = restore(token, lm)
    token = token.strip(NO_LETTER)
    if token and (token[:1] in LEET or token[-1:] in LEET):
        words += [w for w in decode(token, lm, True).split() if w not in words]
    return words


def features(word: bytes) -> list[bytes]:
    return [b"=" + word] + [word[:k] for k in range(4, 8) if len(word) >= k]


def words_of(text: bytes, lm: list) -> set[bytes]:
    """Lower-case tokens, and each spaced-out run as one token."""
    low = text.lower()
    out = set(low.split())
    out.update(m.group() for m in SPACED.finditer(low))
    return out


def odds(pos: float, neg: float, rate: float) -> float:
    return math.log((pos + 10 * rate) * (1 - rate) / ((neg + 10 * (1 - rate)) * rate))


def _describe(found: dict[bytes, float], n_tokens: int) -> list[float]:
    top = heapq.nlargest(3, found.values()) + [0.0] * 3
    return [1.0, top[0], top[1], top[2], float(min(8, sum(v > 1.0 for v in found.values()))), math.log1p(n_tokens)]


def _logistic(x: np.ndarray, y: np.ndarray, v: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.r_[0.0, np.ones(len(w) - 1)]
        step = np.linalg.solve((x * (v * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (v * (y - p)) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES) -> tuple[np.ndarray, dict[bytes, tuple[float, float]], float, np.ndarray | None]:
    """The character model, weighted counts of the features kept, the share of toxic rows, and the regression."""
    spark = docs.sparkSession
    model = character_model(docs)
    judged = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null").filter(id_crc("doc_id") % 5 != 0)
    judged = judged.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in judged.groupBy("toxic").count().collect()}
    every = sum(sizes.values())
    if not sizes.get(0) or not sizes.get(1):
        return model, {}, sizes.get(1, 0) / max(1, every), None
    rates = [min(1.0, sample / sizes[y]) for y in (0, 1)]
    v0, v1 = (min(rates) / r for r in rates)
    share = F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0])
    chosen = judged.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    # At most about 2 * sample ids.
    rows = payload(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), "toxic")
    sent = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, met = sent.value.tolist(), {}
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for b in slices(batches):
            for y, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist()):
                words: set[bytes] = set()
                for t in words_of(text, lm):
                    if t not in met:
                        met[t] = readings(t, lm)
                    words.update(met[t])
                seen[y > 0].update({f for w in words for f in features(w)})
            if len(met) > CACHE_WORDS:
                met = {}
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield emit(seen)
                seen = Counter(), Counter()
        yield emit(seen)

    def emit(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["feature", "pos", "neg"])

    counts = rows.mapInArrow(count, "feature binary, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = rows.groupBy("toxic").count().collect()
    n = {r["toxic"] > 0: r["count"] * (v1 if r["toxic"] > 0 else v0) for r in n}
    rate = n.get(True, 0) / max(1, sum(n.values()))
    if not 0 < rate < 1:
        return model, {}, rate, None
    weight = F.log((F.col("pos") * v1 + 10 * rate) * (1 - rate) / ((F.col("neg") * v0 + 10 * (1 - rate)) * rate))
    best = counts.filter("pos >= 2").withColumn("w", weight).filter("w > 0.3").orderBy(F.desc("w"), "feature").limit(n_features).toPandas()
    table = dict(zip(best["feature"].map(bytes), zip(best["pos"] * v1, best["neg"] * v0)))
    told = spark.sparkContext.broadcast((model, table, rate))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, table, rate = told.value
        lm, met = grams.tolist(), {}
        for b in slices(batches):
            out = []
            for y, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist()):
                found: dict[bytes, float] = {}
                for t in words_of(text, lm):
                    if t not in met:
                        met[t] = readings(t, lm)
                    for w in met[t]:
                        own = [table[f] for f in features(w) if f in table]
                        if own and (v := max(odds(p - v1 * (y > 0), q - v0 * (y <= 0), rate) for p, q in own)) > 0:
                            found[w] = v
                if len(met) > CACHE_WORDS:
                    met = {}
                out.append([float(y > 0), *_describe(found, text.count(b" ") + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], names=["x"])

    x = np.array(rows.mapInArrow(describe, "x array<double>").toPandas()["x"].tolist())
    return model, table, rate, _logistic(x[:, 1:], x[:, 0], np.where(x[:, 0] > 0, v1, v0))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, worst (the restored word with the largest odds) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, table, rate, w = fit(docs, labels, sample)
    weights = {f: v for f, (p, q) in table.items() if (v := odds(p, q, rate)) > 0}
    sent = docs.sparkSession.sparkContext.broadcast((model, weights))
    name = docs.sparkSession.sparkContext.applicationId + str(id(sent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, table = sent.value
        lm: list = grams.tolist() if w is not None else []
        for key in [k for k in _CACHE if k != name]:
            del _CACHE[key]
        clean, known = _CACHE.setdefault(name, (set(), {}))
        for b in slices(batches):
            scores, worst = [], []
            for text in b.column("text").to_pylist():
                found: dict[bytes, float] = {}
                if w is not None:
                    for t in words_of(text, lm) - clean:
                        got = known.get(t)
                        if got is None:
                            got = tuple((x, v) for x in readings(t, lm) if (v := max((table.get(f, 0.0) for f in features(x)), default=0.0)) > 0)
                            if not got:
                                clean.add(t)
                                continue
                            known[t] = got
                        found.update(got)
                    if len(clean) + len(known) > CACHE_WORDS:
                        clean.clear()
                        known.clear()
                    z = float(np.dot(_describe(found, text.count(b" ") + 1), w))
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                else:
                    scores.append(rate)
                worst.append(max(found, key=lambda k: (found[k], k)).decode("utf-8", "replace") if found else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(worst, pa.string())], names=["doc_id", "held_out", "score", "predicted", "worst"])

    return payload(docs.withColumn("held_out", id_crc("doc_id") % 5 == 0), "doc_id", "held_out").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, worst string")
