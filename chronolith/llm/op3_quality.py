"""Quality rules, line first.

Every line with a word is judged by three rules; lines that fail are removed, and a document
is rejected when the lines it lost hold more than `max_loss` of its words.

punctuation  more than `max_punct` ASCII punctuation marks a word in a line of four words or
             more, or no sentence mark at all in a line of `long_line` words or more
navigation   three separators (| > bullet, guillemet) or more, one for every three words at
             least; or a short line made of menu words only
boilerplate  a fixed pattern of notices in a line of fewer than `long_line` words, or in a longer
             one if what matches is a quarter of its words at least

The base rules (word count, repeated five-word windows) come on top: a document that fails
them is rejected whatever its lines say.

Defined cases: a null text counts as empty, has no words and fails the base rules; a text of
any length is judged whole; repeated rows are judged alike; a share of words lost that equals
`max_loss` is not too much; other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, payload, slices

SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Over UTF-8 bytes, so a character beyond ASCII is a sequence, not members of a class.
SENTENCE_MARK = re.compile("[.!?:;]|…|。|！|？|؟|।".encode())
SEPARATOR = re.compile("[|>]|•|·|»|›".encode())
#: Words of which a menu line consists.
MENU = frozenset(b"home menu login logout register search contact about next previous back top help faq share print sitemap archive categories tags comments".split())
BOILERPLATE = re.compile(rb"(?i)all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|enable javascript|accept (?:all )?cookies|subscribe to our newsletter|click here to|powered by [a-z]+$")


@dataclass(frozen=True)
class Rules:
    max_punct: float = 1.5
    long_line: int = 20
    max_loss: float = 0.5
    min_words: int = 10
    repeat_percent: int = 20


def line_fails(line: bytes, words: list[bytes], rules: Rules) -> bool:
    n = len(words)
    if n >= 4 and len(line) - len(line.translate(None, PUNCTUATION)) > rules.max_punct * n:
        return True
    if n >= rules.long_line and not SENTENCE_MARK.search(line):
        return True
    seps = len(SEPARATOR.findall(line))
    if seps >= 3 and 3 * seps >= n:
        return True
    if n <= 6 and all(w.lower() in MENU for w in words):
        return True
    notice = sum(len(m.split()) for m in BOILERPLATE.findall(line))
    return notice > 0 and (n < rules.long_line or 4 * notice >= n)


def repeated(words: list[bytes]) -> int:
    """Words that lie in a five-word window found twice or more."""
    n = len(words) - 4
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == n:
        return 0
    count, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + 5 - max(end, i)
            end = i + 5
    return total


def judge(text: bytes, rules: Rules) -> tuple[int, int, int, int, int, bool, bool, bytes]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, the text without its failed lines."""
    words = text.split()
    n = len(words)
    chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, BLANKS)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = lost = 0
    left = []
    lines = text.split(b"\n")
    for line in lines:
        own = line.split()
        if own:
            if line in seen:
                dup += 1
            else:
                seen.add(line)
            if line_fails(line, own, rules):
                lost += len(own)
                continue
        left.append(line)
    rep = repeated(words)
    failed = n < rules.min_words or 100 * rep > rules.repeat_percent * n
    return n, chars, symbols, dup, rep, failed, not failed and lost <= rules.max_loss * n, b"\n".join(left) if lost else text


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, cleaned string"


def assess(docs: DataFrame, rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """The measures and the verdict of every document; `cleaned` is its text without failed lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [judge(t, rules) for t in b.column("text").to_pylist()]
            cols = list(zip(*got)) or [[]] * 8
            arrays = [b.column("doc_id")] + [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.bool_()) for c in cols[5:7]]
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
            if with_text:
                arrays.append(pa.array([c.decode("utf-8", "replace") for c in cols[7]], pa.string()))
                names.append("cleaned")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = SCHEMA if with_text else SCHEMA.replace(", cleaned string", "")
    return payload(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, schema)


def clean_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept rows of docs, with its columns; text loses its failed lines, and n_chars follows it where the text changed."""
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(at).cast(pa.binary()).to_pylist()
            got = [judge(t or b"", rules) for t in texts]
            cleaned = [None if t is None else g[7] for t, g in zip(texts, got)]
            columns = list(b.columns)
            columns[at] = pa.array(cleaned, pa.binary()).cast(b.column(at).type)
            if counted is not None:
                old = b.column(counted)
                columns[counted] = pa.array([o if c is None or c is t or c == t else len(c.decode("utf-8", "replace")) for o, c, t in zip(old.to_pylist(), cleaned, texts)], old.type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array([g[6] for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


_LINE = r"""line AS (SELECT rid, n, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS list
  FROM (SELECT rid, n, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d))"""
_NOTICE = "(?i)all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|enable javascript|accept (?:all )?cookies|subscribe to our newsletter|click here to|powered by [a-z]+$"
SQL = (
    r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS list, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM t),
g AS (SELECT rid, i, list[i:i + 4] AS w FROM (SELECT rid, list, unnest(range(1, n - 3)) AS i FROM d)),
twice AS (SELECT rid, unnest(list(i)) AS i FROM g GROUP BY rid, w HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS r FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
"""
    + _LINE
    + r""",
judged AS (SELECT rid, n, pos, line, words, row_number() OVER (PARTITION BY rid, line ORDER BY pos) > 1 AS dup,
  words >= 4 AND length(regexp_replace(line, '[^!-/:-@\[-`{-~]', '', 'g')) > 1.5 * words
  OR words >= 20 AND NOT regexp_matches(line, '[.!?:;…。！？؟।]')
  OR len(regexp_extract_all(line, '[|>•·»›]')) >= 3 AND 3 * len(regexp_extract_all(line, '[|>•·»›]')) >= words
  OR words <= 6 AND len(list_filter(list, lambda x: NOT regexp_full_match(x, '(?i)home|menu|login|logout|register|search|contact|about|next|previous|back|top|help|faq|share|print|sitemap|archive|categories|tags|comments'))) = 0
  OR regexp_matches(line, '"""
    + _NOTICE
    + r"""') AND (words < 20 OR 4 * list_sum(list_transform(regexp_extract_all(line, '"""
    + _NOTICE
    + r"""'), lambda x: len(string_split(x, ' ')))) >= words) AS fails
  FROM line WHERE words > 0),
lost AS (SELECT rid, count(*) FILTER (dup) AS dups, coalesce(sum(words) FILTER (fails), 0) AS lost FROM judged GROUP BY rid),
m AS (SELECT doc_id, n::BIGINT AS n_words, (length(text) - length(regexp_replace(text, '[^ 	-
]', '', 'g')))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= 0.5 * n_words AS kept
FROM m
"""
)
