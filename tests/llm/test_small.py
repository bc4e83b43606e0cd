"""The operators on small fixtures against plain versions; odd rows in each."""

import gzip
import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolith.llm import op1_toxicity, op2_lm, op3_quality, op4_ngram_join, op5_langid, op6_exact, op7_shards, op8_warc, op9_packing, op10_mix
from chronolith.llm.common import BATCH_BYTES, materialise, small_batches
from chronolith.llm.components import components
from chronolith.llm.lattice import Lattice, vocabulary

#: Columns whose names operators use themselves, inside or in what they return.
CLASHES = "kept score shard size group_size keep_id keep_uid keep_key weight component_id row node task_uid key n id bytes src cut target taken held_out nth alone salt token part label rank before bucket batch_id slot word uid cleaned __len __sha __key __n __r __alone __hit __spread __slice __g __bytes __epoch".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
rng = random.Random(4)
SYL = "tan mer lo vi sto ren ka du pel ish".split()


def prose(n, r=rng):
    return " ".join("".join(r.choices(SYL, k=r.randint(1, 4))) + (". " if r.random() < 0.15 else "") for _ in range(n)) + "."


def table(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), *CLASHES) for i, t, g, s in rows], DOCS)


ODD = [(None, None, None, None), (None, "No id here at all.", None, "s1"), (7, "", "en", "s1"), (8, "   \n\t ", "en", None), (9, None, "fr", "s2"), (10, "Twice the same row.", "en", "s2"), (10, "Twice the same row.", "en", "s2"), (11, "a" * 5000, None, "s3")]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(9)
    base = [prose(r.randint(3, 120), r) for _ in range(60)]
    rows = [(100 + i, t, "en", f"s{i % 4}") for i, t in enumerate(base)]
    for i, t in enumerate(base[:20]):
        rows.append((200 + i, t + " ", "en", "s0"))
        w = t.split()
        for k in range(3):
            x = list(w)
            x[r.randrange(len(x))] = f"edit{k}"
            rows.append((300 + 10 * i + k, " ".join(x), "en", "s1"))
    return ODD + rows


def words(t):
    return (t or "").encode().lower().split()


# 3 ---------------------------------------------------------------------------------------------


def test_quality_measures(spark, corpus):
    got = sorted((tuple(-1 if v is None else v for v in r[:6]) for r in op3_quality.assess(table(spark, corpus)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()))
    want = []
    for i, t, *_ in corpus:
        w = (t or "").encode().split()
        g = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {j for k in range(len(w) - 4) if g[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        want.append((-1 if i is None else i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep)))
    assert got == sorted(want)


def test_lines_fail_by_rule():
    r = op3_quality.Rules()
    bad = ["| home | about | news | contact |", "WHAT!! IS!! THIS!! NOW!!", "word$$$ word### word%%% word***", "All rights reserved.", "home about contact", "go " * 30]
    good = ["A plain sentence, with a comma.", "Short one", "He paid 5% (or more) for it.", "über die Straße ging er."]
    assert all(op3_quality.line_fails(x.encode(), x.encode().split(), r) for x in bad)
    assert not any(op3_quality.line_fails(x.encode(), x.encode().split(), r) for x in good)


def test_document_goes_when_it_loses_too_much():
    text = "\n".join(["This sentence is a good one and it stays here."] + ["| a | b | c | d |"] * 4)
    assert op3_quality.judge(text.encode(), op3_quality.Rules())[6] is False
    text = "\n".join(["This sentence is a good one and it stays here, as do its many words.", "All rights reserved."])
    kept, cleaned = op3_quality.judge(text.encode(), op3_quality.Rules())[6:]
    assert kept and b"rights" not in cleaned


def test_a_notice_in_a_long_line_fails_no_more_than_itself():
    r = op3_quality.Rules()
    line = " ".join(f"word{i}" for i in range(250)) + " and our privacy policy, of which " + " ".join(f"more{i}" for i in range(244)) + "."
    kept, cleaned = op3_quality.judge(line.encode(), r)[6:]
    assert len(line.split()) == 500 and kept and cleaned == line.encode()
    for notice in ("Copyright 2024 by us. All rights reserved.", "Privacy policy. Terms of use. Cookie policy. " * 10):
        assert op3_quality.line_fails(notice.encode(), notice.encode().split(), r)


def test_clean_documents_keep_columns(spark, corpus):
    docs = table(spark, corpus)
    out = op3_quality.clean_documents(docs)
    assert out.schema == docs.schema
    kept = {r["doc_id"] for r in op3_quality.assess(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in out.collect()} == kept
    assert op3_quality.clean_documents(docs.limit(0)).count() == 0


# 6 ---------------------------------------------------------------------------------------------


def test_trie_holds_what_a_dict_holds():
    r, trie, plain, nodes = random.Random(2), op6_exact.Patricia(), {}, {}
    for i in range(3000):
        k = bytes(r.choices(b"ab", k=r.randint(0, 12)))
        points, doc_id = r.randint(1, 3), i % 7
        nodes[k] = trie.insert(k, (points, doc_id, i, 1, [i]))
        plain.setdefault(k, []).append((-points, doc_id, i))
    for k, own in plain.items():
        points, doc_id, uid, n, members = nodes[k][2]
        assert (-points, doc_id, uid) == min(own) and n == len(own) and sorted(members) == sorted(x[2] for x in own)
    assert {k for k, _ in trie.terminals(trie.root)} == set(plain)


def test_trie_cuts_off_subtrees():
    r, trie = random.Random(3), op6_exact.Patricia()
    keys = sorted({bytes(r.choices(b"abc", k=8)) for _ in range(200)})
    for i, k in enumerate(keys):
        assert trie.insert(k, (1, i, i, 1, [i]))
    whole, gone = trie.bytes, trie.cut()
    assert gone and trie.bytes < whole
    left = [k for k, _ in trie.terminals(trie.root)]
    assert sorted(left + [k for k, _ in gone]) == keys
    assert all(trie.insert(k, (1, 0, 0, 1, [0])) is None for k, _ in gone) and all(trie.insert(k, (1, 0, 0, 1, [0])) for k in left)
    while more := trie.cut():
        gone += more
    assert trie.bytes <= whole // 4 and len({k for k, _ in gone}) == len(gone)


def norm(t):
    return "".join(c for c in t or "" if c not in " \t\n\r\x0b\x0c")


@pytest.mark.parametrize("budget,rounds", [(1, (0, 2, 64)), (3000, (0, 64)), (32 << 20, (16, 32, 64))])
def test_exact_dedup(spark, corpus, budget, rounds):
    """Short hashes that all collide, and budgets that no trie keeps to."""
    corpus = corpus + [(20, "Ties in  id.", "en", "s"), (20, "Ties in id.", "en", "s"), (21, "Ties in id. ", "en", "s")]
    groups = defaultdict(list)
    for i, t, *_ in corpus:
        groups[norm(t)].append((-len(t or ""), math.inf if i is None else i))
    want, seen = [], set()
    for i, t, *_ in sorted(corpus, key=lambda x: -len(x[1] or "")):
        g = groups[norm(t)]
        least = min(g)
        keep = None if least[1] == math.inf else least[1]
        kept = least == (-len(t or ""), math.inf if i is None else i) and norm(t) not in seen  # one row of equal ones
        seen |= {norm(t)} if kept else set()
        want.append((i, keep, len(g), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = [tuple(r) for r in op6_exact.dedup(table(spark, corpus).repartition(3), budget, rounds).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_exact_dedup_keeps_one_row_each(spark, corpus):
    docs = table(spark, corpus)
    out = op6_exact.dedup_documents(docs)
    assert out.schema.names == docs.schema.names
    texts = [norm(r["text"]) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({norm(t) for _, t, *_ in corpus})
    assert op6_exact.dedup(docs.limit(0)).count() == 0


# 4 ---------------------------------------------------------------------------------------------


def plain_components(rows, width, percent):
    sets, parent = [], list(range(len(rows)))
    for _, t, *_ in rows:
        w = words(t)
        sets.append(set(zip(*(w[k:] for k in range(width)))) if len(w) >= width else ({tuple(w)} if w else set()))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        ids[find(k)].append(i)
    out = []
    for k, (i, *_) in enumerate(rows):
        known = [x for x in ids[find(k)] if x is not None]
        out.append((i, len(sets[k]), (i if not sets[k] else min(known) if known else None)))
    return out


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (2, 60)])
def test_ngram_join(spark, corpus, width, percent):
    got = [tuple(r) for r in op4_ngram_join.join_classes(table(spark, corpus), width, percent).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_components(corpus, width, percent)))


def test_ngram_join_of_many_edits_of_one_text(spark):
    r = random.Random(1)
    base = prose(150, r).split()
    rows = []
    for i in range(150):
        x = list(base)
        for _ in range(r.randint(0, 9)):
            x[r.randrange(len(x))] = f"w{r.randrange(40)}"
        rows.append((i, " ".join(x), "en", "s"))
    got = [tuple(x) for x in op4_ngram_join.join_classes(table(spark, rows)).collect()]
    assert sorted(got) == sorted(plain_components(rows, 3, 90))


def test_prefix_asks_for_no_more_than_it_can_share():
    sketch = np.full(1 << op4_ngram_join.SKETCH_BITS, 80, np.uint8)
    for n in (1, 2, 5, 40):
        s = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        m, _, p = op4_ngram_join.prefix(s, sketch, 90)
        assert 1 <= m <= n and len(p) == n - -(-90 * n // 100) + m


def test_near_dedup_keeps_one_of_each(spark, corpus):
    docs = table(spark, corpus)
    out = op4_ngram_join.dedup_documents(docs)
    assert out.schema.names == docs.schema.names
    want = Counter(c if n else "empty" for _, n, c in set(plain_components(corpus, 5, 80)) if n)
    with_words = [r for r in out.collect() if words(r["text"])]
    assert len(with_words) == len(want)
    assert op4_ngram_join.join_classes(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(b"b", b"a"), (b"c", b"b"), (b"d", b"c"), (b"z", b"y"), (b"d", b"a")]
    got = dict(components(spark.createDataFrame(links, "a binary, b binary")).collect())
    assert {bytes(k): bytes(v) for k, v in got.items()} == {b"a": b"a", b"b": b"a", b"c": b"a", b"d": b"a", b"y": b"y", b"z": b"y"}


# 10, 9 -----------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    w = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, capped = {}, set()
    total = sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: 3.0 * sizes[s] for s in capped} | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(spark, corpus):
    rows = corpus + [(900 + i, prose(3), "en", "tiny") for i in range(2)] + [(950, prose(4000), "en", "huge")]
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    got = op10_mix.mix(table(spark, rows), rows_a_slice=7).collect()
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows) and all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes)
    again = op10_mix.mix(table(spark, rows).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_cuts_among_equal_rows(spark):
    """The cut of a source falls into rows of one id and size; a null id has the key of its text."""
    rows = [(1, "a b c", "en", "s")] * 7 + [(None, f"t{k} u", "en", "s") for k in range(40)] + [(2, prose(200), "en", "t")]
    got = op10_mix.mix(table(spark, rows), rows_a_slice=5).collect()
    want = plain_targets({"s": 101, "t": 200})
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert {s: taken[s] for s in want} == {s: math.floor(v + 1e-9) for s, v in want.items()}
    assert len({r["taken"] for r in got if r["doc_id"] is None}) > 1


def test_mixed_documents_keep_columns(spark, corpus):
    docs = table(spark, corpus)
    out = op10_mix.mixed_documents(docs)
    assert out.schema.names == docs.schema.names
    times = Counter(r["doc_id"] for r in out.collect())
    want = Counter()
    for r in op10_mix.mix(docs).collect():
        if r["taken"]:
            want[r["doc_id"]] += -(-r["taken"] // r["size"])
    assert times == want and op10_mix.mixed_documents(docs.limit(0)).count() == 0


def test_boundaries_are_the_best():
    r = random.Random(6)
    for _ in range(20):
        lens = sorted(r.sample(range(1, 60), 7))
        counts = [r.randint(1, 9) for _ in lens]
        best = math.inf
        for pick in range(1 << 6):
            tops = [x for k, x in enumerate(lens[:-1]) if pick >> k & 1] + [lens[-1]]
            if len(tops) <= 3:
                best = min(best, sum(c * (min(t for t in tops if t >= x) - x) for x, c in zip(lens, counts)))
        tops = op9_packing.boundaries(np.array(lens), np.array(counts), 3)
        assert sum(c * (min(t for t in tops if t >= x) - x) for x, c in zip(lens, counts)) == best


def check_packing(rows, lengths, budget):
    batches = defaultdict(list)
    for r in rows:
        assert r["n_tokens"] <= r["padded_len"]
        batches[r["batch_id"]].append(r)
    for b in batches.values():
        assert len({r["padded_len"] for r in b}) == 1 and sorted(r["slot"] for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0]["padded_len"] <= budget
    assert sorted(r["n_tokens"] for r in rows) == sorted(lengths)
    full = defaultdict(list)
    for k, b in batches.items():
        full[k.split("-")[0]].append(len(b))
    assert all(sum(n < max(v) for n in v) <= 1 for v in full.values())


def test_packing(spark, corpus):
    rows = op9_packing.pack(table(spark, corpus), buckets=5, budget=300).collect()
    check_packing(rows, [len((t or "").split()) for _, t, *_ in corpus], 300)
    assert op9_packing.pack(table(spark, corpus).limit(0)).count() == 0


# 8, 7 ------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, file string"


def test_warc_round_trip(spark, tmp_path):
    big = "<p>ü" + "x" * 1200
    pages = [(1, "http://a", big, ""), (2, "http://b\r\nX: y", big, ""), (3, None, None, ""), (4, "u", "short", ""), (5, "u", "short", ""), (6, "u", big + "y", ""), (None, "u", big, "")]
    df = spark.createDataFrame(pages, PAGES).repartition(3)
    got = {r["page_id"]: tuple(r)[1:] for r in op8_warc.round_trip(df, file_bytes=2000).collect()}
    for i, _, html, _ in pages:
        body = (html or "").encode()
        revisit = i in (1, None)
        assert got[i] == (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None)
    assert op8_warc.round_trip(df.limit(0)).count() == 0


def test_warc_members_can_be_read_by_offset(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://x/{i}", "z" * (i * 50), "") for i in range(40)], PAGES).repartition(2)
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir()
    second.mkdir()
    archives = materialise(op8_warc.write_records(op8_warc.resolve(df), f"file://{first}", 3000), "names")
    index = materialise(op8_warc.normalise(archives, f"file://{first}", str(second)), "index")
    rows = index.collect()
    assert len({r["file"] for r in rows}) == archives.count() > 2 and len(rows) == 40 == archives.agg(F.sum("records")).first()[0]
    for r in rows:
        data = (second / r["file"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        assert zlib.decompress(data, 31).startswith(b"WARC/1.1\r\n")
    for name in {r["file"] for r in rows}:  # an ordinary reader sees the same stream as before
        assert gzip.decompress((second / name).read_bytes()).count(b"WARC-Record-ID") == sum(r["file"] == name for r in rows)
    assert sorted(map(str, op8_warc.read_sidecar(spark, str(second)).collect())) == sorted(map(str, rows))
    # Files of attempts that were lost are in no table.
    (first / "pages-000000-0000-lost.warc.gz").write_bytes(b"half a file")
    assert op8_warc.read_records(index, str(second)).count() == 40


def test_warc_damage_is_an_error(spark, tmp_path):
    whole = gzip.compress(b"".join(op8_warc.record("response", i, "u", b"x" * 500, hashlib.sha1(b"x" * 500).hexdigest(), 500, None) for i in range(50)))
    records = lambda data: [r for piece in op8_warc.inflate(iter([data[i : i + 100] for i in range(0, len(data), 100)])) for r in cutter.feed(piece)]
    cutter = op8_warc.RecordCutter()
    assert len(records(whole)) == 50
    with pytest.raises(ValueError, match="inside a member"):
        cutter = op8_warc.RecordCutter()
        records(whole[: len(whole) * 2 // 3])
    cutter = op8_warc.RecordCutter()
    assert len(records(whole + b"\0" * 250)) == 50
    cutter = op8_warc.RecordCutter()
    with pytest.raises(ValueError, match="inside a record"):
        list(cutter.feed(gzip.decompress(whole)[:-300]))
        cutter.close()


def test_warc_of_long_and_repeated_pages(spark):
    big = "w" * 3_000_000
    pages = [(1, "u", big, ""), (2, "u", big, ""), (3, "u", "r" * 1500, ""), (3, "u", "r" * 1500, ""), (4, None, "é" * 700_000, "")]
    got = sorted(op8_warc.round_trip(spark.createDataFrame(pages, PAGES), file_bytes=1000).collect())
    assert [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got] == [(1, 3_000_000, "revisit", 2), (2, 3_000_000, "response", None), (3, 1500, "response", None), (3, 1500, "response", None), (4, 1_400_000, "response", None)]


def test_inflate_takes_many_members_and_any_cut():
    data = b"".join(zlib.compress(x, 1, 31) for x in (b"a" * 1000, b"", b"b" * 10))
    for k in (1, 3, 1000):
        assert b"".join(op8_warc.inflate(iter([data[i : i + k] for i in range(0, len(data), k)]))) == b"a" * 1000 + b"b" * 10


def layout(store):
    return {r["shard"]: (r["bytes"], r["rows"]) for r in store.shards().collect()}


def plain_plan(shards, target, fanin, small):
    """The runs that compact() has to merge, from sizes by name."""
    tiers, runs = defaultdict(list), defaultdict(list)
    for name, (size, _) in shards.items():
        if 2 * size < target:
            tiers[math.floor(math.log(max(size, small) / small, fanin) + 1e-9)].append(name)
    for tier, names in tiers.items():
        at = 0
        for name in sorted(names, key=lambda x: hashlib.md5(x.encode()).hexdigest()):
            runs[tier, at // target].append(name)
            at += shards[name][0]
    return [own for own in runs.values() if len(own) >= fanin or len(own) > 1 and 2 * sum(shards[x][0] for x in own) >= target]


def test_shards(spark, corpus, tmp_path):
    docs = table(spark, corpus).repartition(3)
    store = op7_shards.Store(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.read() is None and store.compact() == 0 and store.vacuum() == 0
    store.append(docs, 400)
    store.append(docs.limit(5), 400)
    store.append(docs.limit(0), 400)
    before = layout(store)
    assert sum(n for _, n in before.values()) == len(corpus) + 5
    expected = plain_plan(before, 4000, 4, 400)
    merges = op7_shards.plan(store.shards(), 4000, 4, 400, "t").collect()
    runs = defaultdict(set)
    for r in merges:
        runs[r["into"]].add(r["shard"])
    assert sorted(map(sorted, runs.values())) == sorted(map(sorted, expected))
    assert store.compact(target=4000, fanin=4, small=400) > 3
    after = layout(store)
    assert not plain_plan(after, 4000, 4, 400)
    assert len(after) < len(before) / 2 and sum(b for b, _ in after.values()) == sum(b for b, _ in before.values())
    assert sorted(map(str, store.read().select(docs.columns).collect())) == sorted(map(str, docs.collect() + docs.limit(5).collect()))
    assert store.read(1).count() == len(corpus)
    assert store.vacuum() > 0 and store.read().count() == len(corpus) + 5 and layout(store) == after
    with pytest.raises(RuntimeError):
        store.commit({}, store.version() - 1)


def test_shards_climb_tiers(spark, tmp_path):
    """Small arrivals: four of a tier make one of the next, and four of these one of the one after."""
    store = op7_shards.Store(spark, str(tmp_path / "store"))
    for k in range(16):
        store.append(spark.createDataFrame([(k, "x" * 100)], "doc_id long, text string").coalesce(1), 100)
        store.compact(target=100_000, fanin=4, small=100)
        assert len(layout(store)) == sum(int(c) for c in np.base_repr(k + 1, 4))
    assert sorted(r["doc_id"] for r in store.read().collect()) == list(range(16))
    assert next(iter(layout(store))).split("-")[1] == "01"


def test_two_writers(spark, tmp_path):
    a, b = (op7_shards.Store(spark, str(tmp_path / "store")) for _ in range(2))
    at = a.version()
    assert a.commit({"folders": {}, "live": [], "retired": []}, at) == 1
    with pytest.raises(RuntimeError):
        b.commit({"folders": {}, "live": [], "retired": []}, at)


def test_shard_documents(spark, corpus):
    docs = table(spark, corpus)
    got = op7_shards.shard_documents(docs, small=500, target=5000).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, *_ in corpus)
    n = Counter(r["shard"] for r in got)
    assert all(n[r["shard"]] == r["shard_rows"] for r in got)
    assert op7_shards.shard_documents(docs.limit(0)).count() == 0


# 2, 5 ------------------------------------------------------------------------------------------


def log_add(terms):
    top = max(terms, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(t - top) for t in terms))


def plain_alpha(w, logs):
    a = [0.0] + [-math.inf] * len(w)
    for i in range(1, len(w) + 1):
        a[i] = log_add([a[j] + logs[w[j:i]] for j in range(max(0, i - 64), i) if w[j:i] in logs])
    return a


def plain_marginal(word, logs):
    return plain_alpha(b" " + word, logs)[-1]


def test_lattice_sums_all_segmentations():
    pieces, logp = vocabulary()
    logs = dict(zip(pieces, logp))
    longest = max(pieces, key=len)
    assert len(longest) > 16
    r = random.Random(5)
    ws = [w.encode() for w in ["the", "größe", "x" * 60, "$$$", "部署", "thation"]] + [longest.strip(), b"in" + longest.strip() * 2]
    # Longer than a block: with places that no piece spans, and without any.
    ws += ["部署失败我们讨论".encode() * 200, b"a" * 3000, "".join(r.choices("abc#é1 部".replace(" ", ""), k=2500)).encode(), b"ing" * 900 + b"\xff" + b"tion" * 800]
    got = Lattice(pieces).forward(ws, logp[:, None])[:, 0]
    assert got == pytest.approx([plain_marginal(w, logs) for w in ws])
    uses = Lattice(pieces).expected([b"the"], np.ones((1, 1)), logp[:, None])[:, 0]
    assert sum(len(p) * u for p, u in zip(pieces, uses)) == pytest.approx(4.0)


@pytest.mark.parametrize("head", [0, 40, 300_000])
def test_lm_scores(spark, corpus, head):
    corpus = corpus + [(5001, "部署失败" * 300 + " x", None, "s"), (5002, prose(9000), "en", "s")]
    docs = table(spark, corpus)
    got = op2_lm.score_documents(docs, head=head).collect()
    train = [t for i, t, *_ in corpus if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c = Counter(w for t in train for w in words(t)) + Counter({b"": len(train)})
    n, v = sum(c.values()), len(c)
    once, twice = (sum(k == x for k in c.values()) for x in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice)))
    logs = dict(zip(*vocabulary()))
    marginal = {w: plain_marginal(w, logs) if w else -math.log(v + 1) for w in {w for _, t, *_ in corpus for w in [*words(t), b""]}}
    want = []
    for i, t, *_ in corpus:
        ts = words(t) + [b""]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)
        score = sum(log_add([math.log(max(c[w] - d, 0) / n) if c[w] > d else -math.inf, math.log(d * v / n) + marginal[w]]) for w in ts) / math.log(10)
        want.append((str(i), zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(ts), sum(c[w] > 0 for w in ts), n, round(base, 5), round(score, 5)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in got) == sorted(want)


def test_lm_score_does_not_depend_on_the_head(spark, corpus):
    docs = table(spark, corpus)
    a, b = (sorted((str(r["doc_id"]), round(r["score"], 6)) for r in op2_lm.score_documents(docs, head=h).collect()) for h in (0, 300_000))
    assert a == b
    assert op2_lm.score_documents(docs.limit(0)).count() == 0


def test_languages(spark):
    r = random.Random(3)
    voc = {"aa": "the and shing tion onder weath".split(), "bb": "der und schaft keit ung zwisch".split()}
    rows = [(i, " ".join("".join(r.choices(voc[g], k=2)) for _ in range(25)), g, g) for i in range(160) for g in [("aa", "bb")[i % 2]]]
    rows += [(1000, None, "aa", "s"), (1001, "123 ...", None, "s"), (None, "the and", None, "s")]
    got = op5_langid.identify(table(spark, rows)).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["lang_pred"] == by[1001]["lang_pred"] == "und" and len(got) == len(rows)
    assert all(by[i]["lang_pred"] == g for i, _, g, _ in rows[:160] if by[i]["held_out"]) and all(0 <= x["score"] <= 1 for x in got)
    assert {r["lang_pred"] for r in op5_langid.identify(table(spark, ODD[:1])).collect()} == {"und"}


def test_languages_are_what_plain_steps_give(spark):
    """Two expectation steps over the vocabulary, smoothing, and a text's posterior, with dictionaries."""
    r = random.Random(6)
    voc = {"aa": "the and shing tion onder weath".split(), "bb": "der und schaft keit ung zwisch".split(), "cc": "部署 失败 我们".split()}
    rows = [(i, " ".join("".join(r.choices(voc[g], k=2)) for _ in range(r.randint(1, 30))), g, g) for i in range(60) for g in [("aa", "bb", "cc")[i % 3]]]
    rows += [(100, "theandtion " * 400, "aa", "s"), (101, "部署失败" * 500, "cc", "s"), (102, None, "aa", "s"), (103, "?! 12", "bb", "s"), (104, "der und", None, "s")]
    rows += [rows[5], rows[5]]
    pieces, start = vocabulary()
    crc = lambda i: zlib.crc32(str(i).encode()) % 4
    learnt = [(words(t), g) for i, t, g, _ in rows if crc(i) != 2 and t is not None and g is not None]
    langs = sorted({g for _, g in learnt})
    logs = dict(zip(pieces, start))
    for _ in range(op5_langid.ITERATIONS):
        uses = {g: Counter() for g in langs}
        for ws, g in learnt:
            for w, k in Counter(ws).items():
                w = b" " + w
                a, z = plain_alpha(w, logs), plain_alpha(w[::-1], {p[::-1]: x for p, x in logs.items()})[::-1]
                for i in range(len(w)):
                    for j in range(i + 1, min(len(w), i + 64) + 1):
                        if w[i:j] in logs:
                            uses[g][w[i:j]] += k * math.exp(a[i] + logs[w[i:j]] + z[j] - a[-1])
        total = {g: sum(uses[g].values()) for g in langs}
        pool = {p: sum(uses[g][p] / max(total[g], 1e-9) for g in langs) + math.exp(x) * 1e-2 for p, x in zip(pieces, start)}
        whole = sum(pool.values())
        pool = {p: x / whole for p, x in pool.items()}
        logs = {p: math.log(x) for p, x in pool.items()}
    by = {g: {p: math.log((uses[g][p] + op5_langid.POOL_WEIGHT * pool[p]) / (total[g] + op5_langid.POOL_WEIGHT)) for p in pieces} for g in langs}
    sizes = Counter(g for _, g in learnt)
    prior = {g: math.log((sizes[g] + 1) / (len(learnt) + len(langs))) for g in langs}
    met = {w: {g: plain_marginal(w, by[g]) for g in langs} for w in {w for _, t, *_ in rows for w in words(t)}}
    for x in op5_langid.identify(table(spark, rows)).collect():
        t = next(t for i, t, *_ in rows if i == x["doc_id"])
        assert x["held_out"] == (crc(x["doc_id"]) == 2)
        if not any(c.isalpha() for c in t or ""):
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
            continue
        ws = words(t)
        sums = {g: sum(met[w][g] for w in ws) / max(1.0, len(ws) / 20) + prior[g] for g in langs}
        best = max(sums, key=lambda g: sums[g])
        assert x["lang_pred"] == best and x["score"] == pytest.approx(math.exp(sums[best] - log_add(list(sums.values()))), abs=1e-6)
    assert op5_langid.identify(table(spark, rows).limit(0)).count() == 0


# 1 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_corpus():
    r = random.Random(8)
    bad = "grubnok vasteel morwit".split()
    rows, labels = [], []
    for i in range(300):
        w = prose(40, r).split()
        y = i % 4 == 0
        if y:
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(y)))
    return rows, labels


def test_restoration(spark, toxic_corpus):
    lm = op1_toxicity.character_model(table(spark, toxic_corpus[0])).tolist()
    for written in ("grubnok", "grubn0k", "g r u b n o k", "g.r.u.b.n.o.k", "grrrubnoook", "gru8nok", "grubnok!!"):
        assert op1_toxicity.restore(written.encode(), lm) == [b"grubnok"], written
    assert op1_toxicity.restore(b"...", lm) == [] and op1_toxicity.restore(b"tanmerlo", lm) == [b"tanmerlo"]


def test_restoration_of_long_tokens(spark, toxic_corpus):
    lm = op1_toxicity.character_model(table(spark, toxic_corpus[0])).tolist()
    spaced = " ".join("tanmerlogrubnokvistorenkadupelish" * 2)
    assert any(b"grubnok" in w for w in op1_toxicity.restore(spaced.encode(), lm))
    assert op1_toxicity.restore(b"gru8n0k" + b"-" + b"-".join([b"tanmerlo"] * 8 + [b"v4steel"]), lm) == [b"grubnok"] + [b"tanmerlo"] * 8 + [b"vasteel"]
    assert op1_toxicity.restore(b"grubn" + b"o" * 3000 + b"k", lm) == [b"grubnok"]
    long = b"gru8n0k-v4steel." * 200
    whole, cut = op1_toxicity.decode(long, lm), op1_toxicity.SETTLE
    op1_toxicity.SETTLE = 10**9
    try:
        assert op1_toxicity.decode(long, lm) == whole
    finally:
        op1_toxicity.SETTLE = cut


def test_restoration_at_edges(spark):
    text = " ".join(["kill", "shit", "cunt", "ass", "tass", "plain", "words"] * 40)
    lm = op1_toxicity.character_model(table(spark, [(1, text, "en", "s")])).tolist()
    for written, word in (("a$$", "ass"), ("ki||", "kill"), ("shi+", "shit"), ("(unt", "cunt"), ("455", "ass"), ("@55", "ass"), ("+@$$", "tass"), ("\"a$$\",", "ass")):
        assert word.encode() in op1_toxicity.readings(written.encode(), lm), written
    assert op1_toxicity.readings(b"...", lm) == [] and op1_toxicity.readings(b"plain,", lm) == [b"plain"]
    assert b"plain" in op1_toxicity.readings(b"(plain!)", lm) and b"1990" in op1_toxicity.readings(b"1990", lm)
    for run in ("k  i  l  l", "k\ni\nl\nl", "s h i +", "( u n t", "ж у к"):
        assert run.encode() in op1_toxicity.words_of(f"tan {run} mer".encode(), lm), run
    assert not op1_toxicity.SPACED.search("a – b • c".encode())


def every_path(token, lm, edges):
    """All restorations of a token with their scores: what decode() searches."""
    n = len(token)
    has = [97 <= c <= 122 or c > 127 for c in token]
    first, last = (-1, n) if edges else (has.index(True), n - 1 - has[::-1].index(True))
    found = [((0, 0, 0), 0.0, b"")]
    for i, c in enumerate(token):
        inside, separator = i < last and (i > first or i == first - 1), c in op1_toxicity.SEPARATORS
        new = []
        for (a, b, d), score, text in found:
            step = lambda k, out, cost: new.append(((b, d, k), score + cost + lm[a][b][d][k], text + out))  # noqa: B023, E731
            stay = lambda cost: new.append(((a, b, d), score + cost, text))  # noqa: B023, E731
            if has[i]:
                step(27 if c > 127 else c - 96, token[i : i + 1], 0.0)
                if c < 128 and i and token[i - 1] == c:
                    stay(op1_toxicity.RUN_COST if i > 1 and token[i - 2] == c or token[i + 1 : i + 2] == token[i : i + 1] else op1_toxicity.DOUBLE_COST)
                continue
            breaks = op1_toxicity.BREAK_COST if inside and not separator else 0.0
            step(0, b" ", breaks) if d else stay(breaks)
            for x in op1_toxicity.LEET.get(token[i : i + 1], b""):
                step(x - 96, bytes([x]), op1_toxicity.LEET_COST * (1 if inside else 2))
            if inside and (separator or i and token[i - 1] == c):
                stay(op1_toxicity.DROP_COST)
        found = new
    return [(s + (lm[a][b][d][0] if d else 0.0), t.strip()) for (a, b, d), s, t in found]


def test_decoding_finds_the_best_path(spark, toxic_corpus):
    lm = op1_toxicity.character_model(table(spark, toxic_corpus[0])).tolist()
    r = random.Random(21)
    for k in range(150):
        token = "".join(r.choices("grubnokvas0135@$!.-_| é", k=r.randint(1, 9))).replace(" ", "").encode()
        edges = k % 2 == 0
        if not token or not edges and not any(97 <= c <= 122 or c > 127 for c in token):
            continue
        paths = every_path(token, lm, edges)
        best = max(s for s, _ in paths)
        assert op1_toxicity.decode(token, lm, edges) in {t for s, t in paths if s > best - 1e-9}, token


def test_toxicity_of_odd_rows(spark, toxic_corpus):
    rows, labels = toxic_corpus
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    long = prose(30_000) + " gru8n0k"
    extra = [(2000, long, "en", "s"), (2001, "g" * 20_000, "en", "s"), rows[3], rows[3]]
    got = op1_toxicity.score_documents(table(spark, rows + extra), lab).collect()
    assert len(got) == len(rows) + 4 and len({r["score"] for r in got if r["doc_id"] == rows[3][0]}) == 1
    assert next(r for r in got if r["doc_id"] == 2000)["worst"] == "grubnok"
    assert op1_toxicity.score_documents(table(spark, rows).limit(0), lab).count() == 0


def test_toxicity(spark, toxic_corpus):
    rows, labels = toxic_corpus
    extra = [(1000, "tan mer lo gru8n0k vi sto", "en", "s"), (1001, "ren ka v a s t e e l du", "en", "s"), (1002, "tan mer lo vi sto", "en", "s"), (1003, None, None, None), (None, "", None, None)]
    lab = spark.createDataFrame(labels + [(5, None, None), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in op1_toxicity.score_documents(table(spark, rows + extra), lab).collect()}
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003, None)] == [1, 1, 0, 0, 0]
    held = [i for i, *_ in rows if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert op1_toxicity.score_documents(table(spark, rows), lab.limit(0)).filter("score <> 0").count() == 0


def test_toxicity_scores_do_not_shift_with_the_sample(spark):
    """A word that one in four of its documents is toxic for, where one document in ten is toxic."""
    r = random.Random(12)
    rows, labels = [], []
    for i in range(2400):
        y = i % 10 == 0
        rows.append((i, prose(12, r) + (" morwit" if r.random() < (0.6 if y else 0.2) else ""), "en", "s"))
        labels.append((i, 1, int(y)))
    docs, lab = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole, small = ([x["score"] for x in op1_toxicity.score_documents(docs, lab, n).filter("held_out").collect()] for n in (20_000, 190))
    assert abs(np.mean(whole) - 0.1) < 0.03 and abs(np.mean(small) - np.mean(whole)) < 0.03
    assert all(np.mean(np.array(scores) >= 0.5) < 0.05 for scores in (whole, small))


# pipeline --------------------------------------------------------------------------------------


def test_pipeline_against_plain_steps(spark, corpus, tmp_path):
    docs = table(spark, corpus)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in op3_quality.clean_documents(docs).collect()]
    assert {i for i, *_ in rows} == {i for i, t, *_ in corpus if op3_quality.judge((t or "").encode(), op3_quality.Rules())[6]}
    groups = defaultdict(list)
    for x in rows:
        groups[norm(x[1])].append(x)
    rows = [min(g, key=lambda x: (-len(x[1]), x[0])) for g in groups.values()]
    kept = {c for _, n, c in plain_components(rows, 5, 80) if n}
    rows = [x for x in rows if x[0] in kept]
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    budget = {s: math.floor(v + 1e-9) for s, v in plain_targets(sizes).items()}
    want = []
    for s in sizes:
        left = budget[s] % sizes[s]
        for i, t, *_ in sorted((x for x in rows if x[3] == s), key=lambda x: (hashlib.md5(str(x[0]).encode()).hexdigest(), x[0])):
            n = len(t.split())
            part = min(max(left, 0), n)
            want += [i] * -(-(budget[s] // sizes[s] * n + part) // n)
            left -= n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    by = {x[0]: len(x[1].split()) for x in rows}
    check_packing(got, [by[i] for i in want], op9_packing.BUDGET)


def test_stages_take_empty_tables(spark):
    docs = table(spark, ODD).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_op4_noise_in_little_memory():
    """Pipeline, driver's memory: as floating point the sketch took 256 MB at once."""
    sketch = np.random.default_rng(3).integers(0, 256, 1 << op4_ngram_join.SKETCH_BITS).astype(np.uint8)
    tracemalloc.start()
    got = op4_ngram_join.noise(sketch)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    mean = math.fsum(float(n) * (2.0 ** (level / 8.0) - 1.0) for level, n in enumerate(np.unique(sketch, return_counts=True)[1])) / len(sketch)
    assert math.isclose(got, mean + 2 * mean**0.5, rel_tol=1e-9) and peak < 16 << 20


def test_op4_small_batches(spark, monkeypatch):
    """op4, executors' memory: every step hands Python batches of a few MB, and the session's setting comes back."""
    before, seen = spark.conf.get(BATCH_BYTES), set()

    def watched(df, name):
        seen.add(spark.conf.get(BATCH_BYTES))
        return materialise(df, name)

    monkeypatch.setattr(op4_ngram_join, "materialise", watched)
    docs = spark.createDataFrame([(i, f"a b c d e {i % 3}") for i in range(9)], "doc_id long, text string")
    assert op4_ngram_join.join_classes(docs).select("component_id").distinct().count() == 3
    assert seen == {str(4 << 20)} and spark.conf.get(BATCH_BYTES) == before

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    large = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), F.lit(1 << 20)).alias("text")).mapInArrow(sizes, "n long")
    with small_batches(spark):
        assert large.agg(F.max("n")).first()[0] < 8 << 20
