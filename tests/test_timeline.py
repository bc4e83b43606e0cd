"""Search, passages, chunks, speech, packs, frames: fixed cases and plain versions of the rules."""

import pickle
import random
import re
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import postings as P
from chronolith.operators import speech as S
from chronolith.functions import text as T
from chronolith.operators.chunks import ChunkRules, Pending, chunk_step, chunks, closed
from chronolith.operators.frames import Frame, FrameWatch, hash_code, pick_frames, select_frames, throttle
from chronolith.operators.runs import best_run
from chronolith.operators.windows import asof_backward, even_indices
from chronolith.plans import context as X
from chronolith.plans import search as Q
from chronolith.timeline import Timelines

SEG = "video_id long, idx long, start_s double, end_s double, text string"
MANY = {
    "en": "The deployment failed because the database was offline.", "pt": "A configuração do servidor mudou ontem.", "es": "La reunión comienza mañana por la mañana.",
    "fr": "Les résultats financiers étaient excellents.", "de": "Die Straße wurde wegen Bauarbeiten gesperrt.", "ru": "Новая версия выходит завтра.",
    "zh": "昨天的部署失败了。", "ja": "新しいバージョンをリリースします。", "hi": "यह परियोजना समाप्त हो गई।", "ar": "الاجتماع القادم يوم الأحد.",
}


def rows(spark, texts, video=1, step=5.0, length=4.5):
    return spark.createDataFrame([(video, i, step * i, step * i + length, t) for i, t in enumerate(texts)], SEG)


@pytest.mark.parametrize("query,best", [("why did the deployment fail", 0), ("configuracao", 1), ("reunión", 2), ("resultats", 3), ("strasse", 4), ("версия", 5), ("部署失败", 6), ("परियोजना", 8), ("الاجتماع", 9)])
def test_multilingual_search(spark, query, best):
    seg = rows(spark, list(MANY.values()), step=200.0)
    found = Q.search(seg, {0: P.Query.parse(query)}).filter("rank = 0").collect()
    assert found[0]["segment_ids"][0] == f"seg_{best:05d}" and found[0]["score"] == 1.0


def test_search_checks_its_options(spark):
    for bad in ({"limit": 0}, {"expand": -1.0}):
        with pytest.raises(ValueError):
            Q.SearchOptions(**bad)


def test_bm25_is_fts5_s(spark):
    random.seed(5)
    vocab = ["alpha", "beta", "gamma", "deltas", "delta", "deploy", "deployed", "deployment", "omega"]
    texts = [" ".join(random.choices(vocab, k=random.randint(1, 30))) for _ in range(40)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(body, tokenize='unicode61')")
    db.executemany("insert into f(rowid, body) values (?, ?)", list(enumerate(texts)))
    for text in ("alpha", "deployment omega", "beta gamma deltas", "deploy"):
        q = P.Query.parse(text)
        want = {r: -s for r, s in db.execute("select rowid, bm25(f) from f where f match ?", (q.expression(),))}
        got = P.bm25(P.unit_frequencies(P.with_stats(P.index(rows(spark, texts))), {0: q})).collect()
        assert {r["idx"] for r in got} == set(want)
        for r in got:
            assert r["score"] == pytest.approx(want[r["idx"]], abs=1e-9)


def test_stored_index_gives_the_same_results(spark, tmp_path):
    random.seed(6)
    words = "deploy deployed deployment database offline failed fail failing server Straße 部署 失败 the of and database".split()
    seg = spark.createDataFrame([(v, i, 6.0 * i, 6.0 * i + 5, " ".join(random.choices(words, k=random.randint(1, 14)))) for v in range(5) for i in range(40)], SEG)
    t = Timelines(spark, str(tmp_path))
    t.index(seg)
    for text, options in (("deployment failed", {}), ("database", {"limit": 3, "expand": 4.0}), ("部署失败", {}), ("the database of", {"start": 30.0, "end": 90.0}), ("strasse deploy", {}), ("nothing", {}), ("?!", {})):
        want = Q.search(seg, {0: P.Query.parse(text)}, Q.SearchOptions(**options)).drop("query_id")
        assert sorted(map(str, t.search(text, **options).collect())) == sorted(map(str, want.select(t.search(text, **options).columns).collect())), text
    found = P.stored_frequencies(t._read("postings"), t._read("stats"), {0: P.Query.parse("database")})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan), plan


def fold_chunks(segs, held=Pending(), rules=ChunkRules()):
    out = []
    for x in segs:
        held, done = chunk_step(held, x, rules)
        out += done
    return held, out


def plain_chunks(segs, rules=ChunkRules()):
    held, out = fold_chunks(segs, rules=rules)
    return out + closed(held)


def test_chunks_in_plan_are_those_of_the_steps(spark):
    random.seed(7)
    segs, t = [], 0.0
    for i in range(400):
        d = random.choice([0.4, 2.0, 5.0, 11.0, 70.0 if random.random() < 0.05 else 3.0])
        segs.append((i, round(t, 3), round(t + d, 3), random.choice(["word", "end.", "more?", "and"])))
        t += d + random.choice([0.0, 0.3, 0.6, 9.0])
    df = spark.createDataFrame([(1, *s) for s in segs], SEG)
    got = [(r["first_segment"], r["last_segment"], r["start_s"], r["end_s"], r["text"]) for r in chunks(df).orderBy("idx").collect()]
    assert got == plain_chunks(segs)
    assert [i for a, b, *_ in got for i in range(a, b + 1)] == list(range(400))


def test_chunks_resume():
    segs = [(i, 4.0 * i, 4.0 * i + 3.5, "go on." if i % 3 == 0 else "and") for i in range(50)]
    held, first = fold_chunks(segs[:23])
    held, more = fold_chunks(segs[23:], pickle.loads(pickle.dumps(held)))
    assert first + more + closed(held) == plain_chunks(segs)


def test_pause_ends_a_chunk():
    assert [x[:2] for x in plain_chunks([(0, 0.0, 6.0, "a"), (1, 6.0, 12.0, "b"), (2, 40.0, 45.0, "c")])] == [(0, 1), (2, 2)]


def windows(spans, total):
    p = np.zeros(round(total * S.RATE / S.WINDOW))
    for a, b in spans:
        p[round(a * S.RATE / S.WINDOW) : round(b * S.RATE / S.WINDOW)] = 1.0
    return p.tolist()


def regions(p, size=None, rules=S.SpeechRules()):
    d = S.SpeechDetector(rules)
    out = []
    for at in range(0, len(p), size or len(p)):
        out += d.feed(p[at : at + (size or len(p))])
    return [(s / S.RATE, e / S.RATE) for s, e in out + d.finish()]


def test_regions_are_padded_and_short_ones_dropped():
    got = regions(windows([(2, 4), (5.0, 5.1), (8, 10)], 12))
    assert [(round(a, 1), round(b, 1)) for a, b in got] == [(1.8, 4.2), (7.8, 10.2)]


def test_short_pause_is_kept_inside():
    assert len(regions(windows([(2, 4), (4.3, 6)], 9))) == 1


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_regions_do_not_depend_on_block_size(size):
    rng = np.random.default_rng(1)
    p = np.repeat(rng.random(300), rng.integers(1, 30, 300)).tolist()
    assert regions(p, size) == regions(p)


def test_long_speech_is_split():
    got = regions(windows([(1, 36)], 40), rules=S.SpeechRules(max_region=10.0))
    assert len(got) >= 3 and all(b - a <= 10.0 + 1e-9 for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_regions_in_plan(spark):
    p = windows([(2, 4), (8, 10), (20, 50)], 60)
    df = spark.createDataFrame([(s, w, v) for s in (1, 2) for w, v in enumerate(p)], "stream_id long, w long, p double")
    got = S.speech_regions(df).orderBy("stream_id", "region").collect()
    want = [(int(a * S.RATE), int(b * S.RATE)) for a, b in regions(p)]
    assert [(r["start_sample"], r["end_sample"]) for r in got] == want * 2


def plain_regions(p, r=S.SpeechRules()):
    """The rule window by window, as the survey states it, with 0 for what is not set."""
    spans, on, start, hush, cut, resume = [], False, 0, 0, 0, 0
    for i, x in enumerate(p):
        now = 512 * i
        if x >= r.threshold and hush:
            hush = 0
            if resume < cut:
                resume = now
        if x >= r.threshold and not on:
            on, start = True, now
            continue
        if on and now - start > 16 * 1000 * r.max_region - 512 - 2 * 16 * r.padding:
            if not cut:
                spans.append((start, now))
                on, hush, cut, resume = False, 0, 0, 0
                continue
            spans.append((start, cut))
            on, start = (False, start) if resume < cut else (True, resume)
            hush = cut = resume = 0
        if on and x < max(r.threshold - 0.15, 0.01):
            hush = hush or now
            if now - hush > 98 * 16:
                cut = hush
            if now - hush >= 16 * r.min_silence:
                if hush - start > 16 * r.min_speech:
                    spans.append((start, hush))
                on, hush, cut, resume = False, 0, 0, 0
    if on and 512 * len(p) - start > 16 * r.min_speech:
        spans.append((start, 512 * len(p)))
    return spans


def test_spans_are_those_of_the_rule():
    rng = np.random.default_rng(8)
    for k in range(60):
        rules = S.SpeechRules(max_region=float(rng.choice([2.0, 5.0, 28.0])))
        values = rng.choice([0.05, 0.3, 0.34, 0.36, 0.45, 0.5, 0.9], 120, p=[0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.3])
        p = np.repeat(values, rng.integers(1, 40 if k % 2 else 6, 120)).tolist()
        found = []
        d = S.SpeechDetector(rules)
        d._join = lambda a, b: found.append((a, b))
        d.feed(p)
        d.finish()
        assert found == plain_regions(p, rules)


def test_nothing_begins_before_the_frontier():
    rng = np.random.default_rng(4)
    p = np.repeat(rng.random(200), rng.integers(1, 40, 200)).tolist()
    d, marks, found = S.SpeechDetector(), [], []
    for at in range(0, len(p), 13):
        found += [(len(marks), x) for x in d.feed(p[at : at + 13])]
        marks.append(d.frontier)
    found += [(len(marks), x) for x in d.finish()]
    assert marks == sorted(marks) and max(marks) > 0 and all(start >= m for k, (start, _) in found for m in marks[:k])


def plain_packs(regs, rules=S.PackRules()):
    held, out = S.Pack(), []
    for a, b in regs:
        held, done = S.pack_step(held, a, b, rules)
        out += [list(done)] if done else []
    return out + ([list(held.regions)] if held.regions else [])


def test_packs_in_plan_are_those_of_the_steps(spark):
    random.seed(3)
    t, regs = 0, []
    for i in range(70):
        n = random.randint(4000, 90_000)
        regs.append((i, t, t + n))
        t += n + random.choice([1000, 20_000, 60_000])
    df = spark.createDataFrame([(1, *r) for r in regs], "stream_id long, region int, start_sample long, end_sample long")
    got: dict = {}
    for r in S.packs(df).orderBy("region").collect():
        got.setdefault(r["pack"], []).append((r["start_sample"], r["end_sample"]))
    assert [got[k] for k in sorted(got)] == plain_packs([x[1:] for x in regs])


def test_first_pack_is_short():
    out = plain_packs([(2 * i * S.RATE, (2 * i + 1) * S.RATE) for i in range(70)], S.PackRules(join_gap=5.0))
    sizes = [sum(b - a for a, b in x) / S.RATE for x in out]
    assert sizes[0] == 10 and max(sizes) <= 30 and sum(sizes) == 70


def test_open_packs_are_due():
    held, _ = S.pack_step(S.Pack(), 0, 5 * S.RATE)
    assert S.pack_due(held, 7 * S.RATE, 7 * S.RATE) == (held, ())
    assert S.pack_due(held, 9 * S.RATE, 9 * S.RATE) == (S.Pack(out=1), ((0, 5 * S.RATE),))
    assert S.pack_due(held, 120 * S.RATE, 6 * S.RATE)[1] and not S.pack_due(S.Pack(), 10**9, 10**9)[1]


def test_late_pieces_go_and_gaps_are_filled(spark):
    random.seed(9)
    at, rows = 0.0, []
    for i in range(300):
        at += random.choice([1.0, 1.0, 1.0, 1.05, 1.5, 0.2, 0.95])
        rows.append((1, i, at, 1.0))
    due, want = None, []
    for _, i, a, d in rows:
        drift = 0.0 if due is None else a - due
        if drift >= -0.1:
            want.append((i, round(drift if drift > 0.1 else 0.0, 9)))
            due = a + d
    got = S.align(spark.createDataFrame(rows, "stream_id long, seq long, at double, dur double")).orderBy("seq").collect()
    assert [(r["seq"], round(r["gap"], 9)) for r in got] == want


def test_throttle(spark):
    random.seed(10)
    ts = sorted({round(random.random() * 60, 3) for _ in range(500)} | {100.0, 101.0, 102.5})
    due, want = None, []
    for t in ts:
        if due is None or t >= due - 1e-6:
            want.append(t)
            due = t + 1 / 0.8
    df = spark.createDataFrame([(v, t) for v in (1, 2) for t in ts], "video_id long, t double")
    assert [r["t"] for r in throttle(df, 0.8).filter("video_id = 1").orderBy("t").collect()] == want


def packed(spark, spans):
    at, parts = 0.0, []
    for a, b in spans:
        parts.append((float(at * S.RATE), float(a * S.RATE), float((b - a) * S.RATE)))
        at += b - a
    return spark.createDataFrame([(parts,)], "regions array<struct<offset:double,start:double,length:double>>")


def test_time_map(spark):
    df = packed(spark, [(10, 15), (100, 104), (500, 510)])
    for t, end, want in ((0.0, False, 10), (2.5, False, 12.5), (6.0, False, 101), (9.0, False, 500), (5.0, False, 100), (5.0, True, 15), (99.0, False, 510)):
        assert df.select(S.media_time(F.col("regions"), F.lit(t * S.RATE), end) / S.RATE).first()[0] == pytest.approx(want)


def test_seam_trim(spark):
    df = packed(spark, [(10, 20), (80, 90)])
    for a, b, want in ((9.6, 16, (80, 86)), (4, 10.3, (14, 20)), (6, 14, (16, 84))):
        x = df.select(S.map_span(F.col("regions"), F.lit(float(a)), F.lit(float(b))).alias("x")).first()["x"]
        assert (x["start_s"], x["end_s"]) == pytest.approx(want)


def frame_rows(decks, fps=2):
    rng = {s: np.random.default_rng(s).integers(0, 255, 64) for _, _, s in decks}
    return [(1, i / fps, i, [int(v) for v in rng[next(s for a, b, s in decks if a <= i / fps < b)]]) for i in range(int(decks[-1][1] * fps))]


def test_frames_a_b_a_keeps_two(spark):
    found = frame_rows([(0, 10, 1), (10, 20, 2), (20, 30, 1)])
    df = spark.createDataFrame(found, "video_id long, t double, frame_id long, pixels array<int>")
    got = select_frames(df, 8, "screen").orderBy("idx").collect()
    assert [r["reason"] for r in got] == ["start", "change"] and [r["idx"] for r in got] == [1, 2] and 10 <= got[1]["t"] < 12


def test_static_picture_is_one_frame():
    s = FrameWatch("auto")
    p = np.arange(64)
    assert [x for i in range(100) if (x := s.see(Frame(i / 2, p, hash_code(p, 8), i)))] == [(0, 0.0, "start")]


def plain_frames(rows, strategy, interval, most, bits):
    """The rule of frame selection with lists of everything seen."""
    rules = {"screen": (3.0, True, None, 0.0, 1.5), "scenes": (25.0, False, None, 0.0, 1.0), "interval": (float("inf"), False, interval, 0.0, 0.0), "auto": (12.0, True, interval, 1.5, 4.0)}
    mad = lambda a, b: sum(abs(x - y) for x, y in zip(a, b)) / len(a)
    code = lambda p: [p[i + 1] > p[i] for i in range(len(p) - 1) if i % 8 != 7]
    steps, kept, out, shown, pending, before = [], [], [], None, None, None

    def offer(t, i, p, why):
        nonlocal shown
        shown = p
        alike = any(sum(x != y for x, y in zip(code(p), code(q))) <= bits and mad(p, q) <= 4.0 for _, q in kept[-8:])
        if len(kept) < most and not (alike and why != "start"):
            kept.append((t, p))
            out.append((i, t, why))

    for t, i, p in rows:
        if before is not None:
            steps.append(mad(p, before))
        before = p
        if shown is None:
            offer(t, i, p, "start")
        elif pending is not None:
            if steps[-1] <= 1.5 or t - pending >= 4.0:
                pending = None
                offer(t, i, p, "change")
        else:
            last = sorted(steps[-30:])
            still = len(last) >= 5 and (last[(len(last) - 1) // 2] + last[len(last) // 2]) / 2 < 0.6
            change, settle, every, every_diff, gap = rules["screen" if strategy == "auto" and still else strategy]
            away, waited = mad(p, shown), t - kept[-1][0]
            if away >= change and waited >= gap:
                if settle:
                    pending = t
                else:
                    offer(t, i, p, "change")
            elif every is not None and waited >= every and away >= every_diff:
                offer(t, i, p, "interval")
    if pending is not None:
        offer(*rows[-1], "end")
    return out


@pytest.mark.parametrize("strategy", ["auto", "screen", "scenes", "interval"])
def test_frames_are_those_of_the_rule(spark, strategy):
    rng = np.random.default_rng(13)
    rows, want = [], {}
    for video in range(6):
        p, t, own = rng.integers(0, 256, 64), 0.0, []
        scenes = [rng.integers(0, 256, 64) for _ in range(4)]
        for i in range(150):
            t += float(rng.choice([0.5, 0.5, 1.0, 2.5]))
            kind = rng.random()
            p = scenes[rng.integers(4)] if kind < 0.08 else np.clip(p + rng.integers(-30, 31, 64), 0, 255) if kind < 0.25 else np.clip(p + rng.integers(-2, 3, 64), 0, 255) if kind < 0.5 else p
            own.append((t, i, [int(v) for v in p]))
        rows += [(video, *x) for x in own]
        want[video] = plain_frames(own, strategy, 5.0, 20, 10)
    df = spark.createDataFrame(rows, "video_id long, t double, frame_id long, pixels array<int>").repartition(3)
    got = {v: [] for v in want}
    for r in select_frames(df, 8, strategy, 5.0, 20).orderBy("video_id", "idx").collect():
        got[r["video_id"]].append((r["frame_id"], r["t"], r["reason"]))
    assert got == want and all(want.values())


def test_cap_of_frames(spark):
    rng = np.random.default_rng(2)
    rows = [(1, float(2 * i), i, [int(v) for v in rng.integers(0, 255, 64)]) for i in range(30)]
    df = spark.createDataFrame(rows, "video_id long, t double, frame_id long, pixels array<int>")
    assert [select_frames(df, 8, "interval", 1.0, most).count() for most in (7, 1000)] == [7, 30]
    with pytest.raises(ValueError):
        select_frames(df, 8, "guess")


def test_strip_takes_blanks_of_any_script(spark):
    texts = ["\u00a0 a\tb \u3000", "\x1c\u2003", "", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(T.strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_even_indices(spark):
    f = lambda n, k: spark.range(1).select(even_indices(F.lit(n), k)).first()[0]
    assert f(10, 3) == [0, 4, 9] and f(2, 3) == [0, 1] and f(0, 3) == [] and f(7, 1) == [0]


def test_pick_frames(spark):
    df = spark.createDataFrame([(1, float(i), i, i == 5) for i in range(20)], "video_id long, t double, frame_id long, preferred boolean")
    # Without frame 5 the places 0, 9 and 18 of the rest are frames 0, 10 and 19.
    assert sorted(r["frame_id"] for r in pick_frames(df, 4).collect()) == [0, 5, 10, 19]


def test_asof_tolerance(spark):
    a = spark.createDataFrame([(1, 5.0), (1, 200.0), (2, 1.0)], "k int, at double")
    b = spark.createDataFrame([(1, 4.0, 10), (1, 5.0, 11), (1, 6.0, 12)], "k int, t double, f int")
    got = {(r["k"], r["at"]): r["f"] for r in asof_backward(a, b, ["k"], "at", "t", "f", 120.0).collect()}
    assert got == {(1, 5.0): 11, (1, 200.0): None, (2, 1.0): None}


def test_best_run(spark):
    df = spark.createDataFrame([(1, "t", "a", "partial", 90.0, 1), (2, "t", "b", "complete", 10.0, 0), (3, "t", "c", "partial", 99.0, 9)], "run_id int, kind string, config string, status string, processed_until double, updated_at int")
    assert best_run(df, ["kind"]).first()["run_id"] == 2
    assert best_run(df, ["kind"], F.col("config") == "a").first()["run_id"] == 1


@pytest.mark.parametrize("most", [64, 90, 200, 4000])
def test_context_keeps_to_its_budget(spark, most):
    seg = rows(spark, [f"The deployment number {i} failed again for reasons nobody knows." for i in range(40)], step=30.0)
    q = {0: P.Query.parse("deployment failed")}
    facts = spark.createDataFrame([(1, "meeting", 1200.0, "en", "complete", 1200.0)], "video_id long, name string, duration double, language string, status string, indexed_until double")
    r = X.assemble(X.passages(seg, q), facts, q, X.ContextOptions(max_tokens=most)).first()
    assert r["estimated_tokens"] <= most or r["passages"] == 0
    assert r["estimated_tokens"] == X.count_tokens(r["text"])


def test_context_says_when_nothing_fits():
    with pytest.raises(ValueError):
        X.ContextOptions(max_tokens=63)


def test_passages_lose_the_edge_that_reaches_farther():
    part = lambda i, start, end: {"idx": i, "start_s": start, "end_s": end, "text": f"t{i}"}
    whole = X.Passage((part(0, 0.0, 5.0), part(1, 5.0, 30.0), part(2, 30.0, 90.0)), 0, 0.0, 60.0)
    # The middle is 30: the last part starts there but ends 60 s on, so it goes before the first.
    assert [(x.ids(), x.begin, x.end) for x in whole.narrower()] == [(["seg_00000", "seg_00001"], 0.0, 30.0), (["seg_00001"], 5.0, 30.0)]


def test_frames_of_the_passages_shown():
    f = lambda t, i: {"t": t, "frame_id": i}
    near = [f(10.0, 1), f(20.0, 2), f(30.0, 3), f(40.0, 4)]
    names = lambda *chosen, most=2: [x["frame_id"] for x in X.shown_in(list(chosen), most)]
    assert names((10.0, 40.0, near)) == [1, 4] and names((10.0, 40.0, near), most=3) == [1, 3, 4] and names((10.0, 40.0, near), most=1) == [1]
    # No frame inside: the last before, if not too far; a frame of two passages goes once.
    assert names((41.0, 50.0, near)) == [4] and names((161.0, 170.0, near)) == [] and names((0.0, 5.0, near)) == []
    assert names((25.0, 35.0, near), (36.0, 38.0, near), (39.0, 45.0, near)) == [3, 4]
    assert names() == []


def test_frames_near_passages(spark):
    found = spark.createDataFrame([(0, 1, 0, 100.0, 120.0, 95.0, 130.0), (0, 1, 1, 400.0, 410.0, 400.0, 410.0), (0, 2, 0, 0.0, 9.0, 0.0, 9.0)], "query_id int, video_id long, rank int, w_start double, w_end double, start_s double, end_s double")
    frames = spark.createDataFrame([(1, t, i) for i, t in enumerate([90.0, 94.0, 95.0, 130.0, 131.0, 270.0])], "video_id long, t double, frame_id long")
    got = {(r["video_id"], r["rank"]): [x["frame_id"] for x in r["near"]] for r in X.passage_frames(found, frames).collect()}
    assert got == {(1, 0): [2, 3]}
