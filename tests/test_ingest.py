"""Sound files to segments, with a recogniser that hears the pitch of tones."""

import json
import os

import numpy as np
import pytest

from chronolith.plans import ingest as I
from chronolith import cli
from chronolith.sources import media as M
from chronolith.streaming.sinks import Locked
from chronolith.timeline import Timelines
from tests.test_streams import tone

WORDS = {440: "The first tone is heard.", 660: "Then comes the second one.", 880: "A third, much later.", 1100: "And the last."}


class ToneEar:
    identity = "tones"

    def transcribe(self, samples, language):
        loud = [float(np.sqrt((samples[i : i + 160] ** 2).mean())) > 0.05 for i in range(0, len(samples) - 159, 160)]
        out, begin = [], None
        for i, x in enumerate([*loud, False]):
            if x and begin is None:
                begin = i
            if not x and begin is not None:
                part = samples[begin * 160 : i * 160]
                if len(part) >= 1600:
                    f = np.abs(np.fft.rfft(part)).argmax() * M.RATE / len(part)
                    out.append(I.Heard(begin / 100, i / 100, f" {WORDS[int(round(f / 10) * 10)]} ", -0.1, 0.01))
                begin = None
        return [*out, I.Heard(0.0, 0.1, "  ")]


def test_tones_become_segments(spark, tmp_path):
    events = [(2.0, 440, 3.0), (9.0, 660, 2.0), (75.0, 880, 4.0), (81.0, 1100, 2.5)]
    tone(tmp_path / "track.wav", events, 90)
    files = M.files(spark, str(tmp_path), "*.wav")
    got = I.transcribe(files, ToneEar, I.IngestConfig("tones")).orderBy("idx").collect()
    assert [r["text"] for r in got] == list(WORDS.values())
    for r, (at, _, d) in zip(got, events):
        assert (r["start_s"], r["end_s"]) == pytest.approx((at, at + d), abs=0.05)
    assert got[0]["confidence"] == 0.9048 and [r["idx"] for r in got] == [0, 1, 2, 3]


def test_configurations_have_keys_of_their_own():
    a, b = I.IngestConfig("tones"), I.IngestConfig("tones", pack_seconds=20.0)
    assert a.key() != b.key() and len(a.key()) == 24


class WordEar(ToneEar):
    """Hears words, tells the language by the pitch, and takes two packs at a time."""

    batch_size = 2
    calls: list = []

    def detect_language(self, samples):
        f = np.abs(np.fft.rfft(samples[:8000])).argmax() * M.RATE / 8000
        return ("low" if f < 600 else "high"), 0.9

    def transcribe_batch(self, sounds, languages):
        assert 1 <= len(sounds) <= 2 and all(languages)
        out = []
        for x, language in zip(sounds, languages):
            heard = [h for h in super().transcribe(x, language) if h.text.strip()]
            out.append([I.Heard(h.start, h.end, f"{language}: {h.text.strip()}", words=tuple(I.Word(h.start + k * 0.1, h.start + k * 0.1 + 0.1, w, 0.5) for k, w in enumerate(h.text.split()))) for h in heard])
        return out


def test_words_and_languages(spark, tmp_path):
    tone(tmp_path / "a.wav", [(2.0, 440, 3.0), (40.0, 660, 2.0)], 50)
    tone(tmp_path / "b.wav", [(5.0, 880, 2.0)], 10)
    got = I.transcribe(M.files(spark, str(tmp_path), "*.wav"), WordEar, I.IngestConfig("words", detect_language=True)).collect()
    texts = {(r["path"][-5:], r["idx"]): r for r in got}
    assert texts["a.wav", 0]["text"] == "low: " + WORDS[440] and texts["a.wav", 1]["text"] == "low: " + WORDS[660] and texts["b.wav", 0]["text"] == "high: " + WORDS[880]
    words = texts["a.wav", 1]["words"]
    assert [w["text"] for w in words] == WORDS[660].split() and words[0]["start_s"] == pytest.approx(40.0, abs=0.05) and words[2]["end_s"] == pytest.approx(40.3, abs=0.05)


class Broken(ToneEar):
    def transcribe(self, samples, language):
        raise RuntimeError("no ear")


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    """A run that fails keeps its commits; the next one takes the other files only, and a third finds nothing to do."""
    sounds = tmp_path / "sounds"
    sounds.mkdir()
    for k, f in enumerate((440, 660)):
        tone(sounds / f"{k}.wav", [(1.0, f, 2.0)], 5)
    t, config = Timelines(spark, str(tmp_path / "store")), I.IngestConfig("tones")
    assert t.ingest(str(sounds), ToneEar, config, "*.wav", files=1).count() == 2
    marks = sorted(x for x in os.listdir(f"{t.run(config).path}/commits") if x.isdigit())
    assert marks == ["0", "1"]
    tone(sounds / "2.wav", [(1.0, 880, 2.0)], 5)
    with pytest.raises(Exception, match="no ear"):
        t.ingest(str(sounds), Broken, config, "*.wav")
    assert t.run(config).read("segments").count() == 2
    rows = t.ingest(str(sounds), ToneEar, config, "*.wav")
    assert sorted(r["text"] for r in rows.collect()) == sorted(WORDS[f] for f in (440, 660, 880))
    assert t.run(config).read("chunks").count() == 3
    assert t.ingest(str(sounds), Broken, config, "*.wav").count() == 3
    assert t.ingest(str(sounds), ToneEar, I.IngestConfig("tones", pack_seconds=20.0), "*.wav").count() == 3
    store = t.run(config)
    store.lock()
    with pytest.raises(Locked):
        t.ingest(str(sounds), ToneEar, config, "*.wav")
    t.index(rows)
    assert t.search("second").count() == 1


def test_tables_of_a_batch_are_seen_together(spark, tmp_path):
    store = Timelines(spark, str(tmp_path)).run(I.IngestConfig("x"))
    store.commit({"segments": spark.range(4), "chunks": lambda w: w["segments"].filter("id > 1")}, 0)
    assert store.read("segments").count() == 4 and store.read("chunks").count() == 2

    def fail(written):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.commit({"segments": spark.range(9), "chunks": fail}, 1)
    assert store.read("segments").count() == 4


def test_command_line_of_ingest(spark, tmp_path, capsys, monkeypatch):
    sounds = tmp_path / "sounds"
    sounds.mkdir()
    tone(sounds / "a.wav", [(1.0, 440, 2.0)], 5)
    run = lambda *a: cli.main([str(tmp_path / "store"), "--json", *a], spark)
    assert run("models") == 0 and json.loads(capsys.readouterr().out.splitlines()[0])["profile"] == "fast"
    assert run("transcribe", str(sounds), "--recogniser", "tests.test_ingest:NoEar") == 1
    assert run("transcribe", str(sounds), "--recogniser", "tests.test_ingest:ToneEar") == 0
    video = json.loads(capsys.readouterr().out.splitlines()[-1])["video_id"]
    assert run("search", "tone") == 0 and WORDS[440] in capsys.readouterr().out
    monkeypatch.setattr(cli.chat.ChatModel, "_post", lambda self, body: {"choices": [{"message": {"content": body["messages"][1]["content"][-4:]}}], "usage": {"total_tokens": 3}})
    assert run("ask", str(video), "who?", "--base-url", "http://localhost:1", "--llm-model", "m") == 0
    assert json.loads(capsys.readouterr().out)["text"] == "who?"
