"""Answers, tools, the front and its command line."""

import json

import pytest

from chronolith import cli
from chronolith.plans.ask import Toolbox, ask, choose_evidence, explore
from chronolith.sources import chat
from chronolith.timeline import NotIndexed, Timelines


class Scripted:
    supports_images = True

    def __init__(self, *replies):
        self.replies, self.seen = list(replies), []

    def complete(self, messages, **options):
        self.seen.append((json.loads(json.dumps(messages)), options))
        return self.replies.pop(0)


def test_ask_sends_evidence_and_pictures():
    m = Scripted(chat.Reply("42", usage={"total_tokens": 7}))
    out = ask(m, "why?", "EVIDENCE", ["data:x"])
    assert out.text == "42" and out.tokens("nothing", "total_tokens") == 7
    assert "EVIDENCE" in m.seen[0][0][1]["content"][0]["text"]


def test_explore_calls_tools_and_stops():
    call = chat.Call("1", "search", {"query": "x"})
    bad = chat.Call("2", "read", {"start": "soon"})
    look = chat.Call("3", "look", {"times": [1, 2, 3, 4, 5, 99]})
    m = Scripted(chat.Reply("", (call, bad), {"total": 1, "d": {"a": 2}}), chat.Reply("", (look,), {"total": 2, "d": {"a": 3}, "flag": True}), chat.Reply("done", (), {"total": 3}))
    tools = Toolbox(lambda q: f"found {q}", lambda a, b: "text", lambda ts: {f"view_{i:03d}": "data:" for i, _ in enumerate(ts)}, duration=10.0)
    out = explore(m, "why?", "opening", tools)
    assert out.text == "done" and out.usage == {"total": 6, "d": {"a": 5}} and len(out.views) == 4
    assert any("cannot be used" in x["content"] for x in m.seen[1][0] if x["role"] == "tool")


def test_last_turn_may_not_call():
    call = chat.Call("1", "search", {"query": "x"})
    m = Scripted(*(chat.Reply("", (call,)) for _ in range(3)))
    explore(m, "q", "o", Toolbox(lambda q: "", lambda a, b: ""), max_steps=2)
    assert [o["tool_choice"] for _, o in m.seen] == ["auto", "auto", "none"]


def test_calls_end_when_views_run_out():
    look = chat.Call("1", "look", {"times": [1, 2, 3]})
    zoom = chat.Call("2", "zoom", {"time": 2, "box": [0.5, 0.5, 0.25, 0.25]})
    bad = chat.Call("3", "zoom", {"time": 2, "box": [0.5, 0.5, 0, 0]})
    boxes = []
    tools = Toolbox(lambda q: "", lambda a, b: "", lambda ts: {f"view {t}": "data:" for t in ts}, lambda t, box: boxes.append((t, box)) or {"part": "data:"})
    m = Scripted(chat.Reply("", (look, zoom, bad)), chat.Reply("seen", (look,)))
    out = explore(m, "q", "o", tools, max_views=4)
    assert out.text == "seen" and out.views == ["view 1.0", "view 2.0", "view 3.0", "part"] and boxes == [(2.0, (0.5, 0.5, 0.25, 0.25))]
    assert [o["tool_choice"] for _, o in m.seen] == ["auto", "none"] and "empty box" in m.seen[1][0][-2]["content"]
    assert [t["function"]["name"] for t in m.seen[0][1]["tools"]] == ["search", "read", "look", "zoom"]


def test_an_answer_that_was_never_reached_is_an_error(monkeypatch):
    m = chat.openai("k", "m", "http://x.test")
    monkeypatch.setattr(m, "_post", lambda body: {"choices": [{"finish_reason": "length", "message": {"content": ""}}]})
    with pytest.raises(chat.ModelError, match="used up"):
        m.complete([], max_tokens=5)


def test_connections_are_tried_again(monkeypatch):
    import urllib.error

    tried = []

    def fail(*_, **__):
        tried.append(1)
        raise urllib.error.URLError("refused")

    monkeypatch.setattr(chat.urllib.request, "urlopen", fail)
    monkeypatch.setattr(chat.time, "sleep", lambda _: None)
    with pytest.raises(chat.ModelError, match="refused"):
        chat.openai("k", "m", "http://x.test").complete([], max_tokens=5)
    assert len(tried) == chat.RETRIES + 1


def test_arguments_that_are_no_object():
    assert chat.parse_arguments("[1]") == {} == chat.parse_arguments("{") and chat.parse_arguments('{"a": 1}') == {"a": 1}


def test_azure_forms():
    assert chat.azure("https://x.test/openai/v1", "k", "d").model == "d"
    m = chat.azure("https://x.test/", "k", "d")
    assert m.model is None and m.url.startswith("https://x.test/openai/deployments/d/chat/completions?api-version=")


def test_whole_transcript_if_it_fits():
    assert choose_evidence("h", "short", lambda: "r", 100) == "h\n\nshort" and choose_evidence("h", "long " * 500, lambda: "r", 100) == "r"


def test_front_and_command_line(spark, tmp_path, capsys):
    t = Timelines(spark, str(tmp_path / "store"))
    with pytest.raises(NotIndexed):
        t.transcript()
    seg = [(1, i, 5.0 * i, 5.0 * i + 4, f"Sentence {i} about {'deployment' if i == 3 else 'nothing'}.") for i in range(10)]
    spark.createDataFrame(seg, "video_id long, idx long, start_s double, end_s double, text string").write.parquet(str(tmp_path / "seg"))
    run = lambda *a: cli.main([str(tmp_path / "store"), *a], spark)
    assert run("index", str(tmp_path / "seg")) == 0
    assert t.search("deployment").first()["segment_ids"] == ["seg_00003"]
    assert "deployment" in t.context("deployment").first()["text"] and t.info().first()["segments"] == 10
    assert run("search", "deployment", "--start", "0:10") == 0 and "seg_00003" in capsys.readouterr().out
    assert run("transcript", "--format", "srt") == 0 and "-->" in capsys.readouterr().out
    assert run("search", "x", "--start", "1:x") == 2 and run("frames") == 1 and run("search", "x", "--limit", "0") == 1
    m = Scripted(chat.Reply("yes"))
    assert t.ask(1, "deployment?", m).text == "yes" and "Sentence 3" in m.seen[0][0][1]["content"]
    call = chat.Call("1", "search", {"query": "deployment"})
    m = Scripted(chat.Reply("", (call,)), chat.Reply("ok"))
    assert t.explore(1, "q", m).text == "ok" and "deployment" in m.seen[1][0][-1]["content"]
