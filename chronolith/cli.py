"""K8: python -m chronolith.cli FOLDER COMMAND ...  Exit codes: 0, 1 for a failure, 2 for wrong use, 130 when interrupted."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from .plans.context import ContextOptions
from .plans.ingest import PROFILES, IngestConfig
from .sources import chat
from .streaming.sinks import Locked
from .timeline import NotIndexed, Timelines


def seconds(text: str) -> float:
    """P12 for one argument."""
    parts = text.split(":")
    try:
        values = [float(p) for p in parts]
    except ValueError:
        values = [-1.0]
    if not 1 <= len(parts) <= 3 or min(values) < 0:
        raise argparse.ArgumentTypeError(f"{text} is no time; write 90, 1:30 or 01:01:30.5")
    total = 0.0
    for v in values:
        total = total * 60 + v
    return total


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronolith", description="Ask timelines.")
    p.add_argument("folder")
    p.add_argument("--json", action="store_true")
    commands = p.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="store segments from a Parquet table")
    index.add_argument("segments")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=5)
    search.add_argument("--expand", type=float, default=0.0)
    for name in ("--start", "--end"):
        search.add_argument(name, type=seconds)
    context = commands.add_parser("context")
    context.add_argument("query")
    context.add_argument("--max-tokens", type=int, default=4000)
    transcript = commands.add_parser("transcript")
    transcript.add_argument("--format", choices=["srt", "vtt", "md", "txt", "json"], default="txt")
    hear = commands.add_parser("transcribe", help="hear the sound files of a folder, as far as this was not done, and index them")
    hear.add_argument("sounds")
    hear.add_argument("--recogniser", required=True, help="module:name of what makes one; its name is part of the run's key")
    hear.add_argument("--pattern", default="*.wav")
    hear.add_argument("--language")
    hear.add_argument("--profile", choices=sorted(PROFILES), default="balanced")
    hear.add_argument("--detect-language", action="store_true")
    ask = commands.add_parser("ask", help="ask a chat model about one timeline")
    ask.add_argument("video", type=int)
    ask.add_argument("question")
    ask.add_argument("--base-url", required=True, help="of an endpoint of the chat-completions form")
    ask.add_argument("--llm-model", required=True)
    ask.add_argument("--key-variable", default="OPENAI_API_KEY", help="environment variable that holds the key, if one is needed")
    ask.add_argument("--explore", action="store_true", help="let the model search and read by itself")
    commands.add_parser("models", help="list the settings that profiles ask of a recogniser")
    for name in ("frames", "info"):
        commands.add_parser(name)
    return p


def show(rows: DataFrame, as_json: bool) -> None:
    for r in rows.toLocalIterator():
        print(json.dumps(r.asDict(True), ensure_ascii=False, default=str) if as_json else "  ".join(str(x) for x in r))


def plug_in(name: str):
    """What `module:name` names."""
    module, _, own = name.partition(":")
    try:
        return getattr(importlib.import_module(module), own)
    except (ImportError, AttributeError, ValueError) as e:
        raise ValueError(f"{name} names no recogniser: {e}") from e


def hear(t: Timelines, a: argparse.Namespace) -> None:
    config = IngestConfig(a.recogniser, a.language, a.profile, detect_language=a.detect_language)
    t.index(t.ingest(a.sounds, plug_in(a.recogniser), config, a.pattern))
    show(t.info().orderBy("video_id"), a.json)


def answer(t: Timelines, a: argparse.Namespace) -> None:
    model = chat.openai(os.environ.get(a.key_variable, ""), a.llm_model, a.base_url)
    got = (t.explore if a.explore else t.ask)(a.video, a.question, model)
    print(json.dumps({"text": got.text, "steps": got.steps, "usage": got.usage}, ensure_ascii=False) if a.json else got.text)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    if a.command == "models":
        for name, settings in PROFILES.items():
            print(json.dumps({"profile": name, **settings}) if a.json else f"{name}  {settings['model']}")
        return 0
    try:
        t = Timelines(spark or SparkSession.builder.getOrCreate(), a.folder)
        if a.command == "index":
            t.index(t.spark.read.parquet(a.segments))
        elif a.command == "search":
            show(t.search(a.query, limit=a.limit, expand=a.expand, start=a.start, end=a.end).orderBy("video_id", "rank"), a.json)
        elif a.command == "context":
            show(t.context(a.query, ContextOptions(max_tokens=a.max_tokens)).orderBy("video_id"), a.json)
        elif a.command == "transcribe":
            hear(t, a)
        elif a.command == "ask":
            answer(t, a)
        elif a.command == "transcript":
            show(t.export(a.format).orderBy("video_id"), a.json)
        else:
            show(t.frames() if a.command == "frames" else t.info(), a.json)
    except KeyboardInterrupt:
        return 130
    except (NotIndexed, Locked, FileNotFoundError, chat.ModelError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
