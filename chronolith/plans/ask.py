"""Answers from evidence.  Rows come from the search and context plans; the dialogue runs on the driver."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..sources.chat import Call, Model, add_usage
from .context import count_tokens

# What one tool call may show.
RESULT_CHARS, FRAMES_A_CALL = 12_000, 4
RULES = "Answer from the evidence only. Cite the time and the id of what you use. Say so if the evidence does not answer the question."



def _tool(name: str, description: str, **arguments: dict) -> dict:
    return {"type": "function", "function": {"name": name, "description": description, "parameters": {"type": "object", "properties": arguments, "required": list(arguments)}}}


NUMBER = {"type": "number"}
TOOLS = [
    _tool("search", "Search the transcript.", query={"type": "string"}),
    _tool("read", "Read the transcript between two times in seconds.", start=NUMBER, end=NUMBER),
    _tool("look", "See the frames at up to four times in seconds.", times={"type": "array", "items": NUMBER}),
    _tool("zoom", "See a part of the frame at a time in seconds, larger; the box is left, top, width and height in fractions of the picture.", time=NUMBER, box={"type": "array", "items": NUMBER}),
]


@dataclass
class Answer:
    text: str
    usage: dict[str, Any] = field(default_factory=dict)
    steps: int = 0
    views: list[str] = field(default_factory=list)

    def tokens(self, *names: str) -> int | None:
        """The first of several names under which a count may be."""
        return next((self.usage[n] for n in names if isinstance(self.usage.get(n), int)), None)


def choose_evidence(header: str, full: str, retrieved: Callable[[], str], budget: int, count: Callable[[str], int] = count_tokens) -> str:
    """The whole transcript if it fits, else what was retrieved."""
    return f"{header}\n\n{full}" if count(f"{header}\n\n{full}") <= budget else retrieved()


def ask(model: Model, question: str, evidence: str, images: list[str] | None = None, max_tokens: int = 1024) -> Answer:
    """One question, one answer.  images: data URLs."""
    content: Any = f"{evidence}\n\nQuestion: {question}"
    if images and model.supports_images:
        content = [{"type": "text", "text": content}, *({"type": "image_url", "image_url": {"url": u}} for u in images)]
    reply = model.complete([{"role": "system", "content": RULES}, {"role": "user", "content": content}], max_tokens=max_tokens)
    return Answer(reply.text, reply.usage, 1, list(images or []))


@dataclass
class Toolbox:
    """What the model may call: search(query) and read(start, end) give text, look(times) and zoom(time, box) data URLs by name."""

    search: Callable[[str], str]
    read: Callable[[float, float], str]
    look: Callable[[list[float]], dict[str, str]] | None = None
    zoom: Callable[[float, tuple[float, float, float, float]], dict[str, str]] | None = None
    duration: float | None = None

    def offered(self, pictures: bool) -> list[dict]:
        own = {"search", "read"} | ({"look"} if self.look and pictures else set()) | ({"zoom"} if self.zoom and pictures else set())
        return [t for t in TOOLS if t["function"]["name"] in own]

    def _time(self, value: Any) -> float:
        return min(max(0.0, float(value)), float("inf") if self.duration is None else max(0.0, self.duration - 0.05))

    def run(self, call: Call, views_left: int) -> tuple[str, dict[str, str]]:
        tool = getattr(self, f"_{call.name}", None)
        if tool is None:
            return f"There is no tool {call.name}.", {}
        try:
            return tool(call.arguments, views_left)
        except (KeyError, TypeError, ValueError) as e:
            return f"These arguments cannot be used: {e}", {}

    def _search(self, a: dict, _: int) -> tuple[str, dict[str, str]]:
        return self.search(str(a["query"]))[:RESULT_CHARS], {}

    def _read(self, a: dict, _: int) -> tuple[str, dict[str, str]]:
        return self.read(float(a["start"]), float(a["end"]))[:RESULT_CHARS], {}

    def _look(self, a: dict, views_left: int) -> tuple[str, dict[str, str]]:
        times = [self._time(t) for t in a["times"]][: min(FRAMES_A_CALL, views_left)]
        return self._seen(self.look(times) if self.look and times else {})

    def _zoom(self, a: dict, views_left: int) -> tuple[str, dict[str, str]]:
        left, top, width, height = (min(1.0, max(0.0, float(x))) for x in a["box"])
        if not width or not height:
            raise ValueError("an empty box")
        return self._seen(self.zoom(self._time(a["time"]), (left, top, width, height)) if self.zoom and views_left > 0 else {})

    @staticmethod
    def _seen(views: dict[str, str]) -> tuple[str, dict[str, str]]:
        return f"Shown next: {', '.join(views)}" if views else "No views are left.", views


class Dialogue:
    """The messages between a model and a toolbox, turn by turn."""

    def __init__(self, model: Model, tools: Toolbox, opening: str, max_tokens: int) -> None:
        self.model, self.tools, self.max_tokens = model, tools, max_tokens
        self.messages: list[dict] = [{"role": "system", "content": RULES}, {"role": "user", "content": opening}]
        self.answer = Answer("")

    def turn(self, may_call: bool) -> tuple[Call, ...]:
        """One reply; gives the calls in it."""
        offered = self.tools.offered(self.model.supports_images)
        reply = self.model.complete(self.messages, max_tokens=self.max_tokens, tools=offered, tool_choice="auto" if may_call else "none")
        done = self.answer
        self.answer = Answer(reply.text, add_usage(done.usage, reply.usage), done.steps + 1, done.views)
        calls = reply.calls if may_call else ()
        if calls:
            told = [{"id": c.id, "type": "function", "function": {"name": c.name, "arguments": json.dumps(c.arguments)}} for c in calls]
            self.messages.append({"role": "assistant", "content": reply.text or None, "tool_calls": told})
        return calls

    def results(self, calls: tuple[Call, ...], max_views: int) -> None:
        """What the calls give: a text for each, then all pictures in one message."""
        pictures: dict[str, str] = {}
        for call in calls:
            text, views = self.tools.run(call, max_views - len(self.answer.views) - len(pictures))
            pictures |= views
            self.messages.append({"role": "tool", "tool_call_id": call.id, "content": text})
        if pictures and self.model.supports_images:
            self.messages.append({"role": "user", "content": [{"type": "image_url", "image_url": {"url": u}} for u in pictures.values()]})
        self.answer.views = [*self.answer.views, *pictures]


def explore(model: Model, question: str, opening: str, tools: Toolbox, max_steps: int = 6, max_views: int = 8, max_tokens: int = 1024) -> Answer:
    """The model calls tools until it answers; once its steps or its views have run out it has to."""
    talk = Dialogue(model, tools, f"{opening}\n\nQuestion: {question}", max_tokens)
    while calls := talk.turn(talk.answer.steps < max_steps and len(talk.answer.views) < max_views):
        talk.results(calls, max_views)
    return talk.answer
