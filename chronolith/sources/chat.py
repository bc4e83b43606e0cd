"""Chat models over HTTP.  Called by the driver only."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from typing import Any, Protocol

RETRIES, LONGEST_WAIT = 2, 30.0


class ModelError(RuntimeError):
    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class Call:
    id: str
    name: str
    arguments: dict[str, Any]


@dataclass(frozen=True)
class Reply:
    text: str
    calls: tuple[Call, ...] = ()
    usage: dict[str, Any] = field(default_factory=dict)


class Model(Protocol):
    supports_images: bool

    def complete(self, messages: list[dict], *, max_tokens: int, tools: list[dict] | None = None, tool_choice: str | None = None) -> Reply: ...


def parse_arguments(raw: str | None) -> dict[str, Any]:
    """Arguments that are not a JSON object count as none."""
    try:
        value = json.loads(raw or "{}")
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def add_usage(a: dict[str, Any], b: dict[str, Any]) -> dict[str, Any]:
    """A10: sums whole numbers of nested usage records; other values are left out."""
    out = dict(a)
    for k, v in b.items():
        if isinstance(v, dict):
            out[k] = add_usage(out.get(k) if isinstance(out.get(k), dict) else {}, v)
        elif isinstance(v, int) and not isinstance(v, bool):
            out[k] = (out.get(k) or 0) + v
    return out


@dataclass
class ChatModel:
    """An endpoint of the common chat-completions form."""

    url: str
    model: str | None
    headers: dict[str, str] = field(default_factory=dict)
    supports_images: bool = True
    timeout: float = 120.0
    limit_name: str = "max_completion_tokens"

    def _post(self, body: dict) -> dict:
        for attempt in range(RETRIES + 1):
            request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                text = e.read().decode("utf-8", "replace")
                if attempt == RETRIES or e.code != 429 and e.code < 500:
                    raise ModelError(text[:500], e.code) from e
                wait = e.headers.get("Retry-After")
                time.sleep(min(LONGEST_WAIT, float(wait) if wait and wait.replace(".", "", 1).isdigit() else 2.0**attempt))
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                if attempt == RETRIES:
                    raise ModelError(str(getattr(e, "reason", e))) from e
                time.sleep(2.0**attempt)
        raise AssertionError

    def complete(self, messages: list[dict], *, max_tokens: int, tools: list[dict] | None = None, tool_choice: str | None = None) -> Reply:
        body: dict[str, Any] = {"messages": messages, self.limit_name: max_tokens}
        if self.model:
            body["model"] = self.model
        if tools:
            body |= {"tools": tools, "tool_choice": tool_choice or "auto"}
        try:
            got = self._post(body)
        except ModelError as e:
            # Older servers know the other name only.
            if e.status != 400 or self.limit_name != "max_completion_tokens" or "max_completion_tokens" not in str(e):
                raise
            self.limit_name = "max_tokens"
            body["max_tokens"] = body.pop("max_completion_tokens")
            got = self._post(body)
        choice = got["choices"][0]
        message = choice["message"]
        if choice.get("finish_reason") == "length" and not message.get("content") and not message.get("tool_calls"):
            raise ModelError(f"the model used up its {max_tokens} tokens before it answered")
        calls = tuple(Call(c["id"], c["function"]["name"], parse_arguments(c["function"].get("arguments"))) for c in message.get("tool_calls") or ())
        return Reply(message.get("content") or "", calls, got.get("usage") or {})


def openai(api_key: str, model: str, base_url: str = "https://api.openai.com/v1") -> ChatModel:
    return ChatModel(f"{base_url.rstrip('/')}/chat/completions", model, {"Authorization": f"Bearer {api_key}"})


def azure(endpoint: str, api_key: str, deployment: str, api_version: str = "2024-10-21") -> ChatModel:
    """A resource endpoint names the deployment in its path; one that ends in /v1 takes it in the body."""
    base = endpoint.rstrip("/")
    if base.endswith("/v1"):
        return ChatModel(f"{base}/chat/completions", deployment, {"api-key": api_key})
    return ChatModel(f"{base}/openai/deployments/{deployment}/chat/completions?api-version={api_version}", None, {"api-key": api_key})


def ollama(model: str, base_url: str = "http://localhost:11434/v1") -> ChatModel:
    return ChatModel(f"{base_url.rstrip('/')}/chat/completions", model, supports_images=False, limit_name="max_tokens")
