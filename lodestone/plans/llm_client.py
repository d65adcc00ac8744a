"""Client of any endpoint for chat completions: on the driver for one question, in tasks for many (answers.py)."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from http.client import HTTPException
from urllib import error, request

from lodestone.plans.config import Settings


class LLMError(RuntimeError):
    """The endpoint cannot be reached, refuses, or answers in another form. ``again``: a later call may do better, after ``wait`` seconds."""

    def __init__(self, said: str, again: bool = False, wait: float = 0.0):
        super().__init__(said)
        self.again, self.wait = again, wait


class ChatClient:
    def __init__(self, s: Settings):
        self.s = s

    def _open(self, system: str, user: str, stream: bool):
        body = {"model": self.s.llm_model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": self.s.llm_temperature, "max_tokens": self.s.llm_max_tokens, "stream": stream}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.s.llm_api_key}"} if self.s.llm_api_key else {})
        try:
            return request.urlopen(request.Request(f"{self.s.llm_base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers), timeout=self.s.llm_timeout_seconds)
        except error.HTTPError as e:
            after = e.headers.get("Retry-After", "")
            raise LLMError(f"the endpoint answered {e.code}", e.code in (408, 429) or e.code >= 500, float(after) if after.isdecimal() else 0.0) from e
        except OSError as e:
            raise LLMError("the endpoint cannot be reached", True) from e

    def chat(self, system: str, user: str) -> str:
        with self._open(system, user, False) as r:
            try:
                return json.loads(r.read())["choices"][0]["message"]["content"] or ""
            except (OSError, HTTPException) as e:
                raise LLMError("the endpoint broke off", True) from e
            except (ValueError, KeyError, IndexError, TypeError) as e:
                raise LLMError("the endpoint's answer has another form") from e

    def stream(self, system: str, user: str) -> Iterator[str]:
        with self._open(system, user, True) as r:
            yield from deltas(line.decode("utf-8", "replace") for line in arriving(r))


def arriving(response: Iterable[bytes]) -> Iterator[bytes]:
    try:
        yield from response
    except (OSError, HTTPException) as e:
        raise LLMError("the endpoint broke off") from e


def deltas(lines: Iterable[str]) -> Iterator[str]:
    """Texts of a server-sent stream, up to [DONE]. A data line of another form is an error: the answer would have a hole."""
    for line in lines:
        if not line.startswith("data:"):
            continue
        body = line[5:].strip()
        if body == "[DONE]":
            return
        try:
            text = json.loads(body)["choices"][0].get("delta", {}).get("content")
        except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
            raise LLMError("a part of the endpoint's stream has another form") from e
        if text:
            yield text


def events(contexts: list[dict], parts: Iterator[str]) -> Iterator[str]:
    """Server-sent events of an answer: contexts, deltas, an error if the model fails midway, and the end."""

    def line(kind: str, value: object) -> str:
        return f"data: {json.dumps({'type': kind, kind: value}, ensure_ascii=False)}\n\n"

    yield line("contexts", contexts)
    try:
        for part in parts:
            yield line("delta", part)
    except LLMError:
        yield line("error", "the language model failed")
    yield "data: [DONE]\n\n"
