"""Language models behind one interface: recorded answers, a recorder, an HTTP service, a command; and prompts of a DataFrame."""

from __future__ import annotations

import hashlib
import json
import subprocess
import time
import urllib.request
from collections.abc import Callable
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame


class Answer(NamedTuple):
    text: str
    provider: str
    model: str | None = None
    prompt_tokens: int | None = None
    completion_tokens: int | None = None
    latency_ms: int | None = None
    provenance: str = "live"  # or replay: it came from a recording


class Provider(Protocol):
    name: str

    def complete(self, prompt: str, system: str | None = None, model: str | None = None, max_tokens: int = 1024) -> Answer: ...


def prompt_key(prompt: str, system: str | None, model: str | None) -> str:
    return hashlib.sha256(json.dumps([prompt, system, model]).encode()).hexdigest()


class Recorded:
    """Answers of a recording, by prompt, system text and model; a prompt that it lacks is an error, never a guess."""

    name = "recorded"

    def __init__(self, answers: dict[str, dict]):
        self.answers = answers

    def complete(self, prompt, system=None, model=None, max_tokens=1024) -> Answer:
        found = self.answers.get(prompt_key(prompt, system, model))
        if found is None:
            raise LookupError("the recording has no answer to this prompt")
        return Answer(**{**found, "provenance": "replay"})


class Recorder:
    """Another provider, whose answers are kept for a recording."""

    def __init__(self, inner: Provider):
        self.inner, self.name, self.answers = inner, inner.name, {}

    def complete(self, prompt, system=None, model=None, max_tokens=1024) -> Answer:
        a = self.inner.complete(prompt, system, model, max_tokens)
        self.answers[prompt_key(prompt, system, model)] = a._asdict()
        return a


def _post(url: str, body: dict, headers: dict, timeout: float = 120) -> dict:
    r = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(r, timeout=timeout) as f:
        return json.load(f)


class Http:
    """A chat-completions service; ``post`` (url, body, headers) can be another client."""

    name = "http"

    def __init__(self, base: str, model: str, key: str = "", post: Callable[[str, dict, dict], dict] = _post):
        self.base, self.model, self.key, self.post = base.rstrip("/"), model, key, post

    def complete(self, prompt, system=None, model=None, max_tokens=1024) -> Answer:
        messages = [{"role": r, "content": t} for r, t in (("system", system), ("user", prompt)) if t]
        began = time.monotonic()
        out = self.post(f"{self.base}/chat/completions", {"model": model or self.model, "messages": messages, "max_tokens": max_tokens}, {"Authorization": f"Bearer {self.key}"} if self.key else {})
        use = out.get("usage") or {}
        return Answer(out["choices"][0]["message"]["content"] or "", self.name, out.get("model") or model or self.model, use.get("prompt_tokens"), use.get("completion_tokens"), int(1000 * (time.monotonic() - began)))


class Command:
    """A program that takes the prompt as its last argument, without a shell, and answers on its output."""

    name = "command"

    def __init__(self, argv: list[str], timeout: float = 300):
        self.argv, self.timeout = list(argv), timeout

    def complete(self, prompt, system=None, model=None, max_tokens=1024) -> Answer:
        began = time.monotonic()
        text = f"{system}\n\n{prompt}" if system else prompt
        out = subprocess.run([*self.argv, text], check=True, capture_output=True, text=True, timeout=self.timeout)
        return Answer(out.stdout.strip(), self.name, model, latency_ms=int(1000 * (time.monotonic() - began)))


PROVIDERS: dict[str, Callable[..., Provider]] = {"recorded": Recorded, "http": Http, "command": Command}


def provider(name: str, *args, **how) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](*args, **how)


ANSWER = "text string, provider string, model string, prompt_tokens int, completion_tokens int, latency_ms int, provenance string, error string"


def complete_all(prompts: DataFrame, make: Callable[[], Provider]) -> DataFrame:
    """``prompts`` (id string, prompt) with an answer or an error each. A worker makes its own provider; a failed prompt fails alone."""

    def rows(batches):
        import pandas as pd

        p = make()
        for b in batches:
            out = []
            for i, text in zip(b["id"], b["prompt"]):
                try:
                    out.append((i, *p.complete(text or ""), None))
                except Exception as e:
                    out.append((i, *[None] * len(Answer._fields), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["id", *Answer._fields, "error"]).astype(object)

    return prompts.selectExpr("CAST(id AS string) AS id", "prompt").mapInPandas(rows, "id string, " + ANSWER)
