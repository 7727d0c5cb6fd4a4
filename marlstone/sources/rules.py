"""What decides which items of a source are read: globs, scopes, stable listings and retries."""

from __future__ import annotations

import email.utils
import hashlib
import http.client
import random
import re
import socket
import time
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES, SNIFF = 512 * 1024, 8192  # fixed values: larger files, and those with a NUL this near the start, are not text


def glob_regex(glob: str) -> str:
    """``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a name."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    return "^" + "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or re.escape(p) for p in parts) + r"\z"


def wanted(path: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Whether a path fits an include glob (any, if there are none) and no exclude glob."""
    any_of = lambda globs: "|".join(f"(?:{glob_regex(g)})" for g in globs)
    ok = path.rlike(any_of(include)) if list(include) else path.isNotNull()
    return ok & ~path.rlike(any_of(exclude)) if list(exclude) else ok


def is_text(content: Column) -> Column:
    return (F.octet_length(content) <= MAX_BYTES) & (F.instr(F.substring(content.cast("string"), 1, SNIFF), "\0") == 0)


class Scope(NamedTuple):
    kind: str  # all, space, project, pages, issues or query
    value: tuple = ()
    descendants: bool = False

    def cursor(self, source: str) -> str | None:
        """The name under which the scope's progress is kept; listed items keep none."""
        if self.kind in ("pages", "issues"):
            return None
        if self.kind == "all":
            return source
        what = hashlib.sha1(self.value[0].encode()).hexdigest()[:12] if self.kind == "query" else self.value[0]
        return f"{source}:{self.kind}:{what}"

    def predicate(self) -> str | None:
        if self.kind in ("space", "project"):
            return f'{self.kind} = "{self.value[0]}"'
        return f"({self.value[0]})" if self.kind == "query" else None


#: family -> kind, the form of its values, and whether all values are one scope
FAMILIES = {
    "space": ("space", r"[A-Za-z0-9_-]+", False),
    "project": ("project", r"[A-Za-z0-9_-]+", False),
    "page": ("pages", r"[0-9]+", True),
    "issue": ("issues", r"[A-Za-z][A-Za-z0-9]*-[0-9]+", True),
}


def scopes(families: tuple[str, ...], reconcile: bool = False, fixture: bool = False, descendants: bool = False, query: str | None = None, **given: str) -> list[Scope]:
    """The scopes that options ask for: one family at most, and a whole instance without any."""
    chosen = [f for f in families if given.get(f) is not None]
    n = len(chosen) + (query is not None)
    if set(given) - set(families):
        raise ValueError(f"unknown selector: {sorted(set(given) - set(families))}")
    if n > 1:
        raise ValueError(f"choose one of {', '.join(families)} and query")
    if descendants and "page" not in chosen:
        raise ValueError("descendants need a page")
    if n and (reconcile or fixture):
        raise ValueError("a fixture or reconciling takes no selector")
    if query is not None:
        return [Scope("query", (query,))]
    if not chosen:
        return [Scope("all")]
    kind, form, together = FAMILIES[chosen[0]]
    values = [v.strip() for v in given[chosen[0]].split(",") if v.strip()]
    if wrong := [v for v in values if not re.fullmatch(form, v)]:
        raise ValueError(f"invalid {chosen[0]}: {wrong[0]}")
    return [Scope(kind, tuple(values), descendants)] if together else [Scope(kind, (v,)) for v in values]


def stable(listing: Callable[[], list], most: int = 3) -> tuple[list, bool]:
    """Keys of a listing that two scans in a row gave alike and without repeats; else the last ones, and False."""
    last = None
    for _ in range(most):
        now = sorted(listing())
        if now == last and len(set(now)) == len(now):
            return now, True
        last = now
    return last or [], False


class HttpError(Exception):
    """A completed response that is no success, with the seconds that the server asks to wait, if it does."""

    def __init__(self, status: int, message: str = "", retry_after: float | None = None):
        super().__init__(f"HTTP {status} {message}".strip())
        self.status, self.retry_after = status, retry_after


# Statuses that another attempt may mend, beside those of the server's own faults.
TRANSIENT = (408, 425, 429)


def retryable(e: Exception) -> bool:
    """Whether asking again may help: transient statuses and faults of the transport; what is refused or not there stays so."""
    if isinstance(e, HttpError):
        return e.status in TRANSIENT or 500 <= e.status <= 599
    return isinstance(e, (TimeoutError, ConnectionError, socket.gaierror, http.client.IncompleteRead)) or isinstance(getattr(e, "reason", None), (OSError, TimeoutError))


def retry_after(value: str | None, now: Callable[[], float] = time.time) -> float | None:
    """Seconds of a Retry-After header, which is a number or a date; null if it is neither, or in the past."""
    if value is None:
        return None
    if re.fullmatch(r"\d+", value.strip()):
        return float(value)
    try:
        seconds = email.utils.parsedate_to_datetime(value).timestamp() - now()
    except (TypeError, ValueError):
        return None
    return seconds if seconds > 0 else None


def backoff(attempt: int, base: float = 1.0, cap: float = 60.0, after: float | None = None, rand: Callable[[], float] = random.random) -> float:
    """Seconds to wait before a retry: a random share of a doubling bound, or what the server asks for if that is longer."""
    jitter = rand() * min(cap, base * 2**attempt)
    return jitter if after is None else min(cap, max(after, jitter))


def retried(call: Callable, attempts: int = 5, again: Callable[[Exception], bool] = retryable, sleep: Callable[[float], None] = time.sleep, **how):
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if k + 1 == attempts or not again(e):
                raise
            sleep(backoff(k, after=getattr(e, "retry_after", None), **how))
