"""Headlines: the fragments of a text that say most about a query, with marked words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FRAGMENTS, MOST_WORDS, LEAST_WORDS, MARK, GAP = 2, 45, 30, "**", " … "  # fixed values
WORD = re.compile(r"\w+")


def fragments(terms: set, text: str) -> list[tuple[int, int]]:
    """Up to FRAGMENTS ranges of words, in text order: each the window of MOST_WORDS that starts at a hit and holds most terms
    not shown yet (then most hits, then the first), widened to LEAST_WORDS where it ends early; the text's start without a hit."""
    words = [m.group().lower() for m in WORD.finditer(text)]
    hits = [k for k, w in enumerate(words) if w in terms]
    if not hits:
        return [(0, min(len(words), LEAST_WORDS))] if words else []
    shown, out = set(), []
    while len(out) < FRAGMENTS:
        best = None
        for i, k in enumerate(hits):
            if any(a <= k < b for a, b in out):
                continue
            stop = min([k + MOST_WORDS, len(words), *(a for a, _ in out if a > k)])
            inside = [h for h in hits[i : i + MOST_WORDS] if h < stop]
            new = {words[h] for h in inside} - shown
            if best is None or (len(new), len(inside)) > best[0]:
                best = (len(new), len(inside)), k, inside[-1] + 1, new
        if best is None or (out and not best[3]):
            break
        a, b = best[1], best[2]
        low = max([0, *(y for _, y in out if y <= a)])
        high = min([len(words), *(x for x, _ in out if x >= b)])
        b = min(high, max(b, a + LEAST_WORDS))
        a = max(low, min(a, b - LEAST_WORDS))
        out.append((a, b))
        shown |= best[3]
    return sorted(out)


def headline_of(terms: list, text: str | None) -> tuple[str, bool]:
    """The headline, and whether it covers less than the text."""
    text = text or ""
    spans = [m.span() for m in WORD.finditer(text)]
    wanted = {t.lower() for t in terms or []}
    said, plain = [], 0
    for a, b in fragments(wanted, text):
        lo, hi = spans[a][0], spans[b - 1][1]
        plain += hi - lo
        said.append(WORD.sub(lambda m: f"{MARK}{m.group()}{MARK}" if m.group().lower() in wanted else m.group(), text[lo:hi]))
    whole = spans[-1][1] - spans[0][0] if spans else 0
    return GAP.join(said), plain < whole


def headline(terms: Column, text: Column) -> Column:
    """struct<snippet,truncated>; to be asked for after the cut to the rows that are shown."""

    @F.pandas_udf("struct<snippet:string,truncated:boolean>")
    def run(t: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([headline_of(list(a) if a is not None else [], b) for a, b in zip(t, s)], columns=["snippet", "truncated"])

    return run(terms, text)
