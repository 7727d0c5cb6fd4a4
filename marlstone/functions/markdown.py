"""Markdown notes: sections in chunks, headings, golden query lists and typed queries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"(#{1,6})\s+(.*)")


def sections(title: str, body: str | None) -> Iterator[tuple[str, str, int, int]]:
    """(breadcrumb, text, first line, last line) of each section that has text; lines count from 1."""
    trail: list[tuple[int, str]] = []
    held: list[tuple[int, str]] = []

    def close():
        full = [n for n, x in held if x.strip()]
        if full:
            text = "\n".join(x for n, x in held if full[0] <= n <= full[-1]).strip()
            yield " > ".join([title, *(h for _, h in trail)]), text, full[0], full[-1]

    for n, x in enumerate((body or "").split("\n"), 1):
        m = HEADING.fullmatch(x)
        if m:
            yield from close()
            held = []
            trail = [h for h in trail if h[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
        else:
            held.append((n, x))
    yield from close()


def packed(text: str, most: int) -> Iterator[str]:
    """Paragraphs of ``text`` joined while they fit in ``most`` characters; a longer one is cut."""
    if len(text) <= most:
        yield text
        return
    now = ""
    for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n", text))):
        if now and len(now) + 2 + len(p) > most:
            yield now
            now = ""
        if len(p) > most:
            yield from (p[k : k + most] for k in range(0, len(p), most))
        else:
            now = f"{now}\n\n{p}" if now else p
    if now:
        yield now


def chunk_markdown(docs: DataFrame, most: int = 3200) -> DataFrame:
    """id, seq, heading_path, text, line_start, line_end for ``docs`` (id, title, body); null text gives no chunk."""

    def run(batches):
        for b in batches:
            rows = [
                (i, seq, *c)
                for i, title, body in zip(b["id"], b["title"], b["body"])
                for seq, c in enumerate((path, part, a, z) for path, text, a, z in sections(title or "", body) for part in packed(text, most))
            ]
            yield pd.DataFrame(rows, columns=["id", "seq", "heading_path", "text", "line_start", "line_end"])

    return docs.select("id", "title", "body").mapInPandas(run, "id string, seq int, heading_path string, text string, line_start int, line_end int")


def first_heading(body: Column) -> Column:
    """The first top heading that is not inside a fence; null if there is none."""
    open_text = F.regexp_replace(body, r"(?ms)^(```|~~~).*?(^\1[^\n]*$|\z)", "")
    return F.nullif(F.regexp_extract(open_text, r"(?m)^#[ \t]+(\S.*?)[ \t]*$", 1), F.lit(""))


def golden(line: Column) -> Column:
    """struct<query, ids> of a list item "- `query` → id, id — note"; null for other lines."""
    shape = r"^\s*-\s*`([^`]+)`\s*→\s*(.*?)(?:\s+—.*)?$"
    ids = F.filter(F.transform(F.split(F.regexp_extract(line, shape, 2), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(line.rlike(shape), F.struct(F.regexp_extract(line, shape, 1).alias("query"), ids.alias("ids")))


def truncated(snippet: Column, body: Column) -> Column:
    """Whether the snippet covers less than the body without what is no word at its edges."""
    return F.char_length(snippet) < F.char_length(F.regexp_replace(body, r"^\W+|\W+$", ""))


def parse_query(query: str) -> tuple[list[str], list[list[str]], list[str]]:
    """(terms, phrases, negated) of a web-style query: all terms, "quoted phrases", -excluded."""
    terms, phrases, negated = [], [], []
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        words = re.findall(r"\w+", (quoted or bare).lower())
        if minus:
            negated += words
        elif len(words) > 1 and quoted:
            phrases.append(words)
        else:
            terms += words
    return terms, phrases, negated


def zones(uncertainty: Column, complexity: Column) -> Column:
    """The actions that a node's scores admit."""
    top = F.greatest(uncertainty, complexity)
    broken = F.when(uncertainty >= 5, F.array(F.lit("decompose"), F.lit("clarify"))).otherwise(F.array(F.lit("decompose")))
    return F.when(top <= 2, F.array(F.lit("leaf"))).when(top < 5, F.array(F.lit("leaf"), F.lit("decompose"))).when(top >= 5, broken)
