"""Front matter of notes: a bounded subset of YAML with four known keys."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES, MOST_KEYS, MOST_ITEMS = 16 * 1024, 64, 64  # fixed values
SCALARS, LISTS = ("id", "title"), ("tags", "aliases")
MATTER = "struct<body:string,id:string,title:string,tags:array<string>,aliases:array<string>,error:string>"


def bare(value: str) -> str:
    v = value.strip()
    return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v


def parse(raw: str | None) -> dict:
    """The body and its front matter. With an error, the body is the whole text and nothing is known of it."""
    plain = {"body": raw, "id": None, "title": None, "tags": [], "aliases": [], "error": None}
    opened = re.match(r"---\r?\n", raw or "")
    if not opened:
        return plain
    closed = re.compile(r"^---\s*$", re.M).search(raw, opened.end())
    if not closed:
        return plain | {"error": "not terminated"}
    region = raw[opened.end() : closed.start()]
    if len(region.encode()) > MOST_BYTES:
        return plain | {"error": "too long"}
    out = dict(plain, tags=[], aliases=[], body=raw[closed.start() :].partition("\n")[2])
    keys, filling = 0, None
    for line in region.splitlines():
        text = line.strip()
        if not text or text[0] == "#":
            continue
        if item := re.match(r"\s*-\s+(.*)$", line):
            if filling is not None and (v := bare(item[1])):
                if len(filling) == MOST_ITEMS:
                    return plain | {"error": "list too long"}
                filling.append(v)
            continue
        pair = re.match(r"([A-Za-z_][\w-]*)\s*:\s*(.*)$", line, re.A)
        if not pair:
            return plain | {"error": "unsupported syntax"}
        keys += 1
        if keys > MOST_KEYS:
            return plain | {"error": "too many keys"}
        key, value = pair[1], pair[2].strip()
        filling = None
        if key in LISTS:
            if value[:1] == "[" and value[-1:] == "]":
                out[key] = [v for v in map(bare, value[1:-1].split(",")) if v]
            elif value:
                out[key] = [bare(value)]
            else:
                filling = out[key]
        elif key in SCALARS and value:
            out[key] = bare(value)
    return out


def front_matter(text: Column) -> Column:
    @F.pandas_udf(MATTER)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(x) for x in s], columns=["body", "id", "title", "tags", "aliases", "error"])

    return run(text)
