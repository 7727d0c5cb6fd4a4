"""Relative paths as Columns: one canonical form, or the reason why there is none."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "py": "python", "go": "go", "rs": "rust"}  # fixed values


def composed(text: Column) -> Column:
    """Unicode form C; plain ASCII does not leave the JVM's hands changed."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))

    return form(text)


def folded(slashed: Column) -> Column:
    """Segments of a path without empty ones and dots; a ``..`` takes the segment before it, and stays where there is none."""
    up = F.lit("..")
    step = lambda a, x: F.when(x.isin("", "."), a).when((x == up) & (F.size(a) > 0) & (F.element_at(F.concat(F.array(up), a), -1) != up), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(F.split(slashed, "/", -1), F.array().cast("array<string>"), step)


def canonical(path: Column) -> Column:
    """struct<path,reason>: reason is null, empty, control-character, absolute or escapes-root."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = folded(composed(slashed))
    reason = (
        F.when(path.isNull() | (path == ""), "empty").when(path.rlike("[\\x00-\\x1f\\x7f]"), "control-character")
        .when(slashed.rlike("^(/|[a-zA-Z]:)"), "absolute").when((F.size(parts) == 0) | (F.get(parts, F.lit(0)) == ".."), "escapes-root")
    )
    tail = F.when(slashed.endswith("/"), "/").otherwise("")
    return F.struct(F.when(reason.isNull(), F.concat(F.array_join(parts, "/"), tail)).alias("path"), reason.alias("reason"))


def link_target(folder: Column, target: Column) -> Column:
    """struct<path,reason> of a link in a note of ``folder``: without its fragment, decoded once; what would decode twice is ``encoded``."""
    bare = F.split(target, "#", 2)[0]
    once = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    twice = F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B")))
    whole = F.when(folder == "", once).otherwise(F.concat(folder, F.lit("/"), once))
    own = canonical(whole)
    reason = F.when(target.isNull() | (bare == ""), "empty").when(once.isNull() | (twice != once), "encoded").when(once.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), "absolute").otherwise(own["reason"])
    return F.struct(F.when(reason.isNull(), own["path"]).alias("path"), reason.alias("reason"))


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(names, F.element_at(F.split(F.lower(path), r"\.", -1), -1))
