"""Attachments of documents: what a listing names, what of it may be fetched, and what is gone.

Links in a listing are not trusted: a download carries the credential of its source, so a link becomes a path below the
source's own address or is refused. What is refused is debt; it still counts as listed, so nothing stored is retired for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.paths import folded

# fixed values
NATIVE_ID = r"^[A-Za-z0-9._:~-]{1,128}\z"
REVISION = r"^[A-Za-z0-9._-]{1,64}\z"
CONTROL = r"[\x00-\x1f\x7f]"
MAX_MEDIA_TYPE, MAX_FILENAME = 128, 255
DEFAULT_MEDIA_TYPE = "application/octet-stream"


def safe_path(link: Column) -> Column:
    """A link as a rooted path with its query, or null: no scheme, no other host, no control characters, nothing encoded that climbs.

    Dot segments are folded as a browser folds them: those above the root are dropped.
    """
    bare = F.split(link, "#", 2)[0]
    path, query = F.split(bare, r"\?", 2)[0], F.regexp_extract(bare, r"(?s)(\?.*)$", 1)
    dots = F.regexp_replace(path, "(?i)%2e", ".")
    kept = F.filter(folded(F.when(dots.rlike(r"(^|/)\.\.?(/|$)"), dots).otherwise(path)), lambda x: x != "..")
    # a dot segment at the end names the folder
    out = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when((F.size(kept) > 0) & dots.rlike(r"/(\.\.?)?$"), "/").otherwise(""), query)
    bad = link.rlike(CONTROL) | ~link.startswith("/") | link.startswith("//") | link.contains("\\") | query.contains("..")
    return F.when(~bad & ~out.contains(".."), out)


def same_origin(url: Column, base: str) -> Column:
    """The part of an address below ``base`` (https://host/context), or null if it lies elsewhere. A link that is a path is one on the host."""
    origin, context = _split(base)
    rest = F.when(url.startswith("/") & ~url.startswith("//"), url).when(
        F.lower(F.substring(url, 1, len(origin))) == origin.lower(), F.substr(url, F.lit(len(origin) + 1)))
    path = safe_path(F.when(rest == "", "/").otherwise(rest))
    if not context:
        return path
    below = path.startswith(context + "/") | path.startswith(context + "?") | (path == context)
    inner = F.substr(path, F.lit(len(context) + 1))
    return F.when(below, F.when(inner.startswith("/"), inner).otherwise(F.concat(F.lit("/"), inner)))  # folded already


def _split(base: str) -> tuple[str, str]:
    scheme, _, rest = base.partition("://")
    host, _, path = rest.partition("/")
    if scheme not in ("http", "https") or not host:
        raise ValueError(f"no address of a source: {base}")
    return f"{scheme}://{host}", ("/" + path).rstrip("/")


def checked(text: Column, most: int) -> Column:
    """struct<value,valid>: trimmed text, null where there is none; not valid with control characters or beyond ``most``. Never cut."""
    value = F.regexp_replace(text, r"^\s+|\s+\z", "")
    ok = text.isNull() | (value == "") | (~value.rlike(CONTROL) & (F.char_length(value) <= most))
    return F.struct(F.when(ok & (value != ""), value).alias("value"), ok.alias("valid"))


def listing(entries: DataFrame, base: str) -> DataFrame:
    """Each entry (doc_id, native_id, revision, media_type, filename, link) as listed: the same columns read with care, a
    ``path`` to fetch, ``listed`` (it names itself) and ``fetchable``. What is listed or not even that, and not fetchable, is debt."""
    e = entries.withColumns({"m": checked(F.col("media_type"), MAX_MEDIA_TYPE), "f": checked(F.col("filename"), MAX_FILENAME), "path": same_origin(F.col("link"), base)})
    listed = F.coalesce(F.col("native_id").rlike(NATIVE_ID), F.lit(False))
    fetchable = listed & F.coalesce(F.col("revision").rlike(REVISION), F.lit(False)) & F.col("m.valid") & F.col("f.valid") & F.col("path").isNotNull()
    return e.select(
        "doc_id", F.when(listed, F.col("native_id")).alias("native_id"), "revision", F.coalesce("m.value", F.lit(DEFAULT_MEDIA_TYPE)).alias("media_type"),
        F.col("f.value").alias("filename"), F.when(fetchable, F.col("path")).alias("path"), listed.alias("listed"), fetchable.alias("fetchable"),
    )


def acquired(listed: DataFrame, fetch: Callable[[str], bytes | None], most: int = 32 << 20) -> DataFrame:
    """What can be fetched, with its bytes and digest: ``fetch`` (sent to the executors) gives a path's bytes, or null where the source
    refuses. Null or more than ``most`` bytes is debt: data and digest are null."""

    def rows(batches):
        for b in batches:
            b["data"] = [None if x is None or len(x) > most else x for x in map(fetch, b["path"])]
            yield b[["doc_id", "native_id", "revision", "media_type", "filename", "data"]]

    got = listed.where("fetchable").select("doc_id", "native_id", "revision", "media_type", "filename", "path")
    types = {f.name: f.dataType.simpleString() for f in got.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in ("doc_id", "native_id", "revision", "media_type", "filename")) + ", data binary"
    return got.mapInPandas(rows, schema).withColumn("digest", F.sha2("data", 256))


def gone(stored: DataFrame, listed: DataFrame, complete: DataFrame) -> DataFrame:
    """Stored revisions (doc_id, native_id, revision) to retire: of documents (doc_id) whose listing was seen whole, those whose id it names
    no more. All revisions of an id still named stay. A listing with an entry that names no id was not seen whole."""
    vague = listed.where(~F.col("listed")).select("doc_id").distinct()
    whole = complete.select("doc_id").distinct().join(vague, "doc_id", "left_anti")
    present = listed.where("listed").select("doc_id", "native_id").distinct()
    return stored.join(whole, "doc_id", "left_semi").join(present, ["doc_id", "native_id"], "left_anti").select("doc_id", "native_id", "revision")
