"""A repository kept in step with a catalog: what changed since the revision last taken, applied in order, or everything where that is not known."""

from __future__ import annotations

import json
from typing import NamedTuple

import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources import files, rules
from marlstone.sources.store import collected, written
from marlstone.sources.versions import Catalog


class Synced(NamedTuple):
    mode: str  # full, changes or none
    taken: int
    retired: int
    failed: list  # paths that could not be read
    cursor: str | None  # the revision from which the next sync goes on


def cursor_of(catalog: Catalog, name: str) -> str | None:
    path = f"{catalog.root}/cursors/{name}.json"
    if catalog.fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return None
    with catalog.fs.open_input_stream(path) as f:
        return json.loads(f.read())["revision"]


def _advance(catalog: Catalog, name: str, revision: str) -> None:
    catalog.fs.create_dir(f"{catalog.root}/cursors", recursive=True)
    staged = f"{catalog.root}/cursors/{name}.{revision}"
    with catalog.fs.open_output_stream(staged) as f:
        f.write(json.dumps({"revision": revision}).encode())
    catalog.fs.move(staged, f"{catalog.root}/cursors/{name}.json")


def working_tree(catalog: Catalog, repo: str, wanted: DataFrame) -> DataFrame:
    """path, content (null where there is none) of the files ``wanted`` (path), read by the executors."""
    found = catalog.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(repo)
    absolute = F.regexp_replace("path", "^file:/+", "/")
    found = found.select(F.substr(absolute, F.lit(len(repo.rstrip("/")) + 2)).alias("path"), "content")
    return wanted.join(found, "path", "left")


def sync(catalog: Catalog, repo: str, name: str, tenant: str, at: int, include: tuple = (), exclude: tuple = (), owner: str = "", acl_group: str = "", read=working_tree) -> Synced:
    """One step: deletions first, so that a path which was renamed away and made anew ends as it is now, then what is there.

    Where the last revision is not known, the whole tree is taken, and documents of the repository that it lacks are retired. Files that
    are no text, or too large, are no documents: one that became so is retired. The cursor moves only when every file that should be there
    was read, and after all else: a step that dies, or that a file fails, is taken again from the same revision, and what is there already
    passes the hash gate.
    """
    spark = catalog.spark
    cursor = cursor_of(catalog, name)
    changes, head = files.repository(spark, repo, cursor, include, exclude)
    if cursor == head:
        return Synced("none", 0, 0, [], head)
    known = cursor is not None and files.knows(repo, cursor)
    ident = F.concat(F.lit(f"code:{name}:"), F.col("path"))
    there = written(read(catalog, repo, changes.where("status <> 'D'").select("path")), "sync-files")
    text = there.where(F.col("content").isNotNull() & rules.is_text(F.col("content")))
    failed = [r["path"] for r in collected(there.where("content IS NULL").orderBy("path").select("path").limit(100))]
    live = catalog.read("documents").where((F.col("tenant") == tenant) & F.col("id").startswith(f"code:{name}:") & ~F.col("tombstoned")).select("tenant", "id")
    no_text = there.where(F.col("content").isNotNull()).select("path").join(text.select("path"), "path", "left_anti")
    if known:
        gone = changes.where("status = 'D'").select("path").unionByName(no_text).select(F.lit(tenant).alias("tenant"), ident.alias("id"))
        gone = written(live.join(gone, ["tenant", "id"], "left_semi"), "sync-gone")
    else:
        gone = written(live.join(there.select(ident.alias("id")).join(no_text.select(ident.alias("id")), "id", "left_anti"), "id", "left_anti"), "sync-gone")
    catalog.retire(gone, at)
    docs = text.select(F.lit(tenant).alias("tenant"), ident.alias("id"), F.col("path").alias("title"), F.col("content").cast("string").alias("body"), F.lit(owner).alias("owner"), F.lit(acl_group).alias("acl_group"))
    catalog.upsert(docs, at)
    n = collected(docs.agg(F.count(F.lit(1)).alias("n")))[0]["n"], collected(gone.agg(F.count(F.lit(1)).alias("n")))[0]["n"]
    if not failed:
        _advance(catalog, name, head)
    return Synced("changes" if known else "full", *n, failed, cursor if failed else head)
