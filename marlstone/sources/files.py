"""Files as catalog rows: note vaults, folders with their faults, repositories and lists of JSON payloads."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import notes, paths
from marlstone.functions.markdown import first_heading
from marlstone.sources import rules
from marlstone.sources.store import collected


def vault(spark: SparkSession, path: str) -> DataFrame:
    """path, title, body of every ``*.md`` below ``path`` but those in settings and trash folders; the title is the first heading, else the name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    notes_ = files.where(~F.col("path").rlike(r"/\.(obsidian|trash)/")).select("path", F.decode("content", "UTF-8").alias("body"))
    stem = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    return notes_.select("path", F.coalesce(first_heading(F.col("body")), stem).alias("title"), "body")


def payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object or a list of them for each file, in a schema given."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def snapshot(spark: SparkSession, root: str, include: tuple = ("**/*.md",), exclude: tuple = ()) -> tuple[DataFrame, DataFrame, bool]:
    """Documents (id, path, title, tags, body) of a folder, its faults (path, reason), and whether the snapshot is complete.

    A file that is no text, no UTF-8 or has broken front matter is a fault and no document. Of files that share an id, or a
    path but for case, none is a document. Faults leave a snapshot incomplete: nothing may be retired by it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    rel = F.regexp_replace(F.col("path"), rf"^.*?\Q{base}\E/", "")
    f = files.select(rel.alias("path"), "content").where(rules.wanted(F.col("path"), include, exclude))
    f = f.select(paths.canonical(F.col("path")).alias("p"), F.col("path").alias("raw"), "content")
    f = f.withColumn("reason", F.when(F.col("p.reason").isNotNull(), F.col("p.reason")).when(~rules.is_text(F.col("content")), "not-text").when(~F.is_valid_utf8(F.col("content").cast("string")), "not-utf8"))
    m = f.withColumn("m", notes.front_matter(F.when(F.col("reason").isNull(), F.col("content").cast("string"))))
    m = m.withColumn("reason", F.coalesce("reason", F.when(F.col("m.error").isNotNull(), "front-matter")))
    d = m.select(F.coalesce("p.path", "raw").alias("path"), "reason", F.coalesce("m.id", "p.path").alias("id"), "m.title", "m.tags", "m.body")
    ok = d.where("reason IS NULL")
    ids = ok.groupBy("id").agg(F.count(F.lit(1)).alias("same_id"))
    cases = ok.groupBy(F.lower("path").alias("folded")).agg(F.count(F.lit(1)).alias("same_path"))
    ok = ok.join(ids, "id").join(cases, F.lower("path") == F.col("folded"))
    ok = ok.withColumn("reason", F.when(F.col("same_id") > 1, "duplicate-id").when(F.col("same_path") > 1, "case-collision"))
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    docs = ok.where("reason IS NULL").select("id", "path", F.coalesce("title", first_heading(F.col("body")), stem).alias("title"), "tags", "body")
    faults = d.where("reason IS NOT NULL").select("path", "reason").unionByName(ok.where("reason IS NOT NULL").select("path", "reason"))
    return docs, faults, not collected(faults.limit(1))


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True).stdout


def knows(repo: str, revision: str) -> bool:
    """Whether a clone has a revision."""
    return subprocess.run(["git", "-C", repo, "cat-file", "-e", f"{revision}^{{commit}}"], capture_output=True).returncode == 0


def repository(spark: SparkSession, repo: str, since: str | None = None, include: tuple = (), exclude: tuple = ()) -> tuple[DataFrame, str]:
    """Changes of a local clone since a revision, and the head: path, status (A, M or D; a rename is a D and an A), committed.

    Without a revision, or with one that the clone does not know, all files are there as added. Nothing has changed if the
    revision is the head; the caller keeps the head as the next cursor once every change has landed.
    """
    head = _git(repo, "rev-parse", "HEAD").strip()
    if since and knows(repo, since):
        fields = _git(repo, "diff", "--name-status", "--no-renames", "-z", since, head).split("\0")
        changes = [(path, status[0]) for status, path in zip(fields[0::2], fields[1::2])]
    else:
        changes = [(path, "A") for path in _git(repo, "ls-files", "-z").split("\0") if path]
    times, when = {}, None
    for line in _git(repo, "log", "--format=%x01%cI", "--name-only", "--no-renames").splitlines():  # newest first: the first time seen is the last commit
        if line.startswith("\1"):
            when = line[1:]
        elif line:
            times.setdefault(line, when)
    rows = [(path, status, times.get(path)) for path, status in changes]
    df = spark.createDataFrame(rows, "path string, status string, committed string")
    return df.where(rules.wanted(F.col("path"), include, exclude)), head


def pages(get: Callable[[dict], dict], items: str, size: int = 50, most: int = 10_000, **params) -> Iterator[dict]:
    """Items of a paged REST listing, through ``get`` (the client that knows host and credentials), until a page is short."""
    start = 0
    for _ in range(most):
        page = get({**params, "start": start, "limit": size}).get(items) or []
        yield from page
        start += len(page)
        if len(page) < size:
            return


def incremental(get: Callable[[dict], dict], fetch: Callable[[str], dict], scope: rules.Scope, cursor: str | None, items: str = "results", key: str = "id", updated: str = "lastmodified") -> tuple[list[dict], bool]:
    """What changed in a scope since its cursor: keys of a stable listing in the order of their time, each fetched. The second says whether the listing was stable."""
    clauses = [c for c in (scope.predicate(), f'{updated} >= "{cursor}"' if cursor else None) if c]
    query = " and ".join(clauses) + (" " if clauses else "") + f"order by {updated} asc, {key} asc"
    keys, ok = rules.stable(lambda: [str(x[key]) for x in pages(get, items, query=query)])
    return [fetch(k) for k in keys], ok
