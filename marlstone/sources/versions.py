"""A catalog of several tables that changes in one step: documents, chunks, links and revisions under a manifest.

Rows of a table are dealt to buckets by tenant and document. A version is a manifest, which names the folder of every bucket of every table;
a commit writes the buckets that change to new folders and then the manifest, under a number that only one writer can take.
Readers go by the last manifest, so none sees a document without its chunks. Folders that no kept manifest names
go with ``vacuum``. A commit reads and writes the buckets of its batch alone: give a large catalog many buckets, and batch what changes.
The texts of a batch are exchanged once; those that stand already are not, as long as the keys of the batch go to every task (``KEYS``).

``upsert`` is gated by the content's hash: a document that did not change keeps its revision and everything else but its access and
the time it was seen. Of one that did, chunks with the same text keep their vectors, links are replaced, a revision is
added; the owner who came first stays.

Defined cases: of rows of a batch that share tenant and id the one with the greatest hash counts; a null body is the empty text;
an empty batch commits nothing; tombstoned documents that come again live again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyarrow.fs
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.sources.blobs import opened
from marlstone.sources.store import collected, tidy

SHAPES = {
    "documents": "tenant string, id string, title string, body string, owner string, acl_group string, content_hash string, revision int, acl_version int, seen_at long, tombstoned boolean",
    "chunks": "tenant string, id string, seq int, text string, text_hash string, vector array<float>",
    "links": "tenant string, src_id string, dst_id string",
    "revisions": "tenant string, id string, revision int, content_hash string, seen_at long",
}
KEY = {"documents": "id", "chunks": "id", "links": "src_id", "revisions": "id"}
KEYS = 1 << 20  # keys of a batch that go to every task; beyond that, both sides meet by key
FANOUT = 64  # buckets up to which a task writes its rows of each; beyond that, rows meet by bucket
BATCH = "tenant string, id string, title string, body string, owner string, acl_group string"


class Conflict(Exception):
    """Another writer took the version: read again and retry."""


class Catalog:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.fs, self.root = opened(self.path)

    def versions(self) -> list[int]:
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.root}/manifests", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, buckets, and for each table bucket -> folder; that of the last version if none is given."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": self.buckets, "tables": {t: {} for t in SHAPES}}
        with self.fs.open_input_stream(f"{self.root}/manifests/{version or known[-1]}.json") as f:
            return json.loads(f.read())

    def read(self, table: str, manifest: dict | None = None, only: list | None = None) -> DataFrame:
        """A table as a manifest has it; of the buckets ``only``, if they are given."""
        folders = (manifest or self.manifest())["tables"][table]
        some = [folders[b] for b in folders if only is None or int(b) in only]
        return self.spark.read.schema(SHAPES[table]).parquet(*[f"{self.path}/{f}" for f in some]) if some else self.spark.createDataFrame([], SHAPES[table])

    def bucket(self, key: str, buckets: int):
        return F.pmod(F.xxhash64("tenant", key), F.lit(buckets)).cast("int")

    def put(self, table: str, df: DataFrame, buckets: int, folder: str | None = None, whole: bool = False) -> str:
        """Write ``df`` by bucket to a new folder of a table, or to ``folder`` beside what is there; the folder. ``whole``: a file for each bucket."""
        folder = folder or f"{table}/{uuid.uuid4().hex}"
        df = df.withColumn("bucket", self.bucket(KEY[table], buckets))
        df = df.repartition("bucket") if whole or buckets > FANOUT else df
        with tidy(self.spark):
            df.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, manifest: dict, tables: dict[str, DataFrame], only: list, begun: dict[str, str] | None = None, whole: bool = False) -> int:
        """Put ``tables`` in place of the buckets ``only`` of each; the new version. Raises ``Conflict`` if another commit came first.

        ``begun``: folders of tables that hold rows of this commit already."""
        now = {t: dict(f) for t, f in manifest["tables"].items()}
        folders = {**(begun or {})}
        for t, df in tables.items():
            folders[t] = self.put(t, df, manifest["buckets"], folders.get(t), whole)
        for t, folder in folders.items():
            found = self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.root}/{folder}"))
            written = {f.base_name[len("bucket=") :]: f"{folder}/{f.base_name}" for f in found if f.base_name.startswith("bucket=")}
            for b in only:
                now[t].pop(str(b), None)
            now[t] |= written
        return self._named(manifest["version"] + 1, {"version": manifest["version"] + 1, "buckets": manifest["buckets"], "tables": now})

    def _named(self, version: int, manifest: dict) -> int:
        """The manifest under its number: a rename that fails where the number is taken, so one writer gets it."""
        staged = f"{self.root}/staged/{uuid.uuid4().hex}.json"
        for folder in ("staged", "manifests"):
            self.fs.create_dir(f"{self.root}/{folder}", recursive=True)
        with self.fs.open_output_stream(staged) as f:
            f.write(json.dumps(manifest).encode())
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        at = lambda p: hadoop.Path(f"{self.path}{p.removeprefix(self.root)}")
        to = at(f"{self.root}/manifests/{version}.json")
        none = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(to.toUri(), sc._jsc.hadoopConfiguration()).rename(at(staged), to, none)
        except Py4JJavaError as e:
            self.fs.delete_file(staged)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} is taken") from None
            raise
        return version

    def upsert(self, batch: DataFrame, at: int, chunker: Callable | None = None) -> int:
        """Take in ``batch`` (tenant, id, title, body, owner, acl_group) as seen at ``at``; the version that holds it."""
        m = self.manifest()
        keys = ["tenant", "id"]
        only = [r["b"] for r in collected(batch.select(self.bucket("id", m["buckets"]).alias("b")).distinct())]
        if not only:
            return m["version"]
        new = batch.withColumn("body", F.coalesce("body", F.lit(""))).withColumn("new_hash", F.sha2(F.concat_ws("\n", F.coalesce("title", F.lit("")), "body"), 256))
        new = new.groupBy(*keys).agg(F.max(F.struct("new_hash", "title", "body", "owner", "acl_group")).alias("x")).select(*keys, "x.*")
        old = self.read("documents", m, only)
        j = new.alias("n").join(old.alias("o"), [F.col(f"n.{c}") == F.col(f"o.{c}") for c in keys], "left")
        fresh, same = F.col("o.id").isNull(), F.coalesce((F.col("o.content_hash") == F.col("n.new_hash")) & ~F.col("o.tombstoned"), F.lit(False))
        acl = F.when(fresh, 1).when(F.col("o.acl_group").eqNullSafe(F.col("n.acl_group")), F.col("o.acl_version")).otherwise(F.col("o.acl_version") + 1)
        owner = F.when(F.coalesce("o.owner", F.lit("")) != "", F.col("o.owner")).otherwise(F.col("n.owner"))
        came = j.select(
            "n.tenant", "n.id", "n.title", "n.body", owner.alias("owner"), "n.acl_group", F.col("n.new_hash").alias("content_hash"), F.when(fresh, 1).when(same, F.col("o.revision")).otherwise(F.col("o.revision") + 1).cast("int").alias("revision"),
            acl.cast("int").alias("acl_version"), F.lit(at).cast("long").alias("seen_at"), F.lit(False).alias("tombstoned"), (~same).alias("changed"),
        )
        # what came stands in its folder before the other tables are made of it: it is computed once
        folder = self.put("documents", came, m["buckets"])
        came = self.spark.read.schema(f"{SHAPES['documents']}, changed boolean").parquet(f"{self.path}/{folder}").drop("bucket")
        changed = came.where("changed")
        gone = self._few(changed.select(*keys))
        lines = chunker(F.col("body")) if chunker else F.filter(F.split("body", "\n", -1), lambda x: F.trim(x) != "")
        chunks = changed.select(*keys, F.posexplode(lines).alias("seq", "text")).withColumn("text_hash", F.sha2("text", 256))
        tables = {
            "links": changed.select("tenant", F.col("id").alias("src_id"), F.explode(text.links(F.col("body"), F.col("id"))).alias("dst_id")),
            "revisions": changed.select(*keys, "revision", "content_hash", "seen_at"),
        }
        if self.has("chunks", m, only):
            held = self.read("chunks", m, only)
            kept = held.where("vector IS NOT NULL").join(gone, keys, "left_semi").groupBy(*keys, "text_hash").agg(F.first("vector").alias("vector"))
            tables["chunks"] = held.join(gone, keys, "left_anti").unionByName(chunks.join(kept, [*keys, "text_hash"], "left"))
        else:
            tables["chunks"] = chunks.withColumn("vector", F.lit(None).cast("array<float>"))
        if self.has("documents", m, only):
            tables["documents"] = old.join(self._few(came.select(*keys)), keys, "left_anti")
        if self.has("links", m, only):
            tables["links"] = self.read("links", m, only).join(gone.withColumnRenamed("id", "src_id"), ["tenant", "src_id"], "left_anti").unionByName(tables["links"])
        if self.has("revisions", m, only):
            tables["revisions"] = self.read("revisions", m, only).unionByName(tables["revisions"])
        return self.commit(m, tables, only, {"documents": folder})

    def has(self, table: str, manifest: dict, only: list) -> bool:
        """Whether a table has rows in some of the buckets ``only``."""
        return any(str(b) in manifest["tables"][table] for b in only)

    def _few(self, keys: DataFrame) -> DataFrame:
        """Keys of a batch, to be sent to every task while they are up to ``KEYS``."""
        return F.broadcast(keys) if collected(keys.agg(F.count(F.lit(1)).alias("n")))[0]["n"] <= KEYS else keys

    def retire(self, gone: DataFrame, at: int) -> int:
        """Tombstone ``gone`` (tenant, id): their chunks and links go, they and their revisions stay; the version that holds it."""
        m = self.manifest()
        keys = ["tenant", "id"]
        only = [r["b"] for r in collected(gone.select(self.bucket("id", m["buckets"]).alias("b")).distinct())]
        if not only:
            return m["version"]
        out = self._few(gone.select(*keys).distinct())
        old = self.read("documents", m, only)
        marked = old.join(out, keys, "left_semi").withColumns({"seen_at": F.when(F.col("tombstoned"), F.col("seen_at")).otherwise(F.lit(at).cast("long")), "tombstoned": F.lit(True)})
        return self.commit(m, {
            "documents": old.join(out, keys, "left_anti").unionByName(marked),
            "chunks": self.read("chunks", m, only).join(out, keys, "left_anti"),
            "links": self.read("links", m, only).join(out.withColumnRenamed("id", "src_id"), ["tenant", "src_id"], "left_anti"),
        }, only)

    def embed(self, vectors: DataFrame) -> int:
        """Set the vectors of chunks by their text: ``vectors`` (tenant, text_hash, vector)."""
        m = self.manifest()
        chunks = self.read("chunks", m).drop("vector").join(vectors.select("tenant", "text_hash", "vector"), ["tenant", "text_hash"], "left")
        return self.commit(m, {"chunks": chunks}, list(range(m["buckets"])))

    def compact(self, tables=tuple(SHAPES)) -> int:
        """Write tables anew, a file for each bucket."""
        m = self.manifest()
        return self.commit(m, {t: self.read(t, m) for t in tables}, list(range(m["buckets"])), whole=True)

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the last ``keep`` manifests, and folders that none of these names; the number of folders removed."""
        known = self.versions()
        for v in known[:-keep]:
            self.fs.delete_file(f"{self.root}/manifests/{v}.json")
        named = {f for v in known[-keep:] for t in self.manifest(v)["tables"].values() for f in t.values()}
        gone = 0
        for t in SHAPES:
            for folder in self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.root}/{t}", allow_not_found=True)):
                mine = f"{t}/{folder.base_name}"
                if not any(f.startswith(f"{mine}/") for f in named):
                    self.fs.delete_dir(f"{self.root}/{mine}")
                    gone += 1
        return gone
