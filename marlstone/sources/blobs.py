"""A store of blobs by content: packs written by a Spark data source that commits once, and links written after them.

``spark.dataSource.register(BlobSink)``; ``put`` writes what is not stored yet. Each task appends its blobs to a pack of its own,
reads the pack back, holds every blob against its SHA-256, and leaves an index of places in a staging folder. The commit is one
rename of that folder; an abort removes it, and the packs. So a task or a job killed half way leaves nothing that a reader sees:
readers go by the index, and by links. What nobody refers to is for ``collect_garbage``.

Folders under ``path``: packs, index, links, staging. Paths are of any file system that Arrow knows (file, hdfs, s3).

Defined cases: null content is no blob; equal contents of a tenant are stored once, with all their links; an empty blob is a blob.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

INDEX = pa.schema([("tenant", pa.string()), ("digest", pa.string()), ("pack", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
SHAPES = {"index": "tenant string, digest string, pack string, at long, size long", "links": "tenant string, source string, native_id string, digest string, size long"}
ROLL = 256 << 20  # bytes of a pack


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Written(WriterCommitMessage):
    def __init__(self, packs: list):
        self.packs = packs


class BlobWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def write(self, rows) -> Written:
        """One task: packs, read back and verified, and their index in the staging folder."""
        fs, root = opened(self.path)
        task = TaskContext.get()
        name = f"{self.job}-{task.partitionId()}-{task.taskAttemptId()}"
        fs.create_dir(f"{root}/packs", recursive=True)
        packs, index, held, out = [], [], 0, None
        for r in rows:
            if r["content"] is None:
                continue
            if out is None or held >= ROLL:
                if out is not None:
                    out.close()
                packs.append(f"{name}-{len(packs)}")
                out, held = fs.open_output_stream(f"{root}/packs/{packs[-1]}"), 0
            content = bytes(r["content"])
            out.write(content)
            index.append((r["tenant"], hashlib.sha256(content).hexdigest(), packs[-1], held, len(content)))
            held += len(content)
        if out is not None:
            out.close()
            self._verified(fs, root, index)
            fs.create_dir(f"{root}/staging/{self.job}", recursive=True)
            table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*index), INDEX)], INDEX)
            with fs.open_output_stream(f"{root}/staging/{self.job}/{name}.parquet") as f:
                pq.write_table(table, f)
        return Written(packs)

    @staticmethod
    def _verified(fs, root: str, index: list) -> None:
        for pack in dict.fromkeys(x[2] for x in index):
            with fs.open_input_file(f"{root}/packs/{pack}") as f:
                for _, digest, _, at, size in (x for x in index if x[2] == pack):
                    if hashlib.sha256(f.read_at(size, at)).hexdigest() != digest:
                        raise OSError(f"{pack} at {at} does not hold {digest}")

    def commit(self, messages) -> None:
        fs, root = opened(self.path)
        if fs.get_file_info(f"{root}/staging/{self.job}").type != pyarrow.fs.FileType.NotFound:
            fs.create_dir(f"{root}/index", recursive=True)
            fs.move(f"{root}/staging/{self.job}", f"{root}/index/{self.job}")

    def abort(self, messages) -> None:
        fs, root = opened(self.path)
        for m in messages:
            for pack in m.packs if m else []:
                fs.delete_file(f"{root}/packs/{pack}")
        if fs.get_file_info(f"{root}/staging/{self.job}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/staging/{self.job}")


class BlobSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return "tenant string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("blobs are only added; collect_garbage removes those without links")
        return BlobWriter(dict(self.options))


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The index or the links, as far as they are committed."""
    fs, root = opened(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/{name}", allow_not_found=True))
    folders = sorted(f"{path}/{name}/{f.base_name}" for f in found if f.type == pyarrow.fs.FileType.Directory)
    return spark.read.schema(SHAPES[name]).parquet(*folders) if folders else spark.createDataFrame([], SHAPES[name])


def put(artifacts: DataFrame, path: str) -> None:
    """Store ``artifacts`` (tenant, source, native_id, content) and link them: blobs first, so a link never leads nowhere."""
    spark = artifacts.sparkSession
    a = artifacts.where("content IS NOT NULL").withColumn("digest", F.sha2("content", 256))
    known = table(spark, path, "index").select("tenant", "digest")
    new = a.select("tenant", "digest", "content").dropDuplicates(["tenant", "digest"]).join(known, ["tenant", "digest"], "left_anti")
    new.select("tenant", "content").write.format("blobs").mode("append").option("path", path).save()
    linked = a.select("tenant", "source", "native_id", "digest", F.octet_length("content").cast("long").alias("size")).distinct()
    held = table(spark, path, "links")
    linked.join(held, ["tenant", "source", "native_id", "digest"], "left_anti").select(*held.columns).write.parquet(f"{path}/links/{uuid.uuid4().hex}")


def get(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """tenant, digest, content of those ``wanted`` (tenant, digest): packs are read where the blobs lie, and each is held against its digest."""
    places = table(spark, path, "index").join(wanted.select("tenant", "digest").distinct(), ["tenant", "digest"])
    places = places.repartition("pack").sortWithinPartitions("pack", "at")

    def read(batches):
        fs, root = opened(path)
        for b in batches:
            out, name, f = [], None, None
            for pack, at, size, digest in zip(*(b.column(c).to_pylist() for c in ("pack", "at", "size", "digest"))):
                if pack != name:
                    name, f = pack, fs.open_input_file(f"{root}/packs/{pack}")
                content = f.read_at(size, at)
                if hashlib.sha256(content).hexdigest() != digest:
                    raise OSError(f"{pack} at {at} does not hold {digest}")
                out.append(content)
            yield pa.RecordBatch.from_arrays([b.column("tenant"), b.column("digest"), pa.array(out, pa.binary())], ["tenant", "digest", "content"])

    return places.mapInArrow(read, "tenant string, digest string, content binary")


def _replaced(spark: SparkSession, path: str, name: str, kept: DataFrame) -> None:
    """``kept`` in place of the folders of a table: written first, then the old ones go."""
    fs, root = opened(path)
    old = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/{name}", allow_not_found=True))]
    kept.write.parquet(f"{path}/{name}/{uuid.uuid4().hex}")
    for folder in old:
        fs.delete_dir(folder)


def retire(spark: SparkSession, path: str, gone: DataFrame) -> None:
    """Take away the links of ``gone`` (tenant, source, native_id)."""
    _replaced(spark, path, "links", table(spark, path, "links").join(gone.select("tenant", "source", "native_id"), ["tenant", "source", "native_id"], "left_anti"))


def collect_garbage(spark: SparkSession, path: str) -> int:
    """Remove index rows of blobs without a link, then packs without a row; the number of packs removed.

    A pack goes when nothing in it is wanted. One writer or collector at a time.
    """
    index = table(spark, path, "index").join(table(spark, path, "links").select("tenant", "digest"), ["tenant", "digest"], "left_semi")
    _replaced(spark, path, "index", index)
    fs, root = opened(path)
    packs = [f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/packs", allow_not_found=True))]
    there = spark.createDataFrame([(p,) for p in packs], "pack string")
    orphans = [r["pack"] for r in there.join(table(spark, path, "index").select("pack").distinct(), "pack", "left_anti").collect()]
    for p in orphans:
        fs.delete_file(f"{root}/packs/{p}")
    return len(orphans)
