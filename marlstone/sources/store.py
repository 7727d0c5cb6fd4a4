"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list = []
_scopes: contextvars.ContextVar = contextvars.ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is set, a temporary one in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Queries planned and run inside remove their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the
    lineage, and a lost executor costs no recomputation of what stands there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    for log in (_written, *_scopes.get()):
        log.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._marlstone_path = path
    return out


def state(spark: SparkSession, path: str) -> tuple:
    """Files of a table with their sizes and times: what is built from a table is built again when this changes."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    s = fs.getContentSummary(p)
    return s.getFileCount(), s.getLength(), fs.getFileStatus(p).getModificationTime()


def is_folder(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def collected(df: DataFrame) -> list:
    """The rows of a result whose size is bounded, without leaving shuffle files."""
    with tidy(df.sparkSession):
        return df.select("*").collect()


def drop(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t._marlstone_path)
        _written.remove((t.sparkSession, t._marlstone_path))


def live() -> list:
    """The tables that ``written`` made and nothing has dropped, in order."""
    return list(_written)


def drop_paths(tables: list) -> None:
    """Remove those of ``tables`` (of ``live()``) that still stand."""
    for entry in tables:
        if entry in _written:
            _written.remove(entry)
            _delete(*entry)


@contextlib.contextmanager
def scope():
    """The list of the tables written inside, by this thread: other runs of the process have lists of their own."""
    mine: list = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield mine
    finally:
        _scopes.reset(token)


@contextlib.contextmanager
def drop_all_but():
    """At the end, remove every table written inside, except those that went through the function given."""
    kept = []

    def keep(t: DataFrame) -> DataFrame:
        kept.append((t.sparkSession, t._marlstone_path))
        return t

    with scope() as mine:
        yield keep
    drop_paths([x for x in mine if x not in kept])


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_exit() -> None:
    try:
        drop_paths(live())
    except Exception:  # the gateway may be gone already; the files are then left to the folder's owner
        _written.clear()
