import hashlib
import os

import pytest
from pyspark.sql import functions as F

from marlstone.sources import blobs


@pytest.fixture
def store(spark, tmp_path):
    spark.dataSource.register(blobs.BlobSink)
    return f"file://{tmp_path}/store"


def artifacts(spark, rows):
    return spark.createDataFrame([(t, s, n, None if c is None else bytearray(c)) for t, s, n, c in rows], "tenant string, source string, native_id string, content binary").repartition(3)


def sha(c):
    return hashlib.sha256(c).hexdigest()


def everything(spark, store):
    return {(r["tenant"], r["digest"]): bytes(r["content"]) for r in blobs.get(spark, store, blobs.table(spark, store, "links")).collect()}


ROWS = [("t", "jira", f"n{k}", f"content {k % 7}".encode() * k) for k in range(20)] + [("u", "jira", "n1", b"content 1"), ("t", "wiki", "empty", b""), ("t", "wiki", "none", None)]


def test_blobs_are_stored_once_and_linked(spark, store):
    blobs.put(artifacts(spark, ROWS), store)
    want = {(t, sha(c)): c for t, _, _, c in ROWS if c is not None}
    assert everything(spark, store) == want and blobs.table(spark, store, "index").count() == len(want)
    blobs.put(artifacts(spark, [*ROWS, ("t", "jira", "again", b"content 1"), ("t", "jira", "new", b"new")]), store)
    assert everything(spark, store) == want | {("t", sha(b"new")): b"new"} and blobs.table(spark, store, "index").count() == len(want) + 1
    links = {(r["tenant"], r["source"], r["native_id"], r["digest"], r["size"]) for r in blobs.table(spark, store, "links").collect()}
    assert links == {(t, s, n, sha(c), len(c)) for t, s, n, c in [*ROWS, ("t", "jira", "again", b"content 1"), ("t", "jira", "new", b"new")] if c is not None}
    assert not os.path.exists(store[7:] + "/staging") or os.listdir(store[7:] + "/staging") == []


def test_a_job_killed_half_way_leaves_nothing_visible(spark, store):
    blobs.put(artifacts(spark, ROWS[:3]), store)
    before = everything(spark, store)

    @F.udf("binary")
    def fails(c):
        if bytes(c) == b"bad":
            raise RuntimeError("killed")
        return c

    more = artifacts(spark, [("t", "x", f"m{k}", f"more {k}".encode()) for k in range(30)] + [("t", "x", "bad", b"bad")])
    with pytest.raises(Exception, match="killed"):
        more.select("tenant", fails("content").alias("content")).write.format("blobs").mode("append").option("path", store).save()
    assert everything(spark, store) == before and blobs.table(spark, store, "index").count() == 3
    blobs.collect_garbage(spark, store)  # what the killed tasks wrote
    packs = set(os.listdir(store[7:] + "/packs"))
    assert packs == {r["pack"] for r in blobs.table(spark, store, "index").collect()} and everything(spark, store) == before


def test_what_has_no_link_goes(spark, store):
    blobs.put(artifacts(spark, ROWS), store)
    blobs.retire(spark, store, spark.createDataFrame([("t", "jira", f"n{k}") for k in range(20)], "tenant string, source string, native_id string"))
    blobs.collect_garbage(spark, store)
    assert everything(spark, store) == {("u", sha(b"content 1")): b"content 1", ("t", sha(b"")): b""} and blobs.table(spark, store, "index").count() == 2


def test_damage_is_found(spark, store):
    blobs.put(artifacts(spark, [("t", "x", "a", b"abc")]), store)
    (pack,) = os.listdir(store[7:] + "/packs")
    with open(f"{store[7:]}/packs/{pack}", "r+b") as f:
        f.write(b"X")
    with pytest.raises(Exception, match="does not hold"):
        everything(spark, store)


def test_empty(spark, store):
    blobs.put(artifacts(spark, []), store)
    assert everything(spark, store) == {} and blobs.collect_garbage(spark, store) == 0
