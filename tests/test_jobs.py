import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.operators import jobs
from marlstone.sources import attachments
from marlstone.sources.store import written

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return F.lit(T0 + dt.timedelta(seconds=seconds))


def queue(spark, keys, most=2):
    empty = spark.createDataFrame([], jobs.SCHEMA)
    new = spark.createDataFrame([("t", "kind", '{"x":1}', k, T0, most) for k in keys], "tenant string, job_type string, payload string, key string, run_after timestamp, max_attempts int")
    return jobs.enqueue(empty, new)[0]


def states(df):
    return {r["key"]: (r["status"], r["attempts"], r["fence"]) for r in df.collect()}


def test_a_crashed_worker_loses_its_job_and_its_say(spark):
    q = written(jobs.claim(queue(spark, "a"), "w1", at(0)), "q")
    old = q.select("id", F.lit("w1").alias("worker"), "fence", F.lit("completed").alias("outcome"), F.lit(None).cast("string").alias("error"))
    q = written(jobs.claim(q, "w2", at(61)), "q")
    assert states(q) == {"a": ("claimed", 2, 2)}
    after, refused = jobs.settle(q, old, at(62))
    assert states(after) == states(q) and refused.count() == 1
    q = written(jobs.claim(q, "w3", at(200)), "q")  # the second of two attempts ran out too
    assert states(q) == {"a": ("dead_letter", 2, 2)} and q.first()["last_error"] == jobs.CRASHED
    q = written(jobs.replay(q, q, at(201)), "q")
    assert states(q) == {"a": ("pending", 0, 2)} and states(jobs.claim(q, "w4", at(202))) == {"a": ("claimed", 1, 3)}


def test_a_batch_takes_those_that_wait_longest(spark):
    q = jobs.claim(queue(spark, "abc"), "w", at(0), batch=2)
    assert sorted(s for s, _, _ in states(q).values()) == ["claimed", "claimed", "pending"]
    with pytest.raises(ValueError):
        jobs.claim(q, "w", at(0), batch=0)


def test_work_runs_handlers_and_keeps_errors_without_credentials(spark):
    seen = []

    def handle(tenant, payload):
        seen.append(payload)

    def bad(tenant, payload):
        raise RuntimeError("no answer from https://u:secret@h.example/")

    q = jobs.work(queue(spark, "ab"), "w", {"kind": handle}, at(0))
    assert [s for s, _, _ in states(q).values()] == ["completed"] * 2 and seen == ['{"x":1}'] * 2
    q = jobs.work(queue(spark, "a"), "w", {"kind": bad}, at(0))
    assert states(q) == {"a": ("pending", 1, 1)} and "secret" not in q.first()["last_error"]
    q = jobs.work(q, "w", {}, at(100))
    assert states(q) == {"a": ("dead_letter", 2, 2)} and "KeyError" in q.first()["last_error"]
    empty = spark.createDataFrame([], jobs.SCHEMA)
    assert jobs.work(empty, "w", {}, at(0)).count() == 0


def test_conflicting_intents_and_buckets(spark):
    new = spark.createDataFrame([("t", "kind", '{"x":1}', "k", T0, None), ("t", "other", '{"x":1}', "k", T0, None)], "tenant string, job_type string, payload string, key string, run_after timestamp, max_attempts int")
    q, wrong = jobs.enqueue(spark.createDataFrame([], jobs.SCHEMA), new)
    assert [r["job_type"] for r in q.collect()] == ["kind"] and [r["job_type"] for r in wrong.collect()] == ["other"]
    keys = [spark.range(1).select(jobs.bucket_key("s", at(x))).first()[0] for x in (0, 3599, 3600)]
    assert keys[0] == keys[1] != keys[2]


def test_links_stay_below_their_source(spark):
    base = "https://h.example/ctx"
    cases = {
        "https://h.example/ctx/a/b?x=1": "/a/b?x=1", "/ctx/a/../b": "/b", "https://H.example/ctx/a#f": "/a", "https://h.example/ctx": "/",
        "https://h.example.evil/ctx/a": None, "https://u@h.example/ctx/a": None, "//h.example/ctx/a": None, "/ctxevil/a": None, "/ctx/../a": None, "/ctx/%2e%2E/a": None,
        "/ctx\\..\\a": None, "/ctx/a\nb": None, "ftp://h.example/ctx/a": None, "a": None, "": None, None: None,
    }
    got = {r["link"]: r["p"] for r in spark.createDataFrame([(k,) for k in cases], "link string").select("link", attachments.same_origin(F.col("link"), base).alias("p")).collect()}
    assert got == cases
    with pytest.raises(ValueError):
        attachments.same_origin(F.lit("/a"), "h.example")


def test_refused_bytes_are_debt_and_retire_nothing(spark):
    e = spark.createDataFrame([("d", "1", "1", None, None, "/a"), ("d", "2", "1", None, None, "/b"), ("e", "3", "1", None, None, "/c"), ("e", None, "1", None, None, "/d")], "doc_id string, native_id string, revision string, media_type string, filename string, link string")
    listed = attachments.listing(e, "https://h.example")
    got = {r["native_id"]: (r["data"], r["media_type"]) for r in attachments.acquired(listed, lambda p: b"x" if p == "/a" else b"x" * 9 if p == "/b" else None, most=5).collect()}
    assert {k: v and bytes(v) for k, (v, _) in got.items()} == {"1": b"x", "2": None, "3": None} and got["1"][1] == attachments.DEFAULT_MEDIA_TYPE
    stored = spark.createDataFrame([(d, n, r) for d in "def" for n in "129" for r in "12"], "doc_id string, native_id string, revision string")
    gone = attachments.gone(stored, listed, spark.createDataFrame([("d",), ("e",)], "doc_id string"))
    assert sorted(map(tuple, gone.collect())) == [("d", "9", "1"), ("d", "9", "2")]  # one of e's entries names nothing
