import random

import pytest
from pyspark.sql import functions as F

from marlstone.sources import versions

rng = random.Random(6)


@pytest.fixture
def catalog(spark, tmp_path):
    return versions.Catalog(spark, f"file://{tmp_path}/catalog", 4)


def batch(spark, rows):
    return spark.createDataFrame(rows, versions.BATCH)


def doc(k, body, owner="kim", acl="g0"):
    return ("t", f"d{k}", f"Title {k}", body, owner, acl)


def docs(c, m=None):
    return {r["id"]: r for r in c.read("documents", m).collect()}


def texts(c, m=None):
    out: dict = {}
    for r in sorted(c.read("chunks", m).collect(), key=lambda r: (r["id"], r["seq"])):
        out.setdefault(r["id"], []).append(r["text"])
    return out


def test_an_upsert_changes_all_tables_at_once(spark, catalog):
    c = catalog
    assert c.upsert(batch(spark, []), 1) == 0 and c.versions() == []
    rows = [doc(k, f"one {k}\n\ntwo see PAY-{k}\nthree") for k in range(20)]
    assert c.upsert(batch(spark, rows), 1) == 1
    old = c.manifest()
    c.embed(c.read("chunks").select("tenant", "text_hash", F.array(F.length("text").cast("float")).alias("vector")).distinct())
    again = [doc(3, "one 3\n\nchanged\nthree", owner="lee", acl="g1"), doc(4, "one 4\n\ntwo see PAY-4\nthree", owner="lee"), doc(5, "one 5\n\ntwo see PAY-5\nthree", acl="g9"), doc(30, "new", owner="")]
    assert c.upsert(batch(spark, [*again, again[0]]), 2) == 3
    d = docs(c)
    assert (d["d3"]["revision"], d["d3"]["owner"], d["d3"]["acl_version"], d["d3"]["seen_at"]) == (2, "kim", 2, 2)
    assert (d["d4"]["revision"], d["d4"]["owner"], d["d4"]["acl_version"], d["d4"]["seen_at"]) == (1, "kim", 1, 2)
    assert (d["d5"]["revision"], d["d5"]["acl_version"], d["d5"]["acl_group"]) == (1, 2, "g9") and d["d6"]["seen_at"] == 1 and d["d30"]["revision"] == 1 and len(d) == 21
    assert texts(c)["d3"] == ["one 3", "changed", "three"] and texts(c)["d30"] == ["new"]
    vectors = {(r["id"], r["text"]): r["vector"] for r in c.read("chunks").collect()}
    assert vectors["d3", "one 3"] == [5.0] and vectors["d3", "three"] == [5.0] and vectors["d3", "changed"] is None and vectors["d4", "one 4"] == [5.0]
    links = {(r["src_id"], r["dst_id"]) for r in c.read("links").collect()}
    assert links == {(f"d{k}", f"jira:issue:PAY-{k}") for k in range(20) if k != 3}
    revisions = sorted((r["id"], r["revision"], r["seen_at"]) for r in c.read("revisions").collect())
    assert revisions == sorted([(f"d{k}", 1, 1) for k in range(20)] + [("d3", 2, 2), ("d30", 1, 2)])
    assert texts(c, old)["d3"] == ["one 3", "two see PAY-3", "three"] and docs(c, old)["d3"]["revision"] == 1  # who reads an older version still does


def test_only_buckets_of_the_batch_are_written(spark, catalog):
    catalog.upsert(batch(spark, [doc(k, "x") for k in range(40)]), 1)
    before = catalog.manifest()["tables"]["documents"]
    catalog.upsert(batch(spark, [doc(7, "y")]), 2)
    after = catalog.manifest()["tables"]["documents"]
    assert set(before) == set(after) and sum(before[b] != after[b] for b in before) == 1


def test_a_second_writer_of_a_version_is_refused(spark, catalog):
    catalog.upsert(batch(spark, [doc(1, "x")]), 1)
    stale = catalog.manifest()
    catalog.upsert(batch(spark, [doc(2, "y")]), 2)
    with pytest.raises(versions.Conflict):
        catalog.commit(stale, {"documents": catalog.read("documents", stale)}, [0])
    assert set(docs(catalog)) == {"d1", "d2"} and catalog.versions() == [1, 2]


def test_a_commit_that_dies_before_its_manifest_is_not_seen(spark, catalog, monkeypatch):
    catalog.upsert(batch(spark, [doc(1, "x")]), 1)
    with monkeypatch.context() as m:
        m.setattr(versions.Catalog, "_named", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            catalog.upsert(batch(spark, [doc(1, "y"), doc(2, "z")]), 2)
    assert texts(catalog) == {"d1": ["x"]} and catalog.vacuum() >= 4  # the folders that it left, one for each table
    assert texts(catalog) == {"d1": ["x"]}


def test_histories_against_a_plain_model(spark, catalog):
    state, log = {}, []
    for at in range(1, 6):
        rows = [doc(k, rng.choice(["", "a\nb", "a\nc", None]), owner=rng.choice(["", "kim", "lee"])) for k in rng.sample(range(12), 5)]
        catalog.upsert(batch(spark, rows), at)
        for _, i, _, body, owner, _ in rows:
            body = body or ""
            was = state.get(i)
            revision = 1 if was is None else was[1] + (was[0] != body)
            if was is None or was[0] != body:
                log.append((i, revision))
            state[i] = (body, revision, (was[2] if was and was[2] else owner))
    assert {i: (r["body"], r["revision"], r["owner"]) for i, r in docs(catalog).items()} == state
    assert texts(catalog) == {i: s[0].split("\n") for i, s in state.items() if s[0]}
    assert sorted((r["id"], r["revision"]) for r in catalog.read("revisions").collect()) == sorted(log)
    catalog.compact()
    assert catalog.vacuum(1) > 0 and {i: r["revision"] for i, r in docs(catalog).items()} == {i: s[1] for i, s in state.items()}
