import random

import pytest

from marlstone.llm import exact

rng = random.Random(5)
TEXTS = ["", None, "a", "A", "a ", "a\n", "é", "é", "x" * 300_000, *(f"text {k}" for k in range(200))]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return groups


@pytest.mark.parametrize(("per_filter", "hot_share"), [(1 << 23, 1000), (40, 3)])
def test_groups_are_those_of_brute_force(spark, monkeypatch, per_filter, hot_share):
    monkeypatch.setattr(exact, "ROWS_PER_FILTER", per_filter)
    monkeypatch.setattr(exact, "HOT_SHARE", hot_share)
    rows = [(k, rng.choice(TEXTS) if k % 3 else "hot") for k in range(300)] + [(5, "tie"), (5, "tie"), (None, "tie"), (None, "nobody"), (None, "nobody")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = brute(rows)
    got = exact.copies_report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r["text"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    for text, ids in groups.items():
        assert [r["doc_id"] for r in got if r["text"] == text and r["kept"]] == [max((i for i in ids if i is not None), default=None)]


def test_a_crowded_filter_only_alarms_in_vain(spark, monkeypatch):
    monkeypatch.setattr(exact, "FILTER_BITS", 64)
    rows = [(k, f"text {k % 150}") for k in range(200)]
    got = exact.copies_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got if r["kept"]) == list(range(50, 200))


def test_clear_rows_meet_no_exchange(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k % 90}") for k in range(100)], "doc_id long, text string")
    hashes = docs.selectExpr("xxhash64(text) AS h")
    filt = exact.repeated_slots(hashes)
    tested = exact._tested(docs.withColumn("__h", exact.F.xxhash64("text")), filt)
    assert tested.where("__suspect").count() == 20
    out, _ = exact.marked(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    clear = plan[plan.index("Union") :]
    assert "Python" not in plan and clear.count("Exchange hashpartitioning") <= 2  # both of the join of suspects to their groups


def test_columns_and_empty_tables(spark):
    clash = ["__h", "__sha", "__row", "__size", "word", "bits", "slot", "count", "kept"]
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "doc_id long, text string").selectExpr("*", *[f"{k} AS `{c}`" for k, c in enumerate(clash)])
    out = exact.keep_one(docs)
    assert out.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(2, "a"), (4, "")]
    assert all([r[c] for c in clash] == list(range(len(clash))) for r in out.collect())
    assert exact.keep_one(docs.where("false")).collect() == [] and exact.copies_report(docs.where("false")).collect() == []
