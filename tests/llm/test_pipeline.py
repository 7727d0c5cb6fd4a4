import sys

import duckdb
import pytest

from marlstone.llm import decontam, line_dedup, quality

SF = "/root/testdata/sf0.001"


def duck(con, sql, docs):
    con.register("documents", docs)
    return con.execute(sql).df()


def test_each_stage_against_its_own_reference(spark):
    import corpus_pipeline as P

    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_jaccard import brute

    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs.toPandas()
        docs = P.written(stage(spark, docs, SF), "test-stage")
        seen[name] = (before, docs.toPandas())
        assert name == "mix" or docs.columns == columns
    before, after = seen["quality_rules"]
    q = duck(con, quality.ORACLE, before)
    assert set(after.doc_id) == set(q[q.kept].doc_id) and 0 < len(after) < len(before)
    before, after = seen["line_dedup"]
    import hashlib

    want = duck(con, line_dedup.ORACLE, before).set_index("doc_id").kept_sha256.to_dict()
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in zip(after.doc_id, after.text)} == want
    assert [len(t) for t in after.text] == list(after.n_chars)
    before, after = seen["near_duplicates"]
    groups = brute(list(zip(before.doc_id, before.text)), 5, 80, 100)
    assert sorted(after.doc_id) == sorted({c for _, _, c in groups})
    before, after = seen["decontaminate"]
    d = duck(con, decontam.ORACLE, before)
    assert set(after.doc_id) == set(d[~d.contaminated].doc_id)
    before, after = seen["mix"]
    assert sorted(after.doc_id) == sorted(before.doc_id) and (after.taken <= 2 * after["size"]).all()
    for _, g in after.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
    assert [sum(c["words"] for c in x) for x in after.copies] == list(after.taken)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "a b", "en", "s", 3)] * 3])
def test_odd_tables(spark, rows):
    import corpus_pipeline as P

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS size", "2 AS kept", "3 AS n_lines", "4 AS n_dropped", "5 AS __doc", "6 AS __hash", "7 AS words", "8 AS __id")
    for name, stage in P.STAGES:
        one = stage(spark, docs, SF)
        one.collect()
        assert name == "mix" or one.columns == docs.columns


def test_a_stage_called_again_leaves_its_first_result(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(k, f"some words of text number {k} " * 20, "en", "s", 9) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        one, two = stage(spark, docs, SF), stage(spark, docs, SF)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def rows(df):
    return sorted(map(str, df.collect()))


def test_stages_composed_without_writes(spark):
    import corpus_pipeline as P

    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert rows(docs) == rows(P.run(spark, SF)) and len(rows(docs)) > 50
    assert rows(P.quality_rules(spark, first, SF)) == rows(P.quality_rules(spark, first, SF))


def test_a_run_leaves_its_result_alone(spark):
    import corpus_pipeline as P
    from marlstone.sources import store

    lazy = P.quality_rules(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    before = store.live()
    out = P.run(spark, SF)
    assert [path for _, path in store.live() if (_, path) not in before] == [out._marlstone_path]
    assert len(rows(lazy)) > 50  # its tables are another run's
