"""What FINDINGS_r03 names: work that grew faster than the input."""

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from marlstone import surface
from marlstone.operators import answers, code, ivf
from marlstone.operators import search as searching
from marlstone.plans import lexical as plans
from marlstone.plans import reqs as plans_of_trees
from marlstone.reqs import rules, tree
from marlstone.sources import postings, scan, versions

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [2, 4096])
def test_pairs_of_a_common_token_are_not_exchanged(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    monkeypatch.setattr(code, "PAIRS", 7)
    names = ["ts", "src", "handler", "retry", "x1", "rare"]
    of = lambda k, n: [names[(k * j + j) % len(names)] for j in range(n)]
    kinds = ["exact", "path_suffix", "subtoken"]
    rows = [(w, f"f{k}", f"p{k}", kinds[(k + j) % 3], float(k % 4), 1 + (k * j) % 5) for k in range(40) for j, w in enumerate(of(k, 4))]
    tokens = spark.createDataFrame(rows, "token string, id string, path string, match_class string, factor double, line int")
    asked = {f"q{k}": " ".join(of(k + 1, 1 + k % 3)) for k in range(9)} | {"none": "zzz", "empty": ""}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, query string")
    words = queries.select("query_id", F.explode(code.text.query_tokens(F.col("query"))).alias("w")).collect()
    want = {}
    for q in asked:
        ws = {r["w"] for r in words if r["query_id"] == q}
        for f in {r[1] for r in rows}:
            hit = [r for r in rows if r[1] == f and r[0] in ws]
            if hit:
                best = max(((7000 if r[3] != "subtoken" else 4000) + (500 if r[3] == "exact" else 50) + 100 * r[4], -r[5]) for r in hit)
                want[q, f] = (f"p{f[1:]}", -best[1], best[0] + (1 - 1 / len({r[0] for r in hit})) * 400)
    df = code.ranked(queries, tokens)
    assert {(r["query_id"], r["id"]): (r["path"], r["line"], r["score"]) for r in df.collect()} == want and len(want) > 100
    assert "Aggregate" not in plan(df) and "hashpartitioning" not in plan(df)


def test_the_library_in_sql_builds_no_index_for_stated_queries(spark, monkeypatch):
    def search(**more):
        surface.register(spark, SF, "user2", ("g0", "g1"), **more)
        spark.createDataFrame([("a", "The re, of"), ("b", "nosuchword"), ("c", "und die the")], "q string, text string").createOrReplaceTempView("stated")
        return sorted(tuple(r) for r in spark.sql("SELECT q.q, s.id, s.score, s.position FROM stated q, LATERAL search(q.text, 5) s").collect())

    want = search()
    monkeypatch.setattr(postings, "build", lambda *a: pytest.fail("an index is built"))
    monkeypatch.setattr(postings, "_built", {})
    stated = spark.createDataFrame([("The re, of",), ("nosuchword",), ("und die the",)], "query string")
    assert search(queries=stated) == want and len(want) == 10
    for name in ("sql_expand", "sql_search", "sql_code_windows"):
        assert plans.Q[name](spark, SF).limit(1).count() == 1


@pytest.mark.parametrize("cells", [1 << 22, 1 << 12])
def test_a_vector_leaves_its_task_once_for_a_block_of_queries(spark, tmp_path, monkeypatch, cells):
    monkeypatch.setattr(ivf, "CELLS", cells)
    rng = np.random.default_rng(3)
    vecs = {k: rng.normal(size=5).astype(np.float32) for k in range(120)} | {7: np.zeros(5, np.float32)}
    spark.createDataFrame([(k, v.tolist(), 0) for k, v in vecs.items()], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = ivf.measured(spark, str(tmp_path))
    want = {}
    for q in range(0, 120, 20):
        for k, v in vecs.items():
            a, b = vecs[q].astype(float), v.astype(float)
            both = np.sqrt((a**2).sum() * (b**2).sum())
            want[f"doc:{q}", f"doc:{k}"] = (round(a @ b / both, 9) if both else 0.0, int(((a >= 0) != (b >= 0)).sum()))
    assert {(r["query_id"], r["id"]): (round(r["cosine"], 9), r["distance"]) for r in df.collect()} == want
    assert "Generate" in plan(df) and df.agg(F.count(F.lit(1))).collect()[0][0] == 720


def test_only_candidates_texts_are_exchanged(spark):
    """A chunk meets the candidates where it is read, not in an exchange of all chunks."""
    docs = spark.createDataFrame([("t", f"d{k}", "", "retry policy" if k == 3 else f"word{k}\nother", "authored", 5, "jira") for k in range(50)], "tenant string, id string, title string, body string, quality_tier string, age_days int, source string")
    chunks = docs.select("tenant", "id", F.posexplode(F.split("body", "\n")).alias("seq", "text"))
    seen = []
    real = answers.written
    with pytest.MonkeyPatch.context() as m:
        m.setattr(answers, "written", lambda df, name: (seen.append((name, plan(df))), real(df, name))[1])
        got = answers.answer(scan.Texts.read(docs, seen=True), spark.createDataFrame([("q", "retry policy")], "query_id string, query string"), docs, chunks)
    assert [(r["id"], r["verified"]) for r in got.results.collect()] == [("d3", True)]
    checked = dict(seen)["checked"]
    assert checked.count("LeftSemi, BuildRight") == 2 and "SortMergeJoin [tenant" not in checked.split("LeftSemi")[-1]


def test_hybrid_search_builds_no_index(spark, monkeypatch):
    got = lambda: sorted(tuple(r) for r in searching.search_hybrid(spark, SF).collect())
    monkeypatch.setattr(postings, "_built", {})
    monkeypatch.setattr(postings, "_asked", {})
    with monkeypatch.context() as m:
        m.setattr(postings, "build", lambda *a: pytest.fail("an index is built"))
        stated = got()
    postings.lexical(spark, SF)
    assert got() == stated and {r[0] for r in stated} == {"q1", "q2", "q3"}


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_an_upsert_exchanges_texts_once(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(versions, "KEYS", few, raising=False)
    plans, real = [], DataFrameWriter.parquet

    def parquet(w, path, *a, **k):
        plans.append((path.split("/")[-2], plan(w._df)))
        return real(w, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    c = versions.Catalog(spark, f"file://{tmp_path}/catalog", 4)
    rows = [("t", f"d{k}", f"T{k}", f"one {k}\n\nsee PAY-{k}", "kim", "g0") for k in range(30)]
    c.upsert(spark.createDataFrame(rows, versions.BATCH), 1)
    exchanges = [(t, p.count("Exchange hashpartitioning")) for t, p in plans]
    assert sorted(exchanges) == [("chunks", 0), ("documents", 2), ("links", 0), ("revisions", 0)]  # the second one: what stood, without texts
    c.embed(c.read("chunks").select("tenant", "text_hash").distinct().withColumn("vector", F.array(F.lit(1.0).cast("float"))))
    plans.clear()
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    c.upsert(spark.createDataFrame([(*r[:3], r[3] + "\nmore", *r[4:]) for r in rows[:5]] + [rows[9]], versions.BATCH), 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    held = [p for t, p in plans if t == "documents"][-1]
    assert ("Exchange hashpartitioning" in held) == (few == 0)
    chunks = {(r["id"], r["seq"]): (r["text"], r["vector"]) for r in c.read("chunks").collect()}
    want = {(f"d{k}", n): (x, None if x == "more" else [1.0]) for k in range(30) for n, x in enumerate([f"one {k}", f"see PAY-{k}"] + ["more"] * (k < 5))}
    assert chunks == want and {r["id"]: (r["revision"], r["seen_at"]) for r in c.read("documents").collect()} == {f"d{k}": (1 + (k < 5), 2 if k < 5 or k == 9 else 1) for k in range(30)}
    c.retire(spark.createDataFrame([("t", "d1"), ("t", "d20")], "tenant string, id string"), 3)
    assert {i for i, _ in chunks} - {r["id"] for r in c.read("chunks").collect()} == {"d1", "d20"} and c.read("revisions").count() == 35


@pytest.mark.parametrize("name, most", [("DEFER-001", 4), ("DEFER-002", 1), ("CLARIFY-005", 4), ("SCORE-001", 2)])
def test_a_rule_reads_bodies_and_nodes_once(spark, name, most):
    """Nodes have two parts here, those of the first levels and deeper ones; the quote rule reads the documents besides."""
    p = plan(rules.run(name, tree.read(plans_of_trees.bodies(spark, SF)), plans_of_trees.docs(spark, SF)))
    assert 0 < p.count("FileScan parquet") <= most


def test_words_of_a_lexicon_and_quotes_by_any_white_space(spark):
    folded = lambda x: tree.F.regexp_replace(x, tree.SPACES, " ")
    texts = ["I  think", "i\u00a0\n think", "ithink", " TO be\u3000decided", "why ???", "a.b", "a\\Eb  c", "", " \t", None, "It\u0130s TBD", "a (b) c\n", "x a\tb", "axb"]
    quotes = ["I think", "a\\Eb c", "", " ", "(b)  c", "a.b", "a b ", "\\Q", "$", None]
    d = spark.createDataFrame([(t, q) for t in texts for q in quotes], "t string, q string")
    t, q, low = F.col("t"), F.col("q"), F.lower(folded(F.col("t")))
    known = F.lit(False)
    for x in [*tree.DEFERRALS, *tree.HEDGES]:
        known = known | low.contains(x)
    wrong = d.where(
        ~tree.quoted(t, q).eqNullSafe(F.contains(F.trim(folded(t)), F.trim(folded(q)))) | (tree.holds(t, [*tree.DEFERRALS, *tree.HEDGES]) != F.coalesce(known, F.lit(False)))
        | ~tree.fold(t).eqNullSafe(folded(t)) | (rules.blank(t) != F.coalesce(F.regexp_replace(t, tree.SPACES, "") == "", F.lit(True))))
    assert wrong.collect() == [] and d.where(tree.quoted(t, q)).count() > 20
