import pytest
from pyspark.sql import functions as F

from marlstone import surface, tools
from marlstone.functions import text

SF = "/root/testdata/sf0.001"
WHO = tools.Viewer("user2", "default", ("g0", "g1"))


@pytest.fixture(scope="module")
def registered(spark):
    surface.register(spark, SF, *WHO[:1], WHO.groups, WHO.tenant)
    return spark


def test_expand_agrees_with_the_tool(registered):
    for n in (2, 6, 12):
        got = {tuple(r) for r in registered.sql(f"SELECT id, rel, direction FROM expand('doc:{n}')").collect()}
        assert got == {(e["id"], e["rel"], e["direction"]) for e in tools.call(registered, SF, WHO, "expand", id=f"doc:{n}")["edges"] if e["ingested"]}
    assert registered.sql("SELECT * FROM expand('doc:3')").collect() == []


def test_search_is_planned_with_what_calls_it(registered):
    df = registered.sql("SELECT q.n, s.id, s.position FROM (VALUES (1, 'the re'), (2, 'nosuchword')) q(n, text), LATERAL search(q.text, 2) s")
    assert [(r["n"], r["position"]) for r in df.orderBy("position").collect()] == [(1, 1), (1, 2)]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_windows_of_code(registered):
    bodies = ["", "one", "\n".join(map(str, range(130))), "\n".join(map(str, range(61))), None]
    df = registered.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, body string")
    df.createOrReplaceTempView("bodies")
    got = sorted(tuple(r) for r in registered.sql("SELECT k, a, b, text FROM bodies, LATERAL code_windows(body, 60, 50)").collect())
    want = sorted(tuple(r) for r in df.where("body IS NOT NULL").select("k", F.explode(text.code_chunks(F.col("body"))).alias("c")).select("k", "c.a", "c.b", "c.text").collect())
    assert got == want
    for bad in ("code_windows(7, 60, 50)", "code_windows('x', 0, 50)", "code_windows('x', 60, 'y')"):
        with pytest.raises(Exception, match="code_windows"):
            registered.sql(f"SELECT * FROM {bad}").collect()
