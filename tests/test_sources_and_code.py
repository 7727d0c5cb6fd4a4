import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import htmlmd, notes, paths
from marlstone.operators import code, embed
from marlstone.sources import rules as R


def column(spark, f, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").orderBy("k").select(f(F.col("v"))).collect()]


def test_globs(spark):
    p = ["a.ts", "src/a.ts", "src/x/b.test.ts", "docs/r.md", "src/ab"]
    assert column(spark, lambda c: R.wanted(c, ["**/*.ts"], ["**/*.test.ts"]), p) == [True, True, False, False, False]
    assert column(spark, lambda c: R.wanted(c, ["src/?b", "docs/**"]), p) == [False, False, False, True, True]
    assert column(spark, R.is_text, [b"abc", b"a\0b", b"x" * 600_000], "binary") == [True, False, False]


def test_scopes():
    conf = ("space", "page")
    assert R.scopes(conf, space="A, B") == [R.Scope("space", ("A",)), R.Scope("space", ("B",))]
    assert R.scopes(conf, page="1,2", descendants=True) == [R.Scope("pages", ("1", "2"), True)]
    assert R.scopes(conf)[0].cursor("confluence") == "confluence" and R.Scope("space", ("A",)).cursor("c") == "c:space:A"
    assert R.scopes(conf, query="type = page")[0].predicate() == "(type = page)" and R.Scope("pages", ("1",)).cursor("c") is None
    assert R.Scope("query", ("x",)).cursor("jira") == "jira:query:11f6ad8ec52a"
    for bad in ({"space": "A", "page": "1"}, {"space": "a b"}, {"descendants": True}, {"space": "A", "reconcile": True}, {"issue": "X-1"}):
        with pytest.raises(ValueError):
            R.scopes(conf, **bad)


def test_listing_and_retries():
    lists = iter([["a"], ["a", "b"], ["b", "a"]])
    assert R.stable(lambda: next(lists)) == (["a", "b"], True)
    lists = iter([["a"], ["b"], ["c"]])
    assert R.stable(lambda: next(lists)) == (["c"], False)
    assert R.backoff(3, rand=lambda: 0.5) == 4 and R.backoff(10, rand=lambda: 1.0) == 60 and R.backoff(0, after=7) == 7
    tries, waits = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return "ok"

    assert R.retried(call, sleep=waits.append, rand=lambda: 1.0) == "ok" and waits == [1, 2]
    with pytest.raises(OSError):
        R.retried(lambda: (_ for _ in ()).throw(OSError()), attempts=2)


def test_canonical_paths(spark):
    values = ["a/b.md", "./a//b/../c.md", "a\\b.md", "", None, "/etc", "C:\\x", "../x", "a/../../x", ".", "a\tb", "cafe\u0301.md", "a/.."]
    got = column(spark, paths.canonical, values)
    assert [(r["path"], r["reason"]) for r in got] == [
        ("a/b.md", None), ("a/c.md", None), ("a/b.md", None), (None, "empty"), (None, "empty"), (None, "absolute"), (None, "absolute"), (None, "escapes-root"), (None, "escapes-root"),
        (None, "escapes-root"), (None, "control-character"), ("caf\u00e9.md", None), (None, "escapes-root")]
    got = column(spark, lambda c: paths.link_target(F.lit("docs/x"), c), ["../y.md#part", "a%20b.md", "a%2520b", "%zz", "#top", "https://h/x", "a+b.md"])
    assert [(r["path"], r["reason"]) for r in got] == [("docs/y.md", None), ("docs/x/a b.md", None), (None, "encoded"), (None, "encoded"), (None, "empty"), (None, "absolute"), ("docs/x/a+b.md", None)]


def test_front_matter(spark):
    note = "---\nid: n-1\ntitle: 'My note'\ntags: [a, \"b c\"]\naliases:\n  - one\n  # no\n  - two\nother:\n  - x\n---\nBody\n"
    r = column(spark, notes.front_matter, [note, "no matter", "---\nid: x\n", "---\n? y\n---\nz", None])
    assert (r[0]["body"], r[0]["id"], r[0]["title"], r[0]["tags"], r[0]["aliases"], r[0]["error"]) == ("Body\n", "n-1", "My note", ["a", "b c"], ["one", "two"], None)
    assert [x["error"] for x in r[1:]] == [None, "not terminated", "unsupported syntax", None] and r[3]["body"] == "---\n? y\n---\nz"
    assert notes.parse("---\n" + "k: v\n" * 65 + "---\n")["error"] == "too many keys"
    assert notes.parse("---\ntags:\n" + "- v\n" * 65 + "---\n")["error"] == "list too long"
    assert notes.parse("---\ntitle: " + "x" * 17_000 + "\n---\n")["error"] == "too long"


def test_html_to_markdown():
    page = "<h1>T &amp; U</h1><script>x</script><p>A <b>bold</b>\n <a href='/x'>link</a> and <code>c</code>.</p><ul><li>one<li>two<ol><li>deep</ol></ul><pre>a  b\n c</pre><table><tr><th>k<th>v|w</tr><tr><td>1</td></tr></table><blockquote><p>said</p></blockquote><img src=i.png alt=I>"
    assert htmlmd.markdown_of(page).split("\n\n") == ["# T & U", "A **bold** [link](/x) and `c`.", "- one\n- two\n  1. deep", "```\na  b\n c\n```", "| k | v\\|w |\n| --- | --- |\n| 1 |  |", "> said", "![I](i.png)"]
    assert htmlmd.markdown_of(None) == ""


FILES = [
    ("code:r:src/a.ts", "r", "src/a.ts", "import { x } from './lib/b.ts'\nexport class Foo {\n  const bar = require('../c')\n}\n// PAY-12\nit('works', () => 1)"),
    ("code:r:src/a.test.py", "r", "src/a.test.py", "def run():\n    return 'ok now'"),
    ("code:r:x.bin", "r", "x.bin", "class Foo"),
]


def files(spark):
    return spark.createDataFrame(FILES, "id string, repo string, path string, body string")


def test_code_index(spark):
    got = {(r["id"], r["kind"], r["raw_value"], r["line"], r["symbol_kind"]) for r in code.code_index(files(spark)).collect()}
    a, b = FILES[0][0], FILES[1][0]
    assert got == {
        (a, "path", "src/a.ts", 1, None), (a, "import", "./lib/b.ts", 1, None), (a, "literal", "./lib/b.ts", 1, None), (a, "symbol", "Foo", 2, "class"), (a, "export", "export class Foo {", 2, None),
        (a, "symbol", "bar", 3, "const"), (a, "import", "../c", 3, None), (a, "literal", "../c", 3, None), (a, "literal", "works", 6, None), (a, "test", "src/a.ts", 6, None),
        (b, "path", "src/a.test.py", 1, None), (b, "symbol", "run", 1, "def"), (b, "test", "src/a.test.py", 1, None), (b, "test", "src/a.test.py", 2, None), (b, "literal", "ok now", 2, None)}


def test_code_documents_and_lookup(spark, monkeypatch):
    d = {r["title"]: r for r in code.normalize(files(spark)).collect()}
    assert [tuple(x) for x in d["src/a.ts"]["links"]] == [("jira:issue:PAY-12", "references"), ("code:r:src/lib/b", "imports"), ("code:r:c", "imports")]
    assert d["src/a.ts"]["hierarchy"] == ["r", "src"] and d["src/a.ts"]["language"] == "typescript" and d["x.bin"]["language"] is None
    q = spark.createDataFrame([("q1", "FOO"), ("q2", "src/a.test.py"), ("q3", "none")], "query_id string, query string")
    got = sorted((r["query_id"], r["path"], r["line"], r["kind"]) for r in code.lookup(q, code.code_index(files(spark)), files(spark)).collect())
    assert got == [("q1", "src/a.ts", 2, "symbol"), ("q2", "src/a.test.py", 1, "path"), ("q2", "src/a.test.py", 1, "test"), ("q2", "src/a.test.py", 2, "test")]
    monkeypatch.setattr(code, "BUDGET", 70)
    assert code.lookup(q, code.code_index(files(spark)), files(spark)).where("query_id = 'q2'").count() == 2
    m = spark.createDataFrame([("q", "d", "a", True, True, 1.0), ("q", "d", "b", False, False, 0.0), ("q", "e", "a", False, True, 0.5)], "query_id string, id string, term string, definition boolean, exact boolean, factor double")
    assert {r["id"]: r["score"] for r in code.score(m).collect()} == {"d": 7800.0, "e": 4550.0}


def test_embedders(spark):
    assert embed.fnv(np.frombuffer("a".encode("utf-16-le"), np.uint16)) == 0xE40C292C
    e = embed.embedder("fake", dim=8)
    v = e.embed(["x", "y", "x"])
    assert v.shape == (3, 8) and (v[0] == v[2]).all() and np.allclose((v**2).sum(1), 1, atol=1e-6)
    chunks = spark.createDataFrame([("a", 0, "H", "text " * 400), ("a", 1, "H", "short"), ("b", 0, "", "z")], "id string, seq int, heading string, text string")
    have = spark.createDataFrame([("a", 1, e.id), ("b", 0, "other")], "id string, seq int, model string")
    got = embed.backfill(chunks, have, e).collect()
    assert sorted((r["id"], r["seq"], r["ord"]) for r in got) == [("a", 0, 0), ("a", 0, 1), ("a", 0, 2), ("b", 0, 0)] and embed.backfill(chunks, have, e, again=True).count() == 5
    data = [("p", np.array([3, 4], "<f4").tobytes()), ("q", b"abc"), ("r", None), ("s", np.zeros(2, "<f4").tobytes())]
    vecs = {r["id"]: r["vec"] for r in embed.decoded(spark.createDataFrame(data, "id string, data binary")).collect()}
    assert np.allclose(vecs["p"], [0.6, 0.8]) and vecs["q"] is None and vecs["r"] is None and vecs["s"] == [0.0, 0.0]
    with pytest.raises(ValueError):
        embed.embedder("no-such")
