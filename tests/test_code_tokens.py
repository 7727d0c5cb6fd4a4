"""Tokens of code: the same rules on both sides, held against a plain version; the score by rule, never by count."""

import random
import re

from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import code

rng = random.Random(8)


def plain_subtokens(name):
    out = []
    for run in re.split(r"[^A-Za-z0-9]+", name):
        for part in re.split(r"(?<=[A-Z]{2})(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])", run):
            out.append(part)
            if re.search("[A-Za-z]", part) and re.search("[0-9]", part):
                out += re.split(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", part)
    return [t for t in dict.fromkeys(x.lower() for x in out) if len(t) >= 2]


def plain_path(path):
    clean = path.lstrip("/")
    seg = [x for x in clean.split("/") if x]
    out = [clean] * bool(seg) + ["/".join(seg[k:]) for k in range(1, len(seg))] + seg + ([re.sub(r"\.[^.]+$", "", seg[-1])] if seg else [])
    return [t for t in dict.fromkeys([x.lower() for x in out] + plain_subtokens(clean)) if len(t) >= 2]


def one(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_known_splits(spark):
    known = {"parseHTTPResponse": ["parse", "http", "response"], "IOError": ["io", "error"], "getURLFromID": ["get", "url", "from", "id"], "MAX_RETRY_COUNT": ["max", "retry", "count"],
             "OAuth2Client": ["oauth2", "oauth", "client"], "sha256Hash": ["sha256", "sha", "256", "hash"], "": [], "a": []}
    df = spark.createDataFrame([(k,) for k in known], "s string")
    assert one(df, text.subtokens(F.col("s"))) == list(known.values())
    paths = ["src/retry/scheduler.py", "/a/b", "scheduler.py", "src/parseHTTP2.test.ts", "", "///", "x"]
    got = one(spark.createDataFrame([(p,) for p in paths], "s string"), text.path_tokens(F.col("s")))
    assert [set(g) for g in got] == [set(plain_path(p)) for p in paths] and "scheduler.py" in got[0] and "retry/scheduler.py" in got[0]


def test_both_sides_make_the_same_tokens(spark):
    letters = "aAbBzZ09_$"
    names = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    df = spark.createDataFrame([(n, "/".join(rng.choice(names) for _ in range(rng.randrange(1, 4))) + ".ts") for n in names], "name string, path string")
    rows = df.select("name", "path", text.tokenize(F.col("name")).alias("t"), text.code_tokens(F.col("path"), F.concat(F.lit("const "), "name", F.lit(" = 1"))).alias("c"), text.query_tokens(F.col("name")).alias("q"), text.query_tokens(F.col("path")).alias("p")).collect()
    for r in rows:
        whole = [r["name"].lower()] if len(r["name"]) >= 2 else []
        assert r["t"] == list(dict.fromkeys(whole + plain_subtokens(r["name"]))) == r["q"]
        assert set(r["p"]) >= set(plain_path(r["path"])) and set(plain_path(r["path"])) <= set(r["c"])
        if re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", r["name"]):
            assert set(r["q"]) <= set(r["c"])


def test_a_definition_beats_many_mentions(spark):
    rows = [("many", "src/uses.ts", "handler handler\n" * 40 + "const handlerCount = 1"), ("defines", "src/retry.ts", "// it\nexport class retryHandler {}"), ("fn", "lib/other.ts", "function handler() {}"), ("path", "src/handler/x.ts", "nothing")]
    files = spark.createDataFrame(rows, "id string, path string, body string")
    tokens = code.token_index(files, code.code_index(files))
    ask = lambda q, seen=None: {r["id"]: r for r in code.ranked(spark.createDataFrame([("q", q)], "query_id string, query string"), tokens, seen).collect()}
    got = ask("handler")
    assert {k: r["score"] for k, r in got.items()} == {"fn": 7000 + 500 + 700.0, "many": 7000 + 500 + 100.0, "defines": 4000 + 50 + 1000.0, "path": 4000 + 50 + 100.0} and got["fn"]["line"] == 1 and got["defines"]["line"] == 2
    got = ask("retryHandler")
    assert got["defines"]["score"] == 7000 + 500 + 1000 + (1 - 1 / 3) * 400 and got["defines"]["line"] == 2
    assert set(ask("handler/x.ts")) >= {"path"} and ask("handler/x.ts")["path"]["score"] >= 7000
    assert set(ask("handler", files.where("id <> 'fn'"))) == {"many", "defines", "path"} and ask("zzzUnseen") == {} and ask("") == {}


def test_lookups_take_filters(spark):
    files = spark.createDataFrame([("a", "r1", "src/a.ts", "class Foo {}\nlet s = 'Foo'"), ("b", "r2", "src/b.ts", "class Foo {}")], "id string, repo string, path string, body string")
    index = code.code_index(files)
    ask = lambda kind=None, repo=None, path=None, f=files: sorted((r["id"], r["line"], r["kind"]) for r in code.lookup(spark.createDataFrame([("q", "FOO", kind, repo, path)], "query_id string, query string, kind string, repo string, path string"), index, f).collect())
    assert ask() == [("a", 1, "symbol"), ("a", 2, "literal"), ("b", 1, "symbol")]
    assert ask(kind="literal") == [("a", 2, "literal")] and ask(repo="r2") == [("b", 1, "symbol")] and ask(path="src/a.ts", kind="symbol") == [("a", 1, "symbol")]
    assert ask(f=files.where("id = 'b'")) == [("b", 1, "symbol")]
