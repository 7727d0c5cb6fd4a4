import json
import subprocess

import pytest
from pyspark.sql import functions as F

from marlstone import tools
from marlstone.functions import headline, issues
from marlstone.sources import files, rules
from marlstone.sources.catalog import view
from marlstone.sources.fielded import fielded
from marlstone.streaming import events

SF = "/root/testdata/sf0.001"
WHO = tools.Viewer("user2", "default", ("g0", "g1"))


def test_calls_are_checked_and_recorded(spark, monkeypatch):
    log: list = []
    ask = lambda name, who=WHO, **a: tools.call(spark, SF, who, name, log, **a)
    assert ask("none")["error"] == "unknown tool none" and "missing" in ask("get_doc")["error"] and "type int" in ask("search_docs", query="a", limit="x")["error"]
    assert ask("get_doc", who=None, id="doc:2")["error"] == "no trusted viewer" and "group" in ask("refresh_doc", id="doc:2")["error"]
    monkeypatch.setitem(tools.TOOLS, "gated", tools.Tool("gated", "", {}, lambda *a: {}, ("MARLSTONE_NO_SUCH",)))
    assert "not configured" in ask("gated")["error"]
    monkeypatch.setitem(tools.READERS, "doc", lambda i: "unchanged")
    assert ask("refresh_doc", who=WHO._replace(groups=("refresh",)), id="doc:2") == {"id": "doc:2", "status": "unchanged"}
    assert ask("get_doc", id="doc:2")["total_sections"] >= 1 and "section" in ask("get_doc", id="doc:2", section=99)["error"] and "no document" in ask("get_doc", id="doc:3")["error"]
    edges = ask("expand", id="doc:2")["edges"]
    assert edges and all(e["direction"] in ("in", "out") for e in edges)
    rows = tools.audit(spark, log).collect()
    assert len(rows) == 11 and [r["ok"] for r in rows].count(True) == 3 and rows[-1]["result_count"] == len(edges)


def common(spark, n=2):
    """The most frequent indexed words."""
    return [r["stem"] for r in fielded(spark, SF).terms.where("length(stem) > 3").orderBy(F.desc("df"), "stem").limit(n).collect()]


def test_search_answers(spark):
    a, b = common(spark)
    r = tools.call(spark, SF, WHO, "search_docs", query=f"{a} {b} -zzz")
    assert 0 < len(r["results"]) <= 8 and [x["position"] for x in r["results"]] == list(range(1, len(r["results"]) + 1))
    assert all(x["evidence_verified"] for x in r["results"]) and any("**" in x["snippet"] for x in r["results"]) and r["top_score"] >= r["results"][-1]["score"] and r["score_gap"] >= 0
    assert r["route"] == "docs" and "fts_prose" in r["executor"] and r["unverified_excluded"] == 0 and {c["family"] for c in r["coverage"]["sources"]} == {"code", "confluence", "jira"} and not r["coverage"]["complete"]
    left = tools.call(spark, SF, WHO, "search_docs", query=f"{a} -{b}")["results"]
    assert all(f"**{b}**" not in x["snippet"].lower() for x in left)
    only = tools.call(spark, SF, WHO, "search_docs", query=a, sources=["jira", "wiki"])
    assert {x["source"] for x in only["results"]} == {"jira"} and only["coverage"]["requested_absent"] == ["wiki"]
    none = tools.call(spark, SF, WHO, "search_docs", query="  ")
    assert none["results"] == [] and none["executor"] == "none" and none["top_score"] is None and none["n_above_threshold"] == 0


def test_documents_by_section(spark, monkeypatch):
    monkeypatch.setattr(tools, "SECTION", 10)
    r = tools.call(spark, SF, WHO, "get_doc", id="doc:2", section=1)
    assert len(r["body"]) == 10 and r["total_sections"] > 2
    assert "hint" in tools.call(spark, SF, WHO, "get_doc", id="doc:46") and "body" in tools.call(spark, SF, WHO, "get_doc", id="doc:46", include_superseded=True)
    assert "hint" not in tools.call(spark, SF, WHO, "get_doc", id="doc:3")


def test_edges_fail_closed_at_both_ends(spark):
    nobody = tools.Viewer("nobody", "default")
    for n in (2, 12, 24):
        assert tools.call(spark, SF, nobody, "expand", id=f"doc:{n}")["edges"] == []
    for n in (2, 6, 12):
        for e in tools.call(spark, SF, WHO, "expand", id=f"doc:{n}")["edges"]:
            there = view(spark, SF, "docs").where((F.col("id") == e["id"]) & (F.col("tenant") == "default")).count()
            assert e["ingested"] == bool(there) and (not there or "body" in tools.call(spark, SF, WHO, "get_doc", id=e["id"]))


def test_code_and_logs(spark, monkeypatch):
    r = tools.call(spark, SF, WHO, "search_code", query="c6")
    assert [(x["line"], x["kind"]) for x in r["results"]] == [(2, "symbol")] and "class C6" in r["results"][0]["text"] and [c["family"] for c in r["coverage"]["sources"]] == ["code"]
    assert tools.call(spark, SF, WHO, "search_code", query="c6", repo="r1")["results"] == [] and "kind" in tools.call(spark, SF, WHO, "search_code", query="c6", kind="x")["error"]
    assert tools.call(spark, SF, WHO, "search_code", query="c3")["results"] == []  # another tenant's
    near = tools.call(spark, SF, WHO, "search_code", query="class f6.ts")
    assert near["results"] == [] and near["similar"][0]["path"] == "src/f6.ts" and near["similar"][0]["score"] > near["similar"][-1]["score"]
    assert "not configured" in tools.call(spark, SF, WHO, "fetch_logs", query="x")["error"]
    monkeypatch.setenv("MARLSTONE_LOGS_URL", "https://h.example")
    assert "no reader" in tools.call(spark, SF, WHO, "fetch_logs", query="x")["error"]
    monkeypatch.setitem(tools.READERS, "logs", lambda query, minutes, index: [{"ts": f"2024-01-01T00:{k:02}", "message": f"{query} https://h.example/?token=s{k}"} for k in range(minutes)])
    got = tools.call(spark, SF, WHO, "fetch_logs", query="x", limit=3)["results"]
    assert [g["ts"][-2:] for g in got] == ["59", "58", "57"] and all("token=***" in g["message"] for g in got)


def test_manifest_and_jobs():
    m = {t["name"]: t for t in json.loads(json.dumps(tools.manifest()))}
    assert m["search_docs"]["inputSchema"]["required"] == ["query"] and m["search_docs"]["inputSchema"]["properties"]["limit"] == {"type": "integer", "default": 8}
    tools.JOBS.clear()
    tools.job_type("ingest", source=str, full=bool)
    assert tools.job("ingest", {"source": "x", "full": True})["type"] == "ingest"
    for bad in (("none", {}), ("ingest", {"source": 1, "full": True}), ("ingest", {"source": "x"}), ("ingest", {"source": "x", "full": True, "more": 1})):
        with pytest.raises(ValueError):
            tools.job(*bad)


def test_headlines(spark):
    text = " ".join(["lead"] * 60 + ["alpha"] + ["mid"] * 80 + ["beta", "alpha"] + ["tail"] * 60)
    said, cut = headline.headline_of(["alpha", "Beta"], text)
    assert cut and said.count("**") == 4 and "**beta** **alpha**" in said and len(said.split()) <= 45
    said, _ = headline.headline_of(["alpha", "gamma"], text + " gamma " + "end " * 40)
    assert headline.GAP in said and said.index("alpha") < said.index("gamma")
    assert headline.headline_of(["x"], "one two") == ("one two", False) and headline.headline_of([], None) == ("", False)
    r = spark.createDataFrame([(["b"], "a b c")], "t array<string>, s string").select(headline.headline(F.col("t"), F.col("s")).alias("h")).first()["h"]
    assert tuple(r) == ("a **b** c", False)


def test_issues(spark):
    fields = {"summary": "Charge fails", "status": "Open", "issuetype": "Bug", "labels": ["payments", "incident"], "description": "See PAY-42 and OPS-9.", "parent": "PAY-1",
              "comments": [{"author": "kim", "body": "like OPS-3", "visibility": None}, {"author": "legal", "body": "secret PAY-77", "visibility": {"type": "role", "value": "Legal"}}],
              "issue_links": [{"type": "blocks", "key": "PAY-42"}, {"type": "relates to", "key": "PAY-100"}]}
    rows = [json.dumps({"key": "PAY-100", "fields": fields}), json.dumps({"key": "PAY-2", "fields": {"summary": "s", "status": "Done"}})]
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", "struct<" + issues.ISSUE.replace("key string", "key:string").replace("url string", "url:string").replace("fields struct", "fields:struct") + ">").alias("x")).select("x.*")
    got = {r["id"]: r for r in issues.normalize(df).collect()}
    r = got["jira:issue:PAY-100"]
    assert r["title"] == "PAY-100: Charge fails" and r["restricted"] == 1 and "secret" not in r["body"] and "legal" not in r["body"]
    assert r["body"].split("\n\n") == ["**Status:** Open\n**Type:** Bug\n**Labels:** payments, incident\n**Parent:** PAY-1\n**Restricted comments omitted:** 1", "See PAY-42 and OPS-9.", "## Comment — kim", "like OPS-3"]
    assert [tuple(x) for x in r["links"]] == [("jira:issue:PAY-42", "blocks"), ("jira:issue:PAY-1", "parent"), ("jira:issue:OPS-9", "references"), ("jira:issue:OPS-3", "references")]
    assert got["jira:issue:PAY-2"]["body"] == "**Status:** Done" and got["jira:issue:PAY-2"]["links"] == []


def test_snapshot(spark, tmp_path):
    for name, body in {"a.md": "---\nid: n1\ntags: [x]\n---\n# A\n", "s/b.md": "text", "c.md": "---\nid: n2\n---\n", "d.md": "---\nid: n2\n---\n", "Case.md": "1", "e.md": "---\nid: x\n", "skip.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "nul.md").write_bytes(b"a\0b")
    (tmp_path / "case.md").write_text("2")
    docs, faults, complete = files.snapshot(spark, str(tmp_path))
    assert {(r["id"], r["title"]) for r in docs.collect()} == {("n1", "A"), ("s/b.md", "b")} and not complete
    assert {(r["path"], r["reason"]) for r in faults.collect()} == {("c.md", "duplicate-id"), ("d.md", "duplicate-id"), ("Case.md", "case-collision"), ("case.md", "case-collision"), ("e.md", "front-matter"), ("bad.md", "not-utf8"), ("nul.md", "not-text")}
    assert files.snapshot(spark, str(tmp_path / "s"))[2]


def test_repository(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    for name in ("a.ts", "b.ts"):
        (tmp_path / name).write_text(name)
    git("add", ".")
    git("commit", "-qm", "one")
    df, first = files.repository(spark, str(tmp_path))
    assert sorted((r["path"], r["status"]) for r in df.collect()) == [("a.ts", "A"), ("b.ts", "A")] and all(r["committed"] for r in df.collect())
    git("mv", "a.ts", "c.ts")
    (tmp_path / "b.ts").write_text("new")
    git("commit", "-qam", "two")
    df, head = files.repository(spark, str(tmp_path), first)
    assert sorted((r["path"], r["status"]) for r in df.collect()) == [("a.ts", "D"), ("b.ts", "M"), ("c.ts", "A")] and head != first
    assert files.repository(spark, str(tmp_path), head)[0].count() == 0 and files.repository(spark, str(tmp_path), "0" * 40, include=("b.*",))[0].count() == 1


def test_incremental_listing():
    asked = []

    def get(params):
        asked.append(params)
        return {"results": [{"id": k} for k in range(params["start"], min(params["start"] + params["limit"], 70))]}

    items, ok = files.incremental(get, lambda k: {"id": k}, rules.Scope("space", ("A",)), "2024-01-01")
    assert ok and len(items) == 70 and asked[0]["query"] == 'space = "A" and lastmodified >= "2024-01-01"order by lastmodified asc, id asc'.replace('"order', '" order') and len(asked) == 4


def test_upserts_go_on_where_the_last_run_ended(spark, tmp_path):
    src, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    read = lambda: spark.readStream.schema("id string, content_hash string").parquet(src)
    put = lambda rows: spark.createDataFrame(rows, "id string, content_hash string").coalesce(1).write.mode("append").parquet(src)
    state = lambda: {r["id"]: (r["content_hash"], r["revision"]) for r in events.upsert_into(spark, read(), out).collect()}
    put([("a", "1"), ("b", "1")])
    assert state() == {"a": ("1", 1), "b": ("1", 1)}
    put([("a", "2"), ("c", "1"), ("b", "1")])
    assert state() == {"a": ("2", 2), "b": ("1", 1), "c": ("1", 1)}
    assert state() == {"a": ("2", 2), "b": ("1", 1), "c": ("1", 1)}
