"""The REST data source against a stub service: ranges, filters, retries, and a stream that holds its offset."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

import pytest
from pyspark.errors import StreamingQueryException

from marlstone.functions import issues as issue_functions
from marlstone.functions import pages as page_functions
from marlstone.sources import rest, rules


class Stub:
    def __init__(self):
        self.items, self.asked, self.broken, self.flaky = {}, [], set(), set()
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                at = urlparse(self.path)
                q = {k: v[0] for k, v in parse_qs(at.query).items()}
                stub.asked.append((at.path, q, self.headers.get("Authorization")))
                status, body = stub.answer(at.path, q)
                data = json.dumps(body).encode()
                self.send_response(status)
                if status == 503:
                    self.send_header("Retry-After", "0")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def when(self, item):
        return item["version"]["when"] if "version" in item else item["fields"]["updated"]

    def answer(self, path, q):
        query = q.get("cql") or q.get("jql")
        if query is None:
            key = unquote(path.rsplit("/", 1)[1])
            if key in self.broken:
                return 500, {}
            if key in self.flaky:
                self.flaky.discard(key)
                return 503, {}
            return (200, self.items[key]) if key in self.items else (404, {})
        found = sorted(self.items.values(), key=lambda x: (self.when(x), str(x.get("id", x.get("key")))))
        minute = lambda x: self.when(x)[:16].replace("T", " ")
        for op, t in re.findall(r'(?:lastmodified|updated) (>=|<) "([^"]+)"', query):
            found = [x for x in found if (minute(x) >= t if op == ">=" else minute(x) < t)]
        if m := re.search(r"ancestor = (\d+)", query):
            found = [x for x in found if m[1] in x["under"]]
        if " desc" in query:
            found = found[::-1]
        start, size = int(q.get("start") or q.get("startAt") or 0), int(q.get("limit") or q.get("maxResults"))
        return 200, {"results" if "cql" in q else "issues": found[start : start + size]}

    def page(self, n, minute, **more):
        self.items[str(n)] = {
            "id": str(n), "title": f"Page {n}", "space": {"name": "Docs"}, "ancestors": [{"title": "Top"}], "version": {"when": f"2024-01-01T{minute // 60:02}:{minute % 60:02}:30.000Z", "by": {"displayName": "kim"}},
            "history": {"createdDate": "2023-01-01"}, "metadata": {"labels": {"results": [{"name": "runbook"}, {"label": "x"}, {}]}}, "body": {"storage": {"value": f"<h1>T{n}</h1><p>text</p>"}}, "_links": {"webui": f"/x/{n}"}, "under": [],
        } | more


@pytest.fixture
def stub():
    s = Stub()
    yield s
    s.server.shutdown()


@pytest.fixture
def spark(spark, monkeypatch):
    spark.dataSource.register(rest.RestSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def read(spark, stub, **options):
    return spark.read.format("rest").options(url=stub.url, kind="pages", ranges="4", attempts="2", **options).load()


def test_pages_are_read_in_ranges_and_normalised(spark, stub):
    for n in range(130):
        stub.page(n, n * 7 % 600, under=["5"] if n % 10 == 0 else [])
    stub.flaky.add("12")
    got = read(spark, stub)
    assert got.rdd.getNumPartitions() == 4 and sorted(int(r["key"]) for r in got.collect()) == list(range(130))
    listings = [q for p, q, _ in stub.asked if p.endswith("/search") and q["limit"] == "50"]
    assert len({q["cql"] for q in listings}) == 4 and all("type=page and lastmodified >=" in q["cql"] for q in listings)
    r = page_functions.normalize(rest.pages(got.where("key = '7'"), stub.url)).first()
    assert r["id"] == "confluence:page:7" and "**Labels:** runbook, x" in r["body"] and "# T7" in r["body"] and r["url"] == f"{stub.url}/x/7"
    assert sorted(r["key"] for r in read(spark, stub, scope="ancestor = 5").collect()) == sorted(str(n) for n in range(0, 130, 10))
    stub.asked.clear()
    ids = read(spark, stub, ids="true").collect()
    assert len(ids) == 130 and all(r["json"] is None for r in ids) and all(p.endswith("/search") for p, _, _ in stub.asked)


def test_filters_go_to_the_service(spark, stub):
    for n in range(100):
        stub.page(n, n)
    stub.asked.clear()
    got = read(spark, stub).where("updated >= '2024-01-01T01:30:00.000000Z'").collect()
    assert sorted(int(r["key"]) for r in got) == list(range(90, 100)) and len([p for p, _, _ in stub.asked if not p.endswith("/search")]) == 10
    stub.asked.clear()
    got = read(spark, stub).where("key IN ('3', '4', '777')").collect()
    assert sorted(r["key"] for r in got) == ["3", "4"] and not [p for p, _, _ in stub.asked if p.endswith("/search")]
    assert read(spark, stub).where("updated > '2030'").collect() == []


def test_nothing_and_failures(spark, stub, monkeypatch):
    assert read(spark, stub).collect() == []
    stub.page(1, 5)
    monkeypatch.setenv("STUB_TOKEN", "t0k")
    read(spark, stub, token_env="STUB_TOKEN").collect()
    assert all("t0k" not in str(q) for _, q, _ in stub.asked)
    stub.broken.add("1")
    with pytest.raises(Exception, match="HTTP 500"):
        read(spark, stub).collect()


def test_issues(spark, stub):
    fields = {"summary": "Fails", "status": {"name": "Open"}, "updated": "2024-01-01T00:05:00.000+0000", "labels": ["a"], "components": [{"name": "pay"}, {}], "fixVersions": [], "parent": {"key": "PAY-1"},
              "comment": {"comments": [{"author": {"displayName": "kim"}, "body": "seen"}, {"body": "no", "visibility": {"type": "role", "value": "x"}}]},
              "issuelinks": [{"type": {"name": "Blocks", "inward": "is blocked by", "outward": "blocks"}, "inwardIssue": {"key": "PAY-7"}}, {"type": {"outward": "clones"}, "outwardIssue": {"key": "PAY-8"}}, {"type": {"name": "z"}}]}
    stub.items["PAY-2"] = {"id": "2", "key": "PAY-2", "fields": fields}
    raw = spark.read.format("rest").options(url=stub.url, kind="issues", scope="project = PAY").load()
    assert [(r["key"], r["updated"]) for r in raw.collect()] == [("PAY-2", "2024-01-01T00:05:00.000000Z")]
    assert any(q.get("jql", "").startswith("project = PAY and updated >=") for _, q, _ in stub.asked)
    r = issue_functions.normalize(rest.issues(raw, stub.url)).first()
    assert r["id"] == "jira:issue:PAY-2" and r["restricted"] == 1 and "**Components:** pay" in r["body"] and "seen" in r["body"] and r["url"].endswith("/browse/PAY-2")
    assert [tuple(x) for x in r["links"]] == [("jira:issue:PAY-7", "is blocked by"), ("jira:issue:PAY-8", "clones"), ("jira:issue:PAY-1", "parent")]


def test_a_stream_goes_on_and_holds_its_offset_before_a_failed_item(spark, stub, tmp_path):
    got: list = []

    def run():
        s = spark.readStream.format("rest").options(url=stub.url, kind="pages", attempts="1", ranges="2").load()
        q = s.writeStream.foreachBatch(lambda df, n: got.append(sorted(r["key"] for r in df.select("key").collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    for n in range(5):
        stub.page(n, n)
    run()
    assert sum(got, []) == ["0", "1", "2", "3", "4"]
    got.clear()
    stub.page(7, 30)
    stub.page(8, 31)
    stub.broken.add("7")
    with pytest.raises(StreamingQueryException):
        run()
    assert sum(got, []) == []
    stub.broken.clear()
    run()
    assert sum(got, []) == ["4", "7", "8"]  # the last change before comes once more
    got.clear()
    run()
    assert sum(got, []) == []


def test_retries():
    hint = lambda **how: rules.backoff(3, rand=lambda: 0.5, **how)
    assert hint() == 4 and hint(after=1) == 4 and hint(after=9) == 9 and hint(after=900) == 60 and rules.backoff(20, rand=lambda: 1) == 60
    again = {408: True, 425: True, 429: True, 500: True, 503: True, 599: True, 400: False, 401: False, 404: False, 600: False}
    assert {s: rules.retryable(rules.HttpError(s)) for s in again} == again
    assert rules.retryable(TimeoutError()) and rules.retryable(ConnectionResetError()) and not rules.retryable(ValueError())
    assert rules.retry_after("7") == 7 and rules.retry_after("-1") is None and rules.retry_after(None) is None and rules.retry_after("x") is None
    assert rules.retry_after("Thu, 01 Jan 1970 00:01:40 GMT", lambda: 40) == 60 and rules.retry_after("Thu, 01 Jan 1970 00:00:10 GMT", lambda: 40) is None
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise rules.HttpError(429, retry_after=5)
        return "done"

    assert rules.retried(call, sleep=waits.append, rand=lambda: 0.5) == "done" and waits == [5, 5]
    with pytest.raises(rules.HttpError):
        rules.retried(lambda: (_ for _ in ()).throw(rules.HttpError(404)), sleep=waits.append)
    assert len(waits) == 2
