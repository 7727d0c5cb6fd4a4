"""Pages and issues of a REST service as a Spark data source: read in ranges of time, in batch or as a stream.

``spark.dataSource.register(RestSource)``, then ``spark.read.format("rest")`` or ``spark.readStream.format("rest")`` with options:

* ``kind``: pages or issues; ``url``: the service; ``scope``: a clause of its query language.
* ``token_env``: the variable, on the executors, that holds the token. No credential is an option, so none shows in a plan.
* ``ranges``: how many ranges a batch is read in; ``ids``: true for keys alone, as reconciling asks for.
* ``attempts``: of each call.

The driver asks for the first and the last change alone. Each task lists its own range until two scans agree, then fetches item by
item. A row is key, updated and json, the item as the service gave it; ``pages`` and ``issues`` flatten it. Bounds on updated and
lists of keys in a filter go to the service, if ``spark.sql.python.filterPushdown.enabled`` is set.

As a stream, the offset is the time of the last change. An item that cannot be fetched fails its batch, so the offset stays before
it and the next start asks again. Changes at an offset's own time come once more after it, since the service may give more of the
same time later: the sink's hash gate takes them for what they are.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from marlstone.functions import htmlmd
from marlstone.sources import rules

SIZE = 50
#: kind -> how its service lists and gives items
KINDS = {
    "pages": {
        "list": "/rest/api/content/search", "query": "cql", "items": "results", "size": "limit", "start": "start", "base": "type=page", "time": "lastmodified", "key": "id",
        "listed": {"expand": "version"}, "one": "/rest/api/content/", "whole": {"expand": "body.storage,ancestors,version,space,history,metadata.labels"},
        "when": lambda x: (x.get("version") or {}).get("when"),
    },
    "issues": {
        "list": "/rest/api/2/search", "query": "jql", "items": "issues", "size": "maxResults", "start": "startAt", "base": None, "time": "updated", "key": "key", "listed": {"fields": "key,updated"}, "one": "/rest/api/2/issue/",
        "whole": {"fields": "summary,status,issuetype,project,reporter,created,updated,description,comment,assignee,labels,priority,resolution,resolutiondate,components,fixVersions,parent,issuelinks"},
        "when": lambda x: (x.get("fields") or {}).get("updated"),
    },
}


def moment(s: str) -> datetime:
    """A time as services write it, in UTC."""
    t = datetime.fromisoformat(s.replace("Z", "+00:00"))
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


def stamp(t: datetime) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%S.%fZ")


class Service:
    def __init__(self, options: dict):
        self.kind = KINDS[options["kind"]]
        self.url, self.scope = options["url"].rstrip("/"), options.get("scope")
        self.token_env, self.attempts = options.get("token_env"), int(options.get("attempts", 5))
        self.ids = str(options.get("ids", "false")).lower() == "true"

    def get(self, path: str, params: dict) -> dict:
        request = urllib.request.Request(f"{self.url}{path}?{urllib.parse.urlencode(params)}", headers={"Accept": "application/json"})
        if self.token_env and os.environ.get(self.token_env):
            request.add_header("Authorization", f"Bearer {os.environ[self.token_env]}")

        def once():
            try:
                with urllib.request.urlopen(request, timeout=60) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                raise rules.HttpError(e.code, e.reason, rules.retry_after(e.headers.get("Retry-After"))) from None

        return rules.retried(once, self.attempts)

    def query(self, since: str | None, until: str | None, order: str) -> str:
        """The query language knows minutes: bounds are widened to them, and held exactly on what comes."""
        k = self.kind
        minute = lambda s, more=0: (moment(s) + timedelta(minutes=more)).strftime("%Y-%m-%d %H:%M")
        clauses = [k["base"], self.scope, since and f'{k["time"]} >= "{minute(since)}"', until and f'{k["time"]} < "{minute(until, 1)}"']
        said = " and ".join(c for c in clauses if c)
        return f"{said} order by {order}".strip()

    def end(self, direction: str) -> str | None:
        """The time of the first (asc) or the last (desc) change."""
        k = self.kind
        found = self.get(k["list"], {k["query"]: self.query(None, None, f"{k['time']} {direction}"), **k["listed"], k["size"]: 1, k["start"]: 0})[k["items"]]
        return stamp(moment(k["when"](found[0]))) if found else None

    def listed(self, since: str, until: str) -> list[tuple[str, str]]:
        """(time, key) of a range, both ends included, from two scans that agree; in the order of time."""
        k = self.kind
        query = self.query(since, until, f"{k['time']} asc, {k['key'] if k['key'] == 'key' else 'id'} asc")

        def scan():
            out, start = [], 0
            while True:
                page = self.get(k["list"], {k["query"]: query, **k["listed"], k["size"]: SIZE, k["start"]: start}).get(k["items"]) or []
                out += [(stamp(moment(k["when"](x))), str(x[k["key"]])) for x in page]
                start += len(page)
                if len(page) < SIZE:
                    return [x for x in out if since <= x[0] <= until]

        found, ok = rules.stable(scan)
        if not ok:
            raise RuntimeError(f"the listing from {since} to {until} does not hold still")
        return found

    def fetched(self, key: str) -> tuple[str, str | None, str]:
        k = self.kind
        item = self.get(k["one"] + urllib.parse.quote(key, safe=""), k["whole"])
        when = k["when"](item)
        return str(item[k["key"]]), when and stamp(moment(when)), json.dumps(item)

    def rows(self, part: Range) -> Iterator[tuple]:
        if part.keys is not None:
            for key in part.keys:
                try:
                    yield (key, None, None) if self.ids else self.fetched(key)
                except rules.HttpError as e:
                    if e.status != 404:
                        raise
            return
        for when, key in self.listed(part.since, part.until):
            yield (key, when, None) if self.ids else self.fetched(key)


class Range(InputPartition):
    def __init__(self, since: str | None = None, until: str | None = None, keys: list | None = None):
        super().__init__((since, until, keys))
        self.since, self.until, self.keys = since, until, keys


def cut(first: str, last: str, parts: int) -> list[Range]:
    """Ranges of equal length that meet without overlap; both ends of each are included."""
    a, b = moment(first), moment(last)
    edges = [a + (b - a) * k / parts for k in range(parts)] + [b + timedelta(microseconds=1)]
    return [Range(stamp(x), stamp(y - timedelta(microseconds=1))) for x, y in zip(edges, edges[1:]) if x < y]


class RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.parts = options, int(options.get("ranges", 16))
        self.least, self.most, self.keys = None, None, None

    def pushFilters(self, filters):
        """Bounds on updated and lists of keys narrow what is asked for; every filter is applied to what comes, too."""
        for f in filters:
            column, value = (f.attribute[0] if len(f.attribute) == 1 else None), getattr(f, "value", None)
            if column == "updated" and isinstance(value, str):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.least = max(self.least or value, value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.most = min(self.most or value, value)
            elif column == "key" and isinstance(f, (EqualTo, In)):
                some = set(map(str, f.value)) if isinstance(f, In) else {str(value)}
                self.keys = some if self.keys is None else self.keys & some
            yield f

    def partitions(self):
        if self.keys is not None:
            return [Range(keys=[k]) for k in sorted(self.keys)] or [Range(keys=[])]
        service = Service(self.options)
        first, last = service.end("asc"), service.end("desc")
        if first is None or last is None:
            return [Range(keys=[])]
        first, last = max(first, self.least or first), min(last, self.most or last)
        return cut(first, last, self.parts) if first <= last else [Range(keys=[])]

    def read(self, partition):
        return Service(self.options).rows(partition)


class RestStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.parts = options, int(options.get("ranges", 4))

    def initialOffset(self) -> dict:
        return {"at": ""}

    def latestOffset(self) -> dict:
        return {"at": Service(self.options).end("desc") or ""}

    def partitions(self, start: dict, end: dict):
        if not end["at"]:
            return [Range(keys=[])]
        since = start["at"] or Service(self.options).end("asc")
        return cut(min(since, end["at"]), end["at"], self.parts)

    def read(self, partition):
        return Service(self.options).rows(partition)

    def commit(self, end: dict) -> None:
        pass


class RestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        return "key string, updated string, json string"

    def reader(self, schema) -> DataSourceReader:
        return RestReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RestStream(dict(self.options))


PAGE = (
    "id string, title string, space struct<name:string>, ancestors array<struct<title:string>>, version struct<when:string, by:struct<displayName:string>>, history struct<createdDate:string>, "
    "metadata struct<labels:struct<results:array<struct<name:string,label:string>>>>, body struct<storage:struct<value:string>>, _links struct<webui:string>"
)
NAMED = "struct<name:string>"
WHO = "struct<displayName:string>"
ISSUE = (
    f"key string, fields struct<summary:string, status:{NAMED}, issuetype:{NAMED}, project:struct<key:string>, reporter:{WHO}, created:string, updated:string, description:string, assignee:{WHO}, labels:array<string>, priority:{NAMED}, "
    f"resolution:{NAMED}, components:array<{NAMED}>, fixVersions:array<{NAMED}>, parent:struct<key:string>, comment:struct<comments:array<struct<author:{WHO}, body:string, visibility:struct<type:string,value:string>>>>, "
    "issuelinks:array<struct<type:struct<name:string,inward:string,outward:string>, inwardIssue:struct<key:string>, outwardIssue:struct<key:string>>>>"
)


def pages(rows: DataFrame, url: str) -> DataFrame:
    """Pages as the normaliser takes them: id, title, url, author, updated, created, ancestors (the space first), acl_groups (none: closed until stamped), labels, body (markdown)."""
    p = rows.select(F.from_json("json", PAGE).alias("p")).select("p.*")
    labels = F.filter(F.transform(F.coalesce("metadata.labels.results", F.array().cast("array<struct<name:string,label:string>>")), lambda x: F.coalesce(x["name"], x["label"])), lambda x: F.coalesce(x, F.lit("")) != "")
    above = F.transform(F.coalesce("ancestors", F.array().cast("array<struct<title:string>>")), lambda x: F.coalesce(x["title"], F.lit("")))
    return p.select(
        "id", "title", F.when(F.coalesce("_links.webui", F.lit("")) != "", F.concat(F.lit(url.rstrip("/")), "_links.webui")).alias("url"), F.col("version.by.displayName").alias("author"), F.col("version.when").alias("updated"),
        F.col("history.createdDate").alias("created"), F.concat(F.array_compact(F.array("space.name")), above).alias("ancestors"), F.array().cast("array<string>").alias("acl_groups"), labels.alias("labels"),
        htmlmd.html_to_markdown(F.coalesce("body.storage.value", F.lit(""))).alias("body"),
    )


def issues(rows: DataFrame, url: str) -> DataFrame:
    """Issues as the normaliser takes them: key, url, fields. A link's label and key come from the same side of it."""
    i = rows.select(F.from_json("json", ISSUE).alias("i")).select("i.*")
    f = lambda name: F.col(f"fields.{name}")
    names = lambda name: F.filter(F.transform(f(name), lambda x: x["name"]), lambda x: F.coalesce(x, F.lit("")) != "")
    said = F.transform(f("comment.comments"), lambda c: F.struct(F.coalesce(c["author"]["displayName"], F.lit("unknown")).alias("author"), F.coalesce(c["body"], F.lit("")).alias("body"), c["visibility"].alias("visibility")))
    outward = lambda x: x["outwardIssue"]["key"].isNotNull()
    side = lambda x: F.struct(
        F.coalesce(F.when(outward(x), x["type"]["outward"]).otherwise(x["type"]["inward"]), x["type"]["name"], F.lit("relates to")).alias("type"), F.when(outward(x), x["outwardIssue"]["key"]).otherwise(x["inwardIssue"]["key"]).alias("key")
    )
    linked = F.filter(F.transform(f("issuelinks"), side), lambda x: F.coalesce(x["key"], F.lit("")) != "")
    return i.select("key", F.concat(F.lit(url.rstrip("/") + "/browse/"), "key").alias("url"), F.struct(
        F.coalesce(f("summary"), F.lit("")).alias("summary"), f("status.name").alias("status"), f("issuetype.name").alias("issuetype"), f("project.key").alias("project"), f("reporter.displayName").alias("reporter"),
        f("created").alias("created"), f("updated").alias("updated"), F.coalesce(f("description"), F.lit("")).alias("description"), said.alias("comments"), f("assignee.displayName").alias("assignee"), f("labels").alias("labels"),
        f("priority.name").alias("priority"), f("resolution.name").alias("resolution"), names("components").alias("components"), names("fixVersions").alias("fix_versions"), f("parent.key").alias("parent"), linked.alias("issue_links"),
    ).alias("fields"))
