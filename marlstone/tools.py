"""Named tools over the catalog: a registry with contracts, one way to call them, a record of each call and a manifest."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import headline, markdown, text
from marlstone.operators import answers, code
from marlstone.operators import search as S
from marlstone.sources.catalog import view
from marlstone.sources.fielded import fielded

# Characters of a section, edges in a direction, kinds of entries of the code index.
SECTION, EDGES = 8_000, 50
KINDS = ["path", "symbol", "literal", "import", "export", "test"]

AUDIT = "ts double, principal string, tenant string, tool string, ok boolean, result_count long, duration_ms long, error string"


class Viewer(NamedTuple):
    principal: str
    tenant: str = "default"
    groups: tuple = ()


class Tool(NamedTuple):
    name: str
    about: str
    arguments: dict  # name -> (type, default); ... is no default
    handler: Callable
    env: tuple = ()  # variables that must be set
    group: str | None = None  # that the viewer must be in


TOOLS: dict[str, Tool] = {}
JOBS: dict[str, dict] = {}


def tool(name: str, about: str, env: tuple = (), group: str | None = None, **arguments):
    def add(handler: Callable) -> Callable:
        if name in TOOLS:
            raise ValueError(f"tool {name} is there already")
        TOOLS[name] = Tool(name, about, arguments, handler, env, group)
        return handler

    return add


def job_type(name: str, **fields: type) -> None:
    """A kind of job with the fields that its payload must have."""
    if name in JOBS:
        raise ValueError(f"job type {name} is there already")
    JOBS[name] = fields


def job(name: str, payload: dict) -> dict:
    fields = JOBS.get(name)
    if fields is None:
        raise ValueError(f"unknown job type {name}")
    if wrong := [k for k in {*fields, *payload} if k not in fields or not isinstance(payload.get(k), fields[k])]:
        raise ValueError(f"invalid payload of {name}: {', '.join(sorted(wrong))}")
    return {"type": name, "payload": payload}


def checked(t: Tool, given: dict) -> dict:
    if extra := set(given) - set(t.arguments):
        raise ValueError(f"unknown argument: {', '.join(sorted(extra))}")
    out = {}
    for k, (kind, default) in t.arguments.items():
        v = given.get(k, default)
        if v is ...:
            raise ValueError(f"missing argument: {k}")
        if v is not None and (not isinstance(v, kind) or (kind is int and isinstance(v, bool))):
            raise ValueError(f"{k} must be of type {kind.__name__}")
        out[k] = v
    return out


def counted(result: Any) -> int:
    """Results, else edges, else an entity and what is linked to it, else one unless it is an error."""
    for key in ("results", "edges"):
        if isinstance(result.get(key), list):
            return len(result[key])
    if "entity" in result:
        return 1 + len(result.get("linked") or [])
    return 0 if "error" in result else 1


def call(spark: SparkSession, sf_dir: str, viewer: Viewer | None, name: str, log: list | None = None, **given) -> dict:
    """The result of a tool, or ``{"error": ...}``. Each call adds a row to ``log``, whatever came of it."""
    began, result = time.time(), {"error": "failed"}
    try:
        t = TOOLS.get(name)
        if t is None:
            result = {"error": f"unknown tool {name}"}
        elif missing := [e for e in t.env if not os.environ.get(e)]:
            result = {"error": f"not configured: {', '.join(missing)}"}
        else:
            arguments = checked(t, given)
            if viewer is None or not viewer.principal:
                result = {"error": "no trusted viewer"}
            elif t.group and t.group not in viewer.groups:
                result = {"error": f"needs group {t.group}"}
            else:
                result = t.handler(spark, sf_dir, viewer, **arguments)
    except ValueError as e:
        result = {"error": str(e)}
    finally:
        if log is not None:
            log.append((began, viewer.principal if viewer else None, viewer.tenant if viewer else None, name, "error" not in result, counted(result), int(1000 * (time.time() - began)), result.get("error")))
    return result


def audit(spark: SparkSession, log: list) -> DataFrame:
    return spark.createDataFrame(log, AUDIT)


def manifest() -> list[dict]:
    """All tools with their arguments as JSON schema."""
    kinds = {str: "string", int: "integer", bool: "boolean", list: "array"}
    return [
        {"name": t.name, "description": t.about, "inputSchema": {
            "type": "object", "additionalProperties": False, "required": [k for k, (_, d) in t.arguments.items() if d is ...],
            "properties": {k: {"type": kinds[kind]} | ({} if d in (..., None) else {"default": d}) for k, (kind, d) in t.arguments.items()},
        }}
        for t in sorted(TOOLS.values())
    ]


def _seen(spark: SparkSession, sf_dir: str, viewer: Viewer, superseded: bool) -> DataFrame:
    return S.visible(view(spark, sf_dir, "docs"), viewer.principal, viewer.groups, viewer.tenant, superseded)


def _freshness(spark, sf_dir, viewer, sources, superseded) -> dict:
    """What every answer says of the catalog: how current it is, and what the answer could draw on."""
    cursors = view(spark, sf_dir, "cursors")
    families, whole = answers.coverage(cursors, answers.readable(spark, sf_dir, viewer.principal, viewer.groups, viewer.tenant, superseded), viewer.tenant, sources)
    w = whole.first().asDict()
    return {
        "corpus_current_to": answers.current_to(cursors, viewer.tenant).first()["age_hours"],
        "coverage": {"complete": w["complete"], "sources": [r.asDict() for r in families.orderBy("family").collect()], "requested_absent": [x for x in w["absent"].split(",") if x], "quarantined_docs": w["quarantined"]},
    }


@tool("search_docs", "Documents that match a query, best first.", query=(str, ...), limit=(int, 8), sources=(list, None), include_superseded=(bool, False), include_unverified=(bool, False))
def search_docs(spark, sf_dir, viewer, query, limit, sources, include_superseded, include_unverified):
    """Quoted phrases and excluded words count; snippets are made for what is shown alone."""
    docs = _seen(spark, sf_dir, viewer, include_superseded)
    if sources is not None:
        docs = docs.where(F.col("source").isin(list(sources)))
    chunks = view(spark, sf_dir, "chunks")
    asked = spark.createDataFrame([("q", query)], "query_id string, query string")
    found = answers.answer(fielded(spark, sf_dir), asked, docs, chunks, max(1, min(limit, 50)), unverified=include_unverified)
    words, phrases, _ = markdown.parse_query(query)
    marked = F.array(*[F.lit(w) for w in dict.fromkeys([*words, *(w for p in phrases for w in p)])]).cast("array<string>")
    shown = found.results.join(docs.select("tenant", "id", "title", "url", "source", "quality_tier"), ["tenant", "id"]).join(chunks.select("tenant", "id", "seq", "text"), ["tenant", "id", "seq"])
    shown = shown.withColumn("h", headline.headline(marked, F.col("text"))).select("id", "title", "url", "source", "quality_tier", "score", "position", "h.snippet", "h.truncated", F.col("verified").alias("evidence_verified"))
    c = found.contract.first().asDict()
    return {
        "route": c["route"], "executor": c["executor"], "results": [r.asDict() for r in shown.orderBy("position").collect()], "top_score": c["top_score"], "score_gap": c["score_gap"], "n_above_threshold": c["n_above_threshold"],
        "evidence_oldest_days": c["oldest_age"], "evidence_newest_days": c["newest_age"], "unverified_excluded": c["unverified_excluded"], **_freshness(spark, sf_dir, viewer, sources, include_superseded),
    }


@tool("search_code", "Lines of the indexed repositories that hold a name, a path, an import or a literal.", query=(str, ...), kind=(str, None), repo=(str, None), path=(str, None), limit=(int, 10), include_superseded=(bool, False))
def search_code(spark, sf_dir, viewer, query, kind, repo, path, limit, include_superseded):
    """Citations of the exact value; where there is none, the files whose tokens fit best. Citations are cut from the body as it is."""
    if kind is not None and kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    seen = _seen(spark, sf_dir, viewer, include_superseded).select("n")
    files = view(spark, sf_dir, "files").join(seen, "n", "left_semi").select("id", "repo", "path", "body")
    asked = spark.createDataFrame([("q", query, kind, repo, path)], "query_id string, query string, kind string, repo string, path string")
    index = code.code_index(files)
    limit = max(1, min(limit, 50))
    cited = [r.asDict() for r in code.lookup(asked, index, files, limit).orderBy("path", "line", "kind").collect()]
    similar = []
    if not cited and kind is None:
        wanted = files.where((F.lit(repo).isNull() | (F.col("repo") == F.lit(repo))) & (F.lit(path).isNull() | (F.col("path") == F.lit(path))))
        best = code.ranked(asked, code.token_index(wanted, index)).orderBy(F.desc("score"), "path", "id").limit(limit)
        similar = [r.asDict() for r in best.select("id", "path", "line", "score").collect()]
    return {"executor": "code_index", "results": cited, "similar": similar, "total_chars": sum(len(r["text"]) for r in cited), "unverified_excluded": 0, **_freshness(spark, sf_dir, viewer, ["code"], include_superseded)}


@tool("fetch_logs", "Log lines that match a query, newest first; never indexed.", env=("MARLSTONE_LOGS_URL",), query=(str, ...), minutes=(int, 60), limit=(int, 20), index=(str, ""))
def fetch_logs(spark, sf_dir, viewer, query, minutes, limit, index):
    """The service's reader is registered by the deployment; secrets are struck out of what it gives."""
    read = READERS.get("logs")
    if read is None:
        return {"error": "no reader of logs"}
    rows = sorted(read(query=query, minutes=max(1, minutes), index=index), key=lambda r: str(r.get("ts")), reverse=True)[: max(1, min(limit, 100))]
    said = [(n, k, v) for n, r in enumerate(rows) for k, v in r.items() if isinstance(v, str)]
    for r in spark.createDataFrame(said, "n int, k string, v string").select("n", "k", text.redact(F.col("v")).alias("v")).collect():
        rows[r["n"]] = rows[r["n"]] | {r["k"]: r["v"]}
    return {"results": rows}


@tool("get_doc", "One section of a document.", id=(str, ...), section=(int, 0), include_superseded=(bool, False))
def get_doc(spark, sf_dir, viewer, id, section, include_superseded):
    r = _seen(spark, sf_dir, viewer, include_superseded).where(F.col("id") == id).select("id", "title", "url", "source", "quality_tier", "body").first()
    if r is None:
        retired = not include_superseded and _seen(spark, sf_dir, viewer, True).where(F.col("id") == id).limit(1).count()
        return {"error": f"no document {id}"} | ({"hint": "only a superseded version is there; ask with include_superseded"} if retired else {})
    total = max(1, -(-len(r["body"]) // SECTION))
    if not 0 <= section < total:
        return {"error": f"section {section} of {total}"}
    return r.asDict() | {"section": section, "total_sections": total, "body": r["body"][section * SECTION : (section + 1) * SECTION]}


@tool("expand", "Documents linked to one, in either direction.", id=(str, ...))
def expand(spark, sf_dir, viewer, id):
    """Fails closed: a document that may not be seen has no neighbours, and none that may not be seen is one."""
    focal = spark.createDataFrame([(id,)], "focal_id string")
    near = answers.neighbours(view(spark, sf_dir, "links"), view(spark, sf_dir, "docs"), _seen(spark, sf_dir, viewer, False), focal, viewer.tenant, EDGES)
    rows = [r.asDict() for r in near.drop("focal_id").orderBy("direction", "id", "rel").collect()]
    return {"id": id, "truncated": any(r["truncated"] for r in rows), "edges": [{k: v for k, v in r.items() if k != "truncated"} for r in rows]}


@tool("refresh_doc", "Read one document again from its source.", group="refresh", id=(str, ...))
def refresh_doc(spark, sf_dir, viewer, id):
    """The source's reader is registered by the deployment; without one nothing is read."""
    read = READERS.get(id.split(":")[0])
    return {"id": id, "status": read(id)} if read else {"error": f"no source for {id}"}


READERS: dict[str, Callable] = {}
