"""Plans over stores that change: blobs, the versioned catalog, and events as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlstone.functions import secrets
from marlstone.plans.portable import oracle
from marlstone.sources import blobs, versions
from marlstone.sources.catalog import view
from marlstone.sources.store import shared_dir
from marlstone.streaming import late

Q: dict = {}
O: dict = {}  # noqa: E741


def plan(name: str, sql: str):
    def add(f):
        Q[name] = f
        O[name] = oracle(sql)
        return f

    return add


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/stores/{name}-{uuid.uuid4().hex}"


@plan("blob_store", "SELECT tenant, sha256(body) AS digest, octet_length(encode(any_value(body))) AS size, count(DISTINCT (source, n % 400)) AS links, sha256(any_value(body)) AS again FROM {docs} WHERE n % 7 <> 0 GROUP BY tenant, sha256(body)")
def blob_store(s, d):
    """All bodies stored and linked, those of every seventh document retired, and what is left read back."""
    s.dataSource.register(blobs.BlobSink)
    path = place(s, "blobs")
    rows = view(s, d, "docs").select("tenant", F.when(F.col("n") % 7 == 0, F.lit("gone")).otherwise(F.col("source")).alias("source"), (F.col("n") % 400).cast("string").alias("native_id"), F.col("body").cast("binary").alias("content"))
    blobs.put(rows, path)
    blobs.retire(s, path, rows.where("source = 'gone'"))
    blobs.collect_garbage(s, path)
    links = blobs.table(s, path, "links").groupBy("tenant", "digest", "size").agg(F.count(F.lit(1)).alias("links"))
    return blobs.get(s, path, links).join(links, ["tenant", "digest"]).select("tenant", "digest", "size", "links", F.sha2("content", 256).alias("again"))


@plan("catalog_upsert", """SELECT d.tenant, d.id, CASE WHEN n % 10 = 0 THEN 2 ELSE 1 END AS revision, CASE WHEN n % 10 = 1 THEN 2 ELSE 1 END AS acl_version, len(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')) + CASE WHEN n % 10 = 0 THEN 1 ELSE 0 END AS chunks,
len(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')) AS embedded, CAST(CASE WHEN n % 10 < 2 THEN 2 ELSE 1 END AS BIGINT) AS seen_at FROM {docs} d""")
def catalog_upsert(s, d):
    """All documents, vectors for their chunks, then a line more for every tenth document and other access for the next: in one step each."""
    c = versions.Catalog(s, place(s, "catalog"), 8)
    docs = view(s, d, "docs").select("tenant", "id", "title", "body", "owner", "acl_group", "n")
    c.upsert(docs.drop("n"), 1)
    c.embed(c.read("chunks").select("tenant", "text_hash").distinct().withColumn("vector", F.array(F.lit(1.0).cast("float"))))
    more = F.when(F.col("n") % 10 == 0, F.concat("body", F.lit("\nadded line of "), "id")).otherwise(F.col("body"))
    c.upsert(docs.where("n % 10 < 2").withColumns({"body": more, "acl_group": F.when(F.col("n") % 10 == 1, F.lit("moved")).otherwise(F.col("acl_group"))}).drop("n"), 2)
    chunks = c.read("chunks").groupBy("tenant", "id").agg(F.count(F.lit(1)).alias("chunks"), F.count("vector").alias("embedded"))
    zero = lambda k: F.coalesce(k, F.lit(0)).alias(k)
    return c.read("documents").join(chunks, ["tenant", "id"], "left").select("tenant", "id", "revision", "acl_version", zero("chunks"), zero("embedded"), "seen_at")


ARRIVED = "e AS (SELECT *, date_trunc('month', arrived_at) AS m FROM clicks WHERE ts IS NOT NULL), w AS (SELECT m, date_trunc('milliseconds', max(max(ts)) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) - INTERVAL 24 HOUR AS mark FROM e GROUP BY m), k AS (SELECT e.*, coalesce(ts <= mark, false) AS late FROM e JOIN w USING (m))"


def clicks(s, d):
    c = s.read.parquet(f"{d}/clicks.parquet").select("click_id", F.col("ts").cast("timestamp").alias("ts"), F.col("arrived_at").cast("timestamp").alias("arrived_at"), "kind", "value")
    return late.replayed(c, place(s, "clicks"), "click_id", "ts", "arrived_at")


plan("stream_late_dedup", f"WITH {ARRIVED} SELECT strftime(ts, '%Y-%m-%d') AS day, kind, count(*) AS clicks, round(sum(value), 2) AS total FROM (SELECT DISTINCT click_id, ts, kind, value FROM k WHERE NOT late) GROUP BY 1, 2")(
    lambda s, d: clicks(s, d)[0].groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "kind").agg(F.count(F.lit(1)).alias("clicks"), F.round(F.sum("value"), 2).alias("total")))
plan("stream_progress", f"WITH {ARRIVED} SELECT CAST(row_number() OVER (ORDER BY m) AS INT) AS run, count(*) FILTER (WHERE late) AS late FROM k GROUP BY m")(
    lambda s, d: clicks(s, d)[1].selectExpr("row_number() OVER (ORDER BY batch) AS run", "late"))


# secrets: those of every fifth document are accepted wherever they stand
EVEN = """t AS (SELECT doc_id AS n, text, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{20,}'))) AS s FROM documents), p AS (SELECT n, text, s, unnest(CASE WHEN length(s) <= 64 THEN [s] ELSE [substr(s, k, 40) for k in range(1, length(s) - 38, 20)] END) AS piece FROM t),
h AS (SELECT n, text, s, max(round(list_sum([-c / length(piece) * log2(c / length(piece)) for c in [length(piece) - length(replace(piece, x, '')) for x in list_distinct(string_split(piece, ''))]]), 9)) AS bits FROM p GROUP BY n, text, s),
f AS (SELECT n, CASE WHEN regexp_matches(s, '^[0-9a-fA-F]{32,}$') AND bits >= 3.0 THEN 'hex-entropy' WHEN bits >= 4.5 THEN 'base64-entropy' END AS rule, substr(s, 1, 4) || ':' || substr(sha256(s), 1, 8) AS hint, CAST(instr(text, s) AS INT) AS start FROM h WHERE regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]'))"""


@plan("secret_findings", f"WITH {EVEN} SELECT n AS doc_id, rule, hint, start FROM f WHERE rule IS NOT NULL AND (rule, hint) NOT IN (SELECT (rule, hint) FROM f WHERE n % 5 = 0 AND rule IS NOT NULL)")
def secret_findings(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return secrets.findings(docs, "doc_id", secrets.findings(docs.where("doc_id % 5 = 0"), "doc_id"))
