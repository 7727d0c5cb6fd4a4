"""Plans of the job queue and of attachments over planted tables; oracles say what the steps must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import jobs
from marlstone.plans.portable import oracle
from marlstone.sources import attachments
from marlstone.sources.catalog import view

BASE = "https://docs.example/wiki"
Q: dict = {}
O: dict = {}  # noqa: E741


def plan(name: str, sql: str):
    def add(f):
        Q[name], O[name] = f, oracle(sql)
        return f

    return add


def now():
    return F.lit("2024-01-02 00:00:00").cast("timestamp")


def table(s, d):
    """A job for each call n: by n mod 4 one that is due, one that is not, one whose lease ran out (its attempts used up for half of them), one under a lease."""
    n, after = F.col("n"), lambda secs: now() + F.make_dt_interval(secs=secs.cast("int"))
    kind, none = n % 4, F.lit(None)
    return view(s, d, "audit").select(F.col("id").alias("n")).select(
        F.lpad(n.cast("string"), 12, "0").alias("id"), F.lit("t").alias("tenant"), F.lit("kind").alias("job_type"), F.lit('{"a":1,"b":2}').alias("payload"), n.cast("string").alias("key"),
        F.when(kind < 2, "pending").when(kind < 4, "claimed").alias("status"), F.when(kind < 2, 0).when(n % 8 == 2, 2).when(n % 8 == 6, 5).otherwise(n % 5 + 1).cast("int").alias("attempts"),
        F.lit(5).alias("max_attempts"), after(F.when(kind == 1, n % 1000 + 1).otherwise(-(n % 1000))).alias("run_after"), F.when(kind == 3, F.concat(F.lit("w"), (n % 3).cast("string"))).when(kind == 2, "w").otherwise(none).alias("lease_owner"),
        F.when(kind == 3, after(F.lit(30))).when(kind == 2, after(F.lit(-30))).otherwise(none).alias("lease_until"), (n % 7 + 1).alias("fence"), F.lit(None).cast("string").alias("last_error"),
    )


LEFT = "id AS n, lpad(CAST(id AS VARCHAR), 12, '0') AS id FROM {audit}"


@plan("job_claim", f"""SELECT id, CASE WHEN place <= 1000 THEN 'claimed' WHEN n % 8 = 6 THEN 'dead_letter' WHEN n % 4 < 2 THEN 'pending' ELSE 'claimed' END AS status, n % 7 + 1 + CASE WHEN place <= 1000 THEN 1 ELSE 0 END AS fence,
CASE WHEN place <= 1000 THEN 'me' WHEN n % 8 = 2 THEN 'w' WHEN n % 4 = 3 THEN 'w' || CAST(n % 3 AS VARCHAR) END AS lease_owner FROM
(SELECT *, CASE WHEN n % 4 = 0 OR n % 8 = 2 THEN row_number() OVER (PARTITION BY n % 4 = 0 OR n % 8 = 2 ORDER BY n % 1000 DESC, id) END AS place FROM (SELECT {LEFT}))""")
def job_claim(s, d):
    return jobs.claim(table(s, d), "me", now(), batch=1000).select("id", "status", "fence", "lease_owner")


def _reports(s, d):
    """By n mod 3: completed, failed, heartbeat; for n mod 7 = 0 of a fence too low."""
    n = F.col("key").cast("long")
    outcome = F.when(n % 3 == 0, "completed").when(n % 3 == 1, "failed").otherwise("heartbeat")
    t = table(s, d).where("status = 'claimed'")
    return t.select("id", F.col("lease_owner").alias("worker"), F.when(n % 7 == 0, F.col("fence") - 1).otherwise(F.col("fence")).alias("fence"), outcome.alias("outcome"), F.lit("at https://u:p@h.example/").alias("error"))


@plan("job_settle", f"""SELECT id, CASE WHEN NOT heard THEN CASE WHEN n % 4 < 2 THEN 'pending' ELSE 'claimed' END WHEN n % 3 = 0 THEN 'completed' WHEN n % 3 = 2 THEN 'claimed' WHEN n % 5 = 4 THEN 'dead_letter' ELSE 'pending' END AS status,
CASE WHEN heard AND n % 3 = 2 THEN 60 WHEN heard THEN NULL WHEN n % 4 = 3 THEN 30 WHEN n % 4 = 2 THEN -30 END AS lease_left,
CASE WHEN heard AND n % 3 = 1 AND n % 5 < 4 THEN CAST(power(2, n % 5) AS INT) WHEN n % 4 = 1 THEN n % 1000 + 1 ELSE -(n % 1000) END AS wait,
CASE WHEN heard AND n % 3 = 1 THEN 'at https://***@h.example/' END AS last_error FROM (SELECT *, n % 4 = 3 AND n % 7 > 0 AS heard FROM (SELECT {LEFT}))""")
def job_settle(s, d):
    after = jobs.settle(table(s, d), _reports(s, d), now(), share=F.lit(0.5))[0]
    secs = lambda c: F.unix_timestamp(c) - F.unix_timestamp(now())
    return after.select("id", "status", secs(F.col("lease_until")).alias("lease_left"), secs(F.col("run_after")).alias("wait"), "last_error")


plan("job_refused", f"SELECT id FROM (SELECT {LEFT}) WHERE n % 4 = 2 OR (n % 4 = 3 AND n % 7 = 0)")(
    lambda s, d: jobs.settle(table(s, d), _reports(s, d), now())[1].select("id"))


@plan("job_enqueue", "SELECT CAST(id AS VARCHAR) AS key, 'pending' AS what FROM {audit} WHERE id % 2 = 1 UNION ALL SELECT CAST(id AS VARCHAR), 'conflict' FROM {audit} WHERE id % 6 = 0")
def job_enqueue(s, d):
    """Even calls are queued; all come again twice, with the payload's keys in either order, those divisible by six with another payload."""
    t = table(s, d)
    a, b = (F.when(F.col("key").cast("long") % 6 == 0, '{"a":9}').otherwise(x) for x in ('{"a":1,"b":2}', '{"b":2,"a":1}'))
    new = t.select("tenant", "job_type", F.explode(F.array(a, b)).alias("payload"), "key", "run_after", F.lit(None).cast("int").alias("max_attempts"))
    held = t.where("CAST(key AS BIGINT) % 2 = 0")
    after, wrong = jobs.enqueue(held, new)
    return after.join(held.select("key"), "key", "left_anti").select("key", F.col("status").alias("what")).unionByName(wrong.select("key", F.lit("conflict").alias("what")))


@plan("job_replay", f"SELECT id, CASE WHEN n % 3 = 0 THEN 'pending' ELSE 'dead_letter' END AS status, CASE WHEN n % 3 = 0 THEN 0 ELSE 5 END AS attempts FROM (SELECT {LEFT}) WHERE n % 8 = 6")
def job_replay(s, d):
    """All that is dead after a claim; a third of all jobs are named, dead or not."""
    t = jobs.claim(table(s, d), "me", now())
    return jobs.replay(t, t.where("CAST(key AS BIGINT) % 3 = 0"), now()).where("CAST(key AS BIGINT) % 8 = 6").select("id", "status", "attempts")


def _entries(s, d):
    """By n mod 6: one to fetch, one of another host, one outside the context, one that climbs, one without a name, one whose file name has a control character."""
    n = F.col("n")
    link = F.when(n % 6 == 1, "https://evil.example/wiki/x").when(n % 6 == 2, "https://docs.example/wikievil/x").when(n % 6 == 3, "/wiki/a/%2E%2e/%2e%2e/x").otherwise(F.concat(F.lit(BASE + "/a/./b/../f"), n.cast("string"), F.lit("?v=1#top")))
    return view(s, d, "notes").select(
        F.col("id").alias("doc_id"), F.when(n % 6 == 4, "").otherwise(F.concat(F.lit("a"), n.cast("string"))).alias("native_id"), F.lit("1").alias("revision"), F.lit(" text/plain ").alias("media_type"),
        F.when(n % 6 == 5, "a\x01b").otherwise("f.txt").alias("filename"), link.alias("link"))


@plan("attachment_listing", "SELECT id AS doc_id, n % 6 <> 4 AS listed, n % 6 = 0 AS fetchable, CASE WHEN n % 6 = 0 THEN '/a/f' || CAST(n AS VARCHAR) || '?v=1' END AS path, 'text/plain' AS media_type FROM {notes}")
def attachment_listing(s, d):
    return attachments.listing(_entries(s, d), BASE).select("doc_id", "listed", "fetchable", "path", "media_type")


@plan("attachment_gone", "SELECT id AS doc_id, 'old' || CAST(n AS VARCHAR) AS native_id FROM {notes} WHERE n % 6 <> 4 AND n % 5 <> 0")
def attachment_gone(s, d):
    """Each document has stored what it lists and one more; of every fifth the listing broke off."""
    listed = attachments.listing(_entries(s, d), BASE)
    n = view(s, d, "notes").select(F.col("id").alias("doc_id"), "n")
    stored = n.select("doc_id", F.explode(F.array(F.concat(F.lit("a"), F.col("n").cast("string")), F.concat(F.lit("old"), F.col("n").cast("string")))).alias("native_id"), F.lit("1").alias("revision"))
    return attachments.gone(stored, listed, n.where("n % 5 <> 0")).select("doc_id", "native_id")
