"""A leased queue of jobs as a table: each step takes the whole table and a time, and returns the table after it.

Steps are pure, so Spark may run a lost part of one again; whoever keeps the table lets one writer at a time put the result
in the place of what the step read. A job is named by its tenant and key, so no numbering is shared.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import redact
from marlstone.sources.store import collected, written

SCHEMA = (
    "id string, tenant string, job_type string, payload string, key string, status string, attempts int, max_attempts int, "
    "run_after timestamp, lease_owner string, lease_until timestamp, fence bigint, last_error string"
)
LEASE, BATCH, MOST_BATCH, ATTEMPTS, ERROR_CHARS = 60, 10, 1000, 5, 2000  # fixed values
CRASHED = "attempts used up: leases ran out without a report"


def bucket_key(name: str, now: Column, seconds: int = 3600) -> Column:
    """One key for each window of time, so that a schedule that fires twice in it makes one job."""
    return F.concat(F.lit(name + ":"), F.floor(F.unix_timestamp(now) / seconds).cast("string"))


def canonical(payload: Column) -> Column:
    """A flat JSON object by its sorted entries: the order of keys does not tell payloads apart."""
    entries = F.array_sort(F.map_entries(F.from_json(payload, "map<string,string>")))
    return F.coalesce(F.to_json(entries), payload)


def enqueue(jobs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with ``new`` (tenant, job_type, payload, key, run_after, and max_attempts or null), and the rows refused.

    A key that is there already with the same type, payload and attempts adds nothing and moves no time; with others it is a
    conflict, returned with what stands there. Of rows that share a key in ``new`` the first by time and content counts.
    """
    n = new.withColumns({"max_attempts": F.coalesce("max_attempts", F.lit(ATTEMPTS)).cast("int"), "same": canonical(F.col("payload"))})
    n = n.select("tenant", "key", F.struct("run_after", "job_type", "same", "max_attempts", "payload").alias("w"))
    held = jobs.select("tenant", "key", F.struct("job_type", canonical(F.col("payload")).alias("same"), "max_attempts").alias("held"))
    first = n.groupBy("tenant", "key").agg(F.min("w").alias("first"))
    j = first.join(held, ["tenant", "key"], "left")
    intent = lambda c: F.struct(F.col(f"{c}.job_type").alias("job_type"), F.col(f"{c}.same").alias("same"), F.col(f"{c}.max_attempts").alias("max_attempts"))
    fresh = j.where("held IS NULL").select(
        F.sha2(F.concat_ws("\0", "tenant", "key"), 256).alias("id"), "tenant", "first.job_type", "first.payload", "key", F.lit("pending").alias("status"), F.lit(0).alias("attempts"),
        "first.max_attempts", "first.run_after", F.lit(None).cast("string").alias("lease_owner"), F.lit(None).cast("timestamp").alias("lease_until"),
        F.lit(0).cast("bigint").alias("fence"), F.lit(None).cast("string").alias("last_error"),
    )
    winners = j.select("tenant", "key", F.coalesce("held", intent("first")).alias("held"))
    wrong = n.join(winners, ["tenant", "key"]).where(intent("w") != F.col("held"))
    return jobs.unionByName(fresh), wrong.select("tenant", "key", "w.job_type", "w.payload", F.col("held.job_type").alias("held_type")).distinct()


def exhausted(now: Column) -> Column:
    return (F.col("status") == "claimed") & (F.col("lease_until") < now) & (F.col("attempts") >= F.col("max_attempts"))


def claimable(now: Column) -> Column:
    free = (F.col("status") == "pending") & (F.col("run_after") <= now)
    return free | ((F.col("status") == "claimed") & (F.col("lease_until") < now) & (F.col("attempts") < F.col("max_attempts")))


def claim(jobs: DataFrame, worker: str, now: Column, lease: int = LEASE, batch: int = BATCH) -> DataFrame:
    """The table after a worker has taken up to ``batch`` jobs, those that wait longest first.

    Jobs whose last attempt's lease ran out go to the dead letters first and take no place in the batch. Each claim raises
    the fence, so that a worker whose lease ran out can report nothing any more.
    """
    if not worker.strip() or not 0 < batch <= MOST_BATCH or lease <= 0:
        raise ValueError("a worker needs a name, a lease and a batch of 1 to 1000")
    taken = jobs.where(claimable(now)).orderBy("run_after", "id").limit(batch).select("id", F.lit(True).alias("taken"))
    j = jobs.join(F.broadcast(taken), "id", "left")  # at most MOST_BATCH rows
    dead, mine = exhausted(now), F.coalesce("taken", F.lit(False))
    pick = lambda won, lost, c: F.when(mine, won).when(dead, lost).otherwise(F.col(c)).alias(c)
    return j.select(
        "id", "tenant", "job_type", "payload", "key", pick(F.lit("claimed"), F.lit("dead_letter"), "status"), F.when(mine, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        "max_attempts", "run_after", pick(F.lit(worker), F.lit(None), "lease_owner"), pick(now + F.make_dt_interval(secs=F.lit(lease)), F.lit(None), "lease_until"),
        F.when(mine, F.col("fence") + 1).otherwise(F.col("fence")).alias("fence"), F.when(dead, F.lit(CRASHED)).otherwise(F.col("last_error")).alias("last_error"),
    )


def delay(attempts: Column, share: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    """Seconds before a retry: a share of a bound that doubles with each attempt."""
    return share * F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempts))


def settle(jobs: DataFrame, reports: DataFrame, now: Column, lease: int = LEASE, share: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The table after ``reports`` (id, worker, fence, outcome, error), and the reports that were refused.

    An outcome is ``completed``, ``failed`` or ``heartbeat``; of several for one lease the first in this order counts. A report counts
    only under the lease it was made in: same owner, same fence, not run out. A failure goes back to wait, or to the dead
    letters after the last attempt, with its error cleared of credentials and then cut. ``share`` is the part of the longest wait, drawn from the job's id and fence if not given.
    """
    if share is None:  # a draw that is the same when a lost part is run again
        share = F.pmod(F.xxhash64("id", "fence"), F.lit(1000)) / 1000
    known = F.col("outcome").isin("completed", "failed", "heartbeat")
    rank = F.when(F.col("outcome") == "completed", 0).when(F.col("outcome") == "failed", 1).otherwise(2)
    error = F.substring(redact(F.coalesce("error", F.lit(""))), 1, ERROR_CHARS)
    best = reports.where(known).groupBy("id", F.col("worker").alias("r_worker"), F.col("fence").alias("r_fence")).agg(F.min(F.struct(rank.alias("rank"), "outcome", error.alias("error"))).alias("r"))
    held = (F.col("status") == "claimed") & (F.col("lease_until") > now)
    mine = (F.col("id") == F.col("r_id")) & (F.col("lease_owner") == F.col("r_worker")) & (F.col("fence") == F.col("r_fence"))
    j = jobs.join(best.withColumnRenamed("id", "r_id"), mine & held, "left")  # a lease has one owner and fence: one report at most
    done, failed, beat = (F.coalesce(F.col("r.outcome") == x, F.lit(False)) for x in ("completed", "failed", "heartbeat"))
    last = F.col("attempts") >= F.col("max_attempts")
    later = now + F.make_dt_interval(secs=delay(F.col("attempts"), share).cast("decimal(18,6)"))
    out = j.select(
        "id", "tenant", "job_type", "payload", "key", F.when(done, "completed").when(failed & last, "dead_letter").when(failed, "pending").otherwise(F.col("status")).alias("status"),
        "attempts", "max_attempts", F.when(failed & ~last, later).otherwise(F.col("run_after")).alias("run_after"), F.when(~(done | failed), F.col("lease_owner")).alias("lease_owner"),
        F.when(beat, now + F.make_dt_interval(secs=F.lit(lease))).when(~(done | failed), F.col("lease_until")).alias("lease_until"), "fence", F.when(failed, F.col("r.error")).otherwise(F.col("last_error")).alias("last_error"),
    )
    leases = jobs.where(held).select("id", F.col("lease_owner").alias("worker"), "fence")
    refused = reports.where(~F.coalesce(known, F.lit(False))).unionByName(reports.where(known).join(leases, ["id", "worker", "fence"], "left_anti").select(reports.columns))
    return out, refused


def replay(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The table with those dead letters that ``ids`` (id) names waiting again, their attempts counted anew; fences stand."""
    j = jobs.join(ids.select("id").distinct().withColumn("again", F.lit(True)), "id", "left")
    again = F.coalesce("again", F.lit(False)) & (F.col("status") == "dead_letter")
    new = {"status": F.lit("pending"), "attempts": F.lit(0), "run_after": now, "last_error": F.lit(None).cast("string"), "lease_owner": F.lit(None).cast("string"), "lease_until": F.lit(None).cast("timestamp")}
    return j.select(*[F.when(again, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def work(jobs: DataFrame, worker: str, handlers: dict[str, Callable[[str, str], None]], now: Column, concurrency: int = 4, batch: int = BATCH) -> DataFrame:
    """One round of a worker: claim, run the handlers (tenant, payload) of what was claimed side by side, settle.

    Handlers run on the driver, which starts Spark jobs from them; no more than a batch is held there. A type without a handler
    fails its job. What is claimed is written before a handler starts, so no later plan can claim otherwise.
    """
    spark = jobs.sparkSession
    claimed = written(claim(jobs, worker, now, batch=batch), "jobs")
    mine = collected(claimed.where((F.col("status") == "claimed") & (F.col("lease_owner") == worker) & (F.col("lease_until") > now)).orderBy("run_after", "id").limit(batch))

    def one(r) -> tuple:
        try:
            handlers[r["job_type"]](r["tenant"], r["payload"])
        except Exception as e:
            return r["id"], worker, r["fence"], "failed", f"{type(e).__name__}: {e}"
        return r["id"], worker, r["fence"], "completed", None

    with ThreadPoolExecutor(concurrency) as pool:
        reports = list(pool.map(one, mine))
    return settle(claimed, spark.createDataFrame(reports, "id string, worker string, fence bigint, outcome string, error string"), now)[0]
