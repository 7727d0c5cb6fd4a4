"""Keeping the catalog true to its sources: what a listing no longer has, and where each source's reading goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.store import collected

LEAST = 0.5  # fixed value: a listing that has less of what is live is not believed


def reconcile(live: DataFrame, listed: DataFrame, complete: bool = True, prefix: str | None = None) -> tuple[str, DataFrame]:
    """The verdict, and the live documents (tenant, id) to retire: those that a complete listing (tenant, id) of the source, or
    of what begins with ``prefix``, has no more. An incomplete listing retires nothing, nor does one that lost too much at once."""
    if prefix is not None:
        live, listed = live.where(F.col("id").startswith(prefix)), listed.where(F.col("id").startswith(prefix))
    missing = live.join(listed.select("tenant", "id").distinct(), ["tenant", "id"], "left_anti").select("tenant", "id")
    if not complete:
        return "incomplete", missing.limit(0)
    n, gone = (collected(d.agg(F.count(F.lit(1)).alias("n")))[0]["n"] for d in (live, missing))
    if n - gone < n * (1 - LEAST):
        return "refused", missing.limit(0)
    return "retired", missing


def advance(items: DataFrame) -> DataFrame:
    """source, cursor, failures from items (source, at, landed): before the first item that failed, else at the last one that
    landed; so what comes late or failed is read again."""
    return items.groupBy("source").agg(
        F.coalesce(F.min(F.when(~F.col("landed"), F.col("at"))), F.max(F.when(F.col("landed"), F.col("at")))).alias("cursor"), F.count_if(~F.col("landed")).alias("failures"))


# Characters of a body that is next to nothing, what a conversion leaves behind, hours after which a source is stale.
LEAST_BODY, RESIDUE, STALE_HOURS = 40, ("</div>", "</p>", "<ac:"), 24


def integrity(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, links: DataFrame, cursors: DataFrame) -> DataFrame:
    """check_name, n: what a healthy catalog has none of (or, for some, is told of), and whether it is healthy, in one pass over each table.

    Documents in quarantine have no chunks on purpose, and residue is looked for in prose alone. ``ok`` fails on documents that nobody
    can find or own, and on chunks that are not indexed; quarantine, missing vectors, dangling links and stale sources are work to do.
    ``chunks``: tenant, id, len (words indexed); ``vectors``: id.
    """
    held = chunks.groupBy("tenant", "id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.coalesce("len", F.lit(0)) == 0).alias("unindexed"))
    d = docs.select("tenant", "id", "owner", "source", "quarantined", "body").join(held, ["tenant", "id"], "left").join(vectors.select("id", F.lit(True).alias("embedded")).distinct(), "id", "left")
    some = F.coalesce("chunks", F.lit(0))
    left = F.lit(False)
    for r in RESIDUE:
        left = left | F.col("body").contains(r)
    of_docs = d.agg(
        F.count(F.lit(1)).alias("docs_total"), F.count_if(~F.col("quarantined") & (some == 0)).alias("docs_without_chunks"), F.count_if(F.col("owner") == "").alias("docs_unowned"),
        F.count_if(F.char_length("body") < LEAST_BODY).alias("docs_empty_body"), F.count_if((F.col("source") != "code") & left).alias("docs_html_residue"), F.coalesce(F.sum("unindexed"), F.lit(0)).alias("chunks_null_tsv"),
        F.count_if("quarantined").alias("docs_quarantined"), F.coalesce(F.sum(F.when(F.col("embedded").isNull(), some)), F.lit(0)).alias("chunks_unembedded"),
    )
    ends = links.groupBy("tenant", F.col("dst_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).join(docs.select("tenant", "id"), ["tenant", "id"], "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links_dangling_dst"))
    stale = cursors.agg(F.count_if(F.col("age_hours") > STALE_HOURS).alias("stale_sources"))
    ok = F.when((F.col("docs_without_chunks") == 0) & (F.col("docs_unowned") == 0) & (F.col("chunks_null_tsv") == 0), 1).otherwise(0).cast("long").alias("ok")
    rows = [df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).cast("long").alias("n")) for c in df.columns])).alias("x")).select("x.*") for df in (of_docs.select("*", ok), ends, stale)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
