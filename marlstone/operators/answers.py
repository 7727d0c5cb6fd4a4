"""Answers to a table of queries, with what they rest on: route, arms, evidence checked against the documents, bounds, coverage and confidence."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import ranking, text
from marlstone.operators import lexical, search
from marlstone.sources.catalog import view
from marlstone.sources.fielded import Fielded
from marlstone.sources.scan import Texts
from marlstone.sources.store import collected, written

# Hours after which a source is stale, and the share of the best score that counts as near it.
STALE_HOURS, NEAR = 24, 0.95
FEW = 1 << 17  # candidates that go to every task, so that no other text is exchanged
STATES = ["never_synced", "failing", "stale", "current"]


class Answers(NamedTuple):
    results: DataFrame  # query_id, id, seq, score, position, verified
    contract: DataFrame  # query_id, route, executor, returned, top_score, score_gap, n_above_threshold, oldest_age, newest_age, unverified_excluded


def coverage(cursors: DataFrame, docs: DataFrame, tenant: str, requested: list | None = None, stale_hours: int = STALE_HOURS) -> tuple[DataFrame, DataFrame]:
    """The sources that an answer could draw on, family by family, and one row on the whole.

    ``cursors``: tenant, source (family:scope), age_hours (null: never), consecutive_failures, item_failures. ``docs``: documents that
    the viewer could read were they not in quarantine, with source and quarantined. A family is as bad as its worst scope; what is requested
    and has no cursor is absent. Nothing is complete unless every source is current, none lost an item, none is absent and
    no document is in quarantine; without any cursor nothing is.
    """
    c = cursors.where(F.col("tenant") == tenant).withColumn("family", F.substring_index("source", ":", 1))
    families = sorted({r.split(":")[0] for r in requested}) if requested is not None else None
    if families is not None:
        c, docs = c.where(F.col("family").isin(families)), docs.where(F.col("source").isin(list(requested)))
    state = F.when(F.col("age_hours").isNull(), 0).when(F.coalesce("consecutive_failures", F.lit(0)) > 0, 1).when(F.col("age_hours") > stale_hours, 2).otherwise(3)
    oldest = F.when(F.count("age_hours") == F.count(F.lit(1)), F.max("age_hours"))
    sources = c.groupBy("family").agg(
        F.get(F.array(*[F.lit(s) for s in STATES]), F.min(state)).alias("state"), oldest.alias("age_hours"), F.max(F.coalesce("consecutive_failures", F.lit(0))).alias("consecutive_failures"),
        F.sum(F.coalesce("item_failures", F.lit(0))).alias("item_failures"),
    )
    wanted = F.lit(families).cast("array<string>") if families is not None else F.array().cast("array<string>")
    held = docs.agg(F.count_if("quarantined").alias("quarantined"))
    both = sources.unionByName(held, allowMissingColumns=True)
    whole = both.agg(
        F.count("family").alias("families"), F.coalesce(F.bool_and(F.col("state") == "current"), F.lit(False)).alias("healthy"), F.coalesce(F.sum("item_failures"), F.lit(0)).alias("item_failures"),
        F.array_join(F.sort_array(F.array_except(wanted, F.collect_set("family"))), ",").alias("absent"), F.coalesce(F.sum("quarantined"), F.lit(0)).alias("quarantined"),
    )
    complete = (F.col("families") > 0) & F.col("healthy") & (F.col("item_failures") == 0) & (F.col("absent") == "") & (F.col("quarantined") == 0)
    return sources, whole.select("families", "item_failures", "absent", "quarantined", complete.alias("complete"))


def current_to(cursors: DataFrame, tenant: str) -> DataFrame:
    """One row: the age in hours of the least current source of a tenant; null if one never succeeded, or there is none."""
    c = cursors.where(F.col("tenant") == tenant)
    return c.agg(F.when(F.count("age_hours") == F.count(F.lit(1)), F.max("age_hours")).alias("age_hours"))


def answer(ix: Fielded | Texts, queries: DataFrame, docs: DataFrame, chunks: DataFrame, limit: int = 8, vectors: DataFrame | None = None, near=None, unverified: bool = False) -> Answers:
    """The best documents of each query (query_id, query) among ``docs``, which are those that the viewer may see of the sources wanted.

    Arms of prose and of code, strict and loose, and of the nearest ``vectors`` (query_id, vec, by ``near(vectors, k)``) are fused by rank
    with weights of the query's route. The chunk that an answer is quoted by must still be in its document's body: answers that it is not,
    or that nothing was checked of, are left out and counted, unless ``unverified`` asks for them. Bodies are read of candidates alone.
    """
    routed = queries.select("query_id", "query", text.classify_route(F.col("query")).alias("route"))
    m = written(lexical.web_matches(ix, queries, docs, best=True), "matches")
    arms = search.lexical_arms(m, docs, limit)
    if vectors is not None:
        arms = arms.unionByName(near(vectors, 3 * limit).select("query_id", "id", F.lit("vec").alias("arm"), "rank0"))
    arms = written(arms.join(routed.select("query_id", "route"), "query_id"), "arms")
    fused = arms.groupBy("query_id", "id").agg(F.sum(ranking.rrf(ranking.arm_weight(F.col("arm"), F.col("route")), F.col("rank0"))).alias("fused"))
    fused = fused.join(docs.select("tenant", "id", "quality_tier", "age_days"), "id").withColumn("score", F.round(F.col("fused") * ranking.modifier(F.col("quality_tier"), F.col("age_days")), 6))
    best = m.groupBy("query_id", "id").agg(F.min_by("seq", F.struct((~F.col("strict")).alias("loose"), (-F.col("rank")).alias("low"), "seq")).alias("seq"))
    fused = written(fused.join(best, ["query_id", "id"], "left").select("query_id", "tenant", "id", F.coalesce("seq", F.lit(0)).alias("seq"), "score", "age_days"), "fused")
    wanted = fused.select("tenant", "id").distinct()
    if collected(fused.agg(F.count(F.lit(1)).alias("n")))[0]["n"] <= FEW:
        wanted = F.broadcast(wanted)
    read = lambda texts, *columns: texts.select("tenant", "id", *columns).join(wanted, ["tenant", "id"], "left_semi")
    quoted = fused.select("tenant", "id", "seq").distinct().join(read(chunks, "seq", "text"), ["tenant", "id", "seq"]).join(read(docs, "body"), ["tenant", "id"])
    checked = fused.join(quoted.select("tenant", "id", "seq", F.contains("body", "text").alias("verified")), ["tenant", "id", "seq"], "left").withColumn("verified", F.coalesce("verified", F.lit(False)))
    checked = written(checked, "checked")
    shown = checked if unverified else checked.where("verified")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    results = written(shown.withColumn("position", place).where(F.col("position") <= limit), "results")
    top = F.max("score").over(Window.partitionBy("query_id"))
    said = results.withColumn("top", top).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("returned"), F.max("score").alias("top_score"), F.count_if(F.col("score") >= NEAR * F.col("top")).alias("n_above_threshold"),
        F.round(F.max("score") - F.coalesce(F.max(F.when(F.col("position") == 5, F.col("score"))), F.min("score")), 6).alias("score_gap"),
        F.when(F.count("age_days") == F.count(F.lit(1)), F.max("age_days")).alias("oldest_age"), F.min("age_days").alias("newest_age"),
    )
    out = checked.groupBy("query_id").agg(F.count_if(~F.col("verified") & F.lit(not unverified)).alias("unverified_excluded"))
    named = arms.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("arm")), "+").alias("executor"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    contract = routed.select("query_id", "route").join(named, "query_id", "left").join(said, "query_id", "left").join(out, "query_id", "left")
    contract = contract.select("query_id", "route", F.coalesce("executor", F.lit("none")).alias("executor"), zero("returned"), "top_score", "score_gap", zero("n_above_threshold"), "oldest_age", "newest_age", zero("unverified_excluded"))
    return Answers(results.select("query_id", "tenant", "id", "seq", "score", "position", "verified", "age_days"), contract)


def readable(spark, sf_dir: str, principal: str, groups: tuple, tenant: str, superseded: bool = False) -> DataFrame:
    """Documents that the viewer could read, those in quarantine too."""
    d = view(spark, sf_dir, "docs")
    ok = (F.col("tenant") == tenant) & ~F.col("tombstoned") & ((F.col("owner") == principal) | F.col("acl_group").isin(*groups))
    return d.where(F.coalesce(ok if superseded else ok & ~F.col("superseded"), F.lit(False)))


def neighbours(links: DataFrame, all_docs: DataFrame, seen: DataFrame, focal: DataFrame, tenant: str, most: int = 50) -> DataFrame:
    """focal_id, id, rel, direction, title, ingested, truncated: documents linked to each of ``focal`` (focal_id), ``most`` in either direction.

    Fails closed on both ends: a focal document that is there but not ``seen`` has no neighbours, not even those nobody holds; a
    neighbour that is there must be seen; one that is not there at all shows as not ingested.
    """
    there = all_docs.where(F.col("tenant") == tenant)
    hidden = there.join(seen.select("id"), "id", "left_anti")
    asked = focal.join(hidden.select(F.col("id").alias("focal_id")), "focal_id", "left_anti")
    e = links.where(F.col("tenant") == tenant)
    out = e.select(F.col("src_id").alias("focal_id"), F.col("dst_id").alias("id"), "rel", F.lit("out").alias("direction"))
    both = out.unionByName(e.select(F.col("dst_id").alias("focal_id"), F.col("src_id").alias("id"), "rel", F.lit("in").alias("direction"))).join(asked.distinct(), "focal_id")
    known = both.join(hidden.select("id"), "id", "left_anti").join(seen.select("id", "title"), "id", "left")
    w = Window.partitionBy("focal_id", "direction")
    known = known.withColumn("k", F.row_number().over(w.orderBy("id", "rel"))).where(F.col("k") <= most)
    cut = F.max("k").over(Window.partitionBy("focal_id")) >= most
    return known.select("focal_id", "id", "rel", "direction", "title", F.col("title").isNotNull().alias("ingested"), cut.alias("truncated"))
