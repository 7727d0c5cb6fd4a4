"""Measures of ranked answers against judgements, query by query, and a run over a table of queries by search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import lexical
from marlstone.sources.fielded import Fielded
from marlstone.sources.scan import Texts

DEPTH = 50


def measured(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, returned, relevant, recall_10, recall_50, ndcg_10, mrr and judged_10 of ``ranked`` (query_id, doc_id, rank) against ``qrels`` (query_id, doc_id, grade).

    Queries without a relevant document have null measures, so that means leave them out; judged queries without an answer score zero.
    """
    gain = lambda place: F.when(place <= 10, F.coalesce("grade", F.lit(0)) / F.log2(place + 1)).otherwise(0.0)
    found = ranked.join(qrels, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("returned"), *[F.count_if((F.col("grade") > 0) & (F.col("rank") <= k)).alias(f"hits_{k}") for k in (10, 50)],
        F.sum(gain(F.col("rank"))).alias("dcg"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
        (F.count_if(F.col("grade").isNotNull() & (F.col("rank") <= 10)) / F.count_if(F.col("rank") <= 10)).alias("judged_10"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    ideal = qrels.withColumn("place", place).groupBy("query_id").agg(F.sum(gain(F.col("place"))).alias("ideal"), F.count_if(F.col("grade") > 0).alias("relevant"))
    m = found.join(ideal, "query_id", "full")
    part = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b))
    return m.select(
        "query_id", F.coalesce("returned", F.lit(0)).alias("returned"), F.coalesce("relevant", F.lit(0)).alias("relevant"),
        part("hits_10", "relevant").alias("recall_10"), part("hits_50", "relevant").alias("recall_50"), part("dcg", "ideal").alias("ndcg_10"),
        F.when(F.col("relevant") > 0, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.when(F.col("relevant") > 0, F.coalesce("judged_10", F.lit(0.0))).alias("judged_10"),
    )


def run_eval(ix: Fielded | Texts, words: DataFrame, qrels: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """The measures of each query (query_id, stem), searched to ``DEPTH``; ``docs`` are those that the viewer may see."""
    ranked = lexical.top_documents(ix, words, DEPTH, docs).withColumnRenamed("id", "doc_id")
    return measured(ranked, qrels)


def summary(measures: DataFrame) -> DataFrame:
    """One row: queries that ran, those judged, and the means over these."""
    names = ["recall_10", "recall_50", "ndcg_10", "mrr", "judged_10"]
    return measures.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("relevant") > 0).alias("judged"), *[F.round(F.avg(n), 6).alias(n) for n in names])
