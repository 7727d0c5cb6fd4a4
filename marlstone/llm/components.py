"""Connected components of an edge table by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._shared import collected, drop, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label (least node of its component) for every node of ``edges`` (a, b: any ordered type).

    Each pass is one aggregate and one join over what is left of the edges, and
    is written, so a lost executor repeats one pass at most. Least neighbours are
    written before they are joined: then the join reads two plain exchanges, of
    which Spark splits the partition of a node with very many edges. An empty table
    gives an empty result; loops are ignored, nodes that have no other edge are left out.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, name)
        drop(least)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last = e
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        e = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        drop(last, large, least)
        now = collected(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))))[0]
        if tuple(now) == state:
            break
        state = tuple(now)
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
