"""Op 8: mixing sources to target weights, in Spark's own functions.

Each source's target is a share of the mix by weight, at most ``max_repeat``
times its size; what a full source cannot take is reshared by weight among the
others (water-filling). A source is taken in whole passes and one part of a
pass.

1. A keyed hash permutes each source's documents into blocks of about
   ``BLOCK_DOCS`` documents. A pass takes a source's blocks in the order of
   another keyed hash until its quota of words is met, so only the last block
   of the part is cut. Block copies (source, pass, block) with their quotas of
   words stand at the root of the tree.
2. The splitting tree halves each node's copies, in the order of a keyed hash:
   a draw without replacement, so the sources' block quotas on each side are
   multivariate hypergeometric, add up to the node's exactly, and every copy
   ends in one leaf, a shard. A node's copies are side by side in that order, so
   a copy finds its way down by its rank and the nodes' sizes alone; ranks are
   counted range by range. The depth follows the number of copies, so that a
   shard has about ``PER_SHARD`` of them.
3. Documents meet the leaves of their block. What a document gives to the mix
   is what the leaves' quotas take of it: all of it, or in a cut block what the
   quota leaves over when the block's documents stand in hashed order. The last
   document is cut at the quota, so a source meets its target to the word.
4. Within a shard, copies are ordered by one more keyed hash.

All hashes are of (seed, id): reruns agree. Blocks follow the sources' sizes,
so a task that sorts one is as large at every scale; the tree has a row for
each ``BLOCK_DOCS`` documents, and no node of it is gathered.

Defined cases: null text has no words and is not taken; a null source is a
source, last in order; null ids share a hash, so they stand in one block;
repeated rows and ties are drawn as documents of their own, told apart by
nothing but their words; a text of any length is one number here; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm._shared import collected, table, written

WEIGHTS, SHARE, MAX_REPEAT, BLOCK_DOCS, PER_SHARD, SEED = (5, 2, 1), 1.5, 2, 1024, 4, "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target. ``sizes``: source, source_size. A row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    s = s.withColumn("cap", (max_repeat * F.col("source_size")).cast("double"))
    # sources fill in the order of cap / weight; the level is that of the first prefix after which nobody else is full
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level)
    s = s.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(everything))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def keyed(*what) -> Column:
    return F.xxhash64(F.lit(SEED), *[F.coalesce(w.cast("string"), F.lit("null")) for w in what])


def dealt(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, source, size) with their block, and a row for each source: source_size and its number of blocks."""
    sizes = written(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count(F.lit(1)) / block_docs).cast("long").alias("blocks")), "mix-sources")
    n = sizes.select(F.col("source").alias("__source"), "blocks")
    d = docs.join(n, docs["source"].eqNullSafe(n["__source"])).withColumn("block", F.pmod(keyed(F.lit("block"), F.col("doc_id")), F.col("blocks")))
    return d.select("doc_id", "source", "size", "block"), sizes


def tree(d: DataFrame, sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT, per_shard: int = PER_SHARD) -> DataFrame:
    """The leaves: source, source_size, target, block, block_size, pass (0 is the part), quota (words) and shard."""
    t = targets(sizes.select("source", "source_size"), weights, share, max_repeat)
    t = t.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("rest", F.round(F.col("target")).cast("long") - F.col("passes") * F.col("source_size"))
    b = d.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    b = b.alias("b").join(t.alias("t"), F.expr("b.source <=> t.source")).select("b.*", "t.source_size", "t.target", "t.passes", "t.rest")
    drawn = Window.partitionBy("source").orderBy(keyed(F.lit("draw"), F.col("source"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("block_size"), F.col("rest") - F.coalesce(F.sum("block_size").over(drawn), F.lit(0))))
    copies = F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda p: F.struct(p.alias("pass"), F.when(p == 0, F.col("part")).otherwise(F.col("block_size")).alias("quota")))
    c = b.withColumn("part", part).withColumn("x", F.explode(copies)).select("source", "source_size", "target", "block", "block_size", "x.*").where(F.col("quota") > 0)
    order = ["key", F.col("source"), "block", "pass"]
    c = c.withColumn("key", keyed(F.lit("tree"), F.col("source"), F.col("block"), F.col("pass")))
    c = written(c.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-copies")
    parts = written(c.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "mix-parts")  # a row for each range
    n = collected(parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))[0]["n"]
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    c = c.join(F.broadcast(before), "part").withColumns({"rank": rank, "in_node": F.lit(n).cast("long"), "shard": F.lit(0).cast("long")})
    for _ in range(max(0, round(math.log2(max(1, n) / per_shard)))):
        left = F.floor((F.col("in_node") + 1) / 2)
        right = F.col("rank") >= left
        c = c.select(*[x for x in c.columns if x not in ("rank", "in_node", "shard")], F.when(right, F.col("rank") - left).otherwise(F.col("rank")).alias("rank"), F.when(right, F.col("in_node") - left).otherwise(left).alias("in_node"), (F.col("shard") * 2 + right.cast("long")).alias("shard"))
    return c.drop("key", "part", "before", "rank", "in_node")


def drawn_copies(docs: DataFrame, block_docs: int = BLOCK_DOCS, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (array of pass, shard, words, place), a row for each row of ``docs`` (doc_id, source, size)."""
    d, sizes = dealt(docs, block_docs)
    leaves = written(tree(d, sizes, **how), "mix-tree")
    per_block = leaves.groupBy("source", "block").agg(
        F.sort_array(F.collect_list(F.struct("pass", "shard", "quota"))).alias("leaves"),
        F.max(F.when(F.col("quota") < F.col("block_size"), F.col("quota"))).alias("cut"),
    ).withColumnsRenamed({"source": "__source", "block": "__block"})
    t = targets(sizes.select("source", "source_size"), *[how.get(k, v) for k, v in (("weights", WEIGHTS), ("share", SHARE), ("max_repeat", MAX_REPEAT))]).withColumnRenamed("source", "__of")
    d = d.join(per_block, d["source"].eqNullSafe(F.col("__source")) & (d["block"] == F.col("__block")), "left")
    d = d.join(t, d["source"].eqNullSafe(F.col("__of"))).drop("__source", "__block", "__of")
    # only in a block that a quota cuts does the order of the documents matter; there is one for each source
    order = Window.partitionBy("source", "block").orderBy(keyed(F.lit("doc"), F.col("doc_id")), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inner = d.where("cut IS NOT NULL").withColumn("before", F.sum("size").over(order) - F.col("size"))
    d = inner.unionByName(d.where("cut IS NULL").withColumn("before", F.lit(0).cast("long")))
    of = lambda x: F.when(x["quota"] == F.col("cut"), F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), x["quota"] - F.col("before")))).otherwise(F.col("size"))
    copies = F.transform(
        F.coalesce("leaves", F.array().cast("array<struct<pass:bigint,shard:bigint,quota:bigint>>")),
        lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"), of(x).alias("words"), keyed(F.lit("place"), x["shard"], x["pass"], F.col("doc_id")).alias("place")),
    )
    return d.select("doc_id", "source", "size", "source_size", "target", F.filter(copies, lambda x: x["words"] > 0).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, pass, shard, words, place: every copy that the mix takes, shard by shard, in the shard's own order."""
    c = drawn_copies(docs, **how).select("doc_id", "source", F.explode("copies").alias("x")).select("doc_id", "source", "x.*")
    return c.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place", "doc_id")


def sized(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shards (those that hold a copy) and the copies: a row for each document, taken or not."""
    d = drawn_copies(sized(docs))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    shards = F.array_join(F.transform("copies", lambda x: x["shard"].cast("string")), ",")
    return d.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"), "copies")


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents")).drop("source", "copies")
