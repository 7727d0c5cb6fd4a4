"""Op 11: exact deduplication by two-pass Bloom filtering, in Spark's own functions.

Two rows are copies when their texts are identical (null is the empty text); the
one with the largest doc_id stays.

Pass 1 counts, for the two slots that each text's hash names in a filter, how
many rows name them; only slot numbers and counts are exchanged, combined on
the map side first. Slots named twice or more make up the filter. Equal texts
name the same slots, so a row with a slot that was named once has no copy.

Pass 2 tests every row against the filter, which is broadcast. Rows that it
clears pass straight through and meet no exchange. The others are grouped by
SHA-256 of the text, which decides; a false alarm is a group of one row.

A filter has ``FILTER_BITS`` bits at every size, so what is broadcast is at most
``FILTER_BITS`` / 64 words. Hashes are dealt to as many filters as keep them
thinly filled, and these are applied one after another: rows that a filter
suspects are written before the next filter is broadcast.

Groups of at least one in ``HOT_SHARE`` rows, so ``HOT_SHARE`` at most, meet
their rows by a broadcast; all other groups are too small to weigh on one task.

Defined cases: null and empty texts are equal; a null doc_id ranks below all
others; of rows that tie on doc_id and text exactly one stays; a text of any
length is one row; an empty table gives an empty result; other columns,
whatever their names, come out as they went in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm._shared import collected, hidden, table, written

FILTER_BITS = 1 << 26  # 8 MB of bits, 1 << 20 words
ROWS_PER_FILTER = FILTER_BITS // 8
HOT_SHARE = 1000


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _slots(h: Column) -> Column:
    """The two slots of a hash: bits 0 to 25 and 32 to 57."""
    return F.array(h.bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(FILTER_BITS - 1)))


def repeated_slots(hashes: DataFrame) -> DataFrame:
    """word, bits: the slots that two or more rows of ``hashes`` (h) name, 64 to a word."""
    slots = hashes.select(F.explode(_slots(F.col("h"))).alias("slot")).groupBy("slot").count().where("count > 1")
    return slots.groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias("bits"))


def _tested(rows: DataFrame, filt: DataFrame) -> DataFrame:
    """``rows`` (with __h) and __suspect: whether both slots are in the filter."""
    out = rows
    for k in (0, 1):
        f = F.broadcast(filt.select(F.col("word").alias(f"__w{k}"), F.col("bits").alias(f"__b{k}")))
        out = out.join(f, F.floor(_slots(F.col("__h"))[k] / 64) == F.col(f"__w{k}"), "left")
    hit = [F.coalesce(F.call_function("getbit", F.col(f"__b{k}"), F.pmod(_slots(F.col("__h"))[k], F.lit(64)).cast("int")) == 1, F.lit(False)) for k in (0, 1)]
    return out.withColumn("__suspect", hit[0] & hit[1]).drop("__w0", "__w1", "__b0", "__b1")


def _groups(suspects: DataFrame, n: int) -> DataFrame:
    """``suspects`` (__id, __row, __sha) with keep_id, keep_row and size of their group."""
    groups = suspects.groupBy("__sha").agg(F.max(F.struct(F.col("__id").alias("id"), F.col("__row").alias("row"))).alias("k"), F.count(F.lit(1)).alias("__size"))
    groups = written(groups.select("__sha", F.col("k.id").alias("__keep_id"), F.col("k.row").alias("__keep_row"), "__size"), "copies")
    hot = groups.where(F.col("__size") * HOT_SHARE >= n)
    marked = suspects.join(F.broadcast(hot), "__sha", "left")
    small = suspects.join(F.broadcast(hot.select("__sha")), "__sha", "left_anti").join(groups.where(F.col("__size") * HOT_SHARE < n), "__sha")
    return marked.where("__size IS NOT NULL").unionByName(small)


def marked(docs: DataFrame) -> tuple[DataFrame, dict]:
    """``docs`` under names of our own (the second result has them), with __keep_id, __size and __kept."""
    mine, own = hidden(docs)
    rows = mine.withColumn("__h", F.xxhash64(text_of(F.col(own["text"]))))
    n = collected(docs.agg(F.count(F.lit(1)).alias("n")))[0]["n"]
    filters = -(-n // ROWS_PER_FILTER) or 1
    straight, suspects = [], []
    for k in range(filters):
        part = rows if filters == 1 else rows.where(F.pmod(F.xxhash64(F.lit("filter"), "__h"), F.lit(filters)) == k)
        tested = _tested(part, written(repeated_slots(part.select(F.col("__h").alias("h"))), "slots"))
        straight.append(tested.where("NOT __suspect").drop("__h", "__suspect"))
        found = tested.where("__suspect").drop("__h", "__suspect").withColumns({"__id": F.col(own["doc_id"]), "__sha": F.sha2(text_of(F.col(own["text"])), 256)})
        suspects.append(written(found.withColumns({"__row": F.monotonically_increasing_id(), "__filter": F.lit(k)}), "suspects"))
    # numbers of rows are compared within a group, which is within a filter
    grouped = _groups(reduce(DataFrame.unionByName, suspects), n).withColumn("__kept", F.col("__row") == F.col("__keep_row"))
    alone = reduce(DataFrame.unionByName, straight).withColumns({"__keep_id": F.col(own["doc_id"]), "__size": F.lit(1).cast("long"), "__kept": F.lit(True)})
    cols = [*own.values(), "__keep_id", "__size", "__kept"]
    return alone.select(*cols).unionByName(grouped.select(*cols)), own


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    out, own = marked(docs)
    return out.where("__kept").select(*[F.col(own[c]).alias(c) for c in docs.columns])


def copies_report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text, for each row of ``docs`` (doc_id, text)."""
    out, own = marked(docs.select("doc_id", "text"))
    return out.select(F.col(own["doc_id"]).alias("doc_id"), F.col("__keep_id").alias("keep_id"), F.col("__size").alias("group_size"), F.col("__kept").alias("kept"), text_of(F.col(own["text"])).alias("text"))


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = copies_report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.sha2("text", 256).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
