"""Op 6: line deduplication that returns bitmaps of kept lines, in Spark's own functions.

A line's key is the line without white space at both ends, with A-Z lowered.
Keys of at least ``min_chars`` code points found in at least ``min_docs``
documents lose all their lines, except those in the largest doc_id holding it.

Lines are range-partitioned by the hashes of their keys and sorted there by
key, document (largest first) and position. One pass over that order streams
each key: the document that comes first is the one whose lines stay, and later
documents are numbered as they come. The verdict falls in that pass, so lines
are exchanged once and meet no table of keys.

A frequent-items sketch of fixed size names the keys that hold more than a few
thousandths of all lines. Those are cut into pieces by document, which stream
apart; the pieces' first documents and numbers, a few rows for each such key,
then decide about the key.

The result is a sparse bitmap for each document that loses lines: 64-bit words
whose bits are set where a line stays. Words and documents that lose nothing
are left out. Texts are read again only to apply it.

Defined cases: null or empty text is one empty line; rows that share a doc_id
are one document for the counts, and each is cut on its own; a null doc_id is
a document below all others; a text of any length is one row, and its bitmap
has a word for 64 lines; ties and repeated rows share their key's verdict, as
it falls for whole documents; empty tables give empty results; other columns,
whatever their names, come out as they went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm._shared import collected, hidden, table, written

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT_KEYS, HOT_SHARE, TRACKED, PIECES = 1000, 1000, 8192, 1024  # a key above 1 / HOT_SHARE of all lines is hot, so there are HOT_KEYS at most


def ascii_lower(c: Column) -> Column:
    """A-Z only; lower() is the same, and faster, where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(c: Column) -> Column:
    return ascii_lower(F.btrim(c, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def hot_keys(lines: DataFrame) -> DataFrame:
    """hot: the hashes of keys that hold more than 1 / HOT_SHARE of the lines (and a few below), HOT_KEYS rows at most."""
    top = collected(lines.agg(F.expr(f"approx_top_k(h1, {HOT_KEYS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")))[0]
    least = top["n"] / HOT_SHARE
    found = [(x["item"],) for x in top["top"] or [] if x["count"] > least]
    return lines.sparkSession.createDataFrame(found, "hot long")


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc, text_hash and words: array<struct<w,bits>>, bit ``p % 64`` of word ``p div 64`` set where line p stays."""
    lines = docs.select(
        F.col("doc_id").alias("doc"),
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "key"),
    ).where(F.char_length("key") >= min_chars)
    # two hashes with seeds that differ: 128 bits stand for the key
    lines = written(lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"), "doc", "text_hash", "pos"), "lines")
    piece = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("doc"), F.lit(PIECES)) + 1).otherwise(F.lit(0)).cast("int")
    cut = lines.join(F.broadcast(hot_keys(lines)), F.col("h1") == F.col("hot"), "left").withColumn("piece", piece).drop("hot")
    key = ["h1", "h2", "piece"]
    down = F.col("doc").desc_nulls_last()
    ordered = cut.repartitionByRange(*key).sortWithinPartitions(*key, down, "pos")
    group = Window.partitionBy(*key)
    stream = ordered.withColumns({"first": F.first("doc").over(group.orderBy(down, "pos")), "nth": F.dense_rank().over(group.orderBy(down))})
    stream = stream.withColumn("docs", F.max("nth").over(group))
    gone = (F.col("piece") > 0) | ((F.col("nth") > 1) & (F.col("docs") >= min_docs))
    gone = written(stream.where(gone).select("h1", "h2", "piece", "doc", "text_hash", "pos", "first", "docs"), "lines-gone")
    pieces = gone.where("piece > 0").groupBy(*key).agg(F.max("docs").alias("docs"), F.max("first").alias("first"))
    hot = written(pieces.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("first").alias("keeper")).where(F.col("docs") >= min_docs).drop("docs"), "lines-hot")
    frequent = gone.where("piece > 0").join(hot, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    gone = gone.where("piece = 0").select("doc", "text_hash", "pos").unionByName(frequent.select("doc", "text_hash", "pos"))
    words = gone.groupBy("doc", "text_hash", F.expr("pos div 64").cast("int").alias("w")).agg(F.expr("~bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return words.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("w", "bits")).alias("words"))


def dropped_positions(words: Column) -> Column:
    bits = F.sequence(F.lit(0), F.lit(63))
    return F.flatten(F.transform(words, lambda x: F.transform(F.filter(bits, lambda b: F.call_function("getbit", x["bits"], b) == 0), lambda b: x["w"] * 64 + b)))


def _cut(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, dict]:
    """``docs`` under names of our own (the second result has them), with __lines, __gone (null if nothing goes) and __text."""
    bitmaps = keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs)
    mine, own = hidden(docs)
    keyed = mine.withColumn("__hash", F.xxhash64(own["text"]))
    marks = bitmaps.select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__text_hash"), "words")
    out = keyed.join(marks, F.col(own["doc_id"]).eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__text_hash")), "left")
    out = out.withColumns({"__lines": lines_of(F.col(own["text"])), "__gone": F.when(F.col("words").isNotNull(), dropped_positions(F.col("words")))})
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone")), lambda i: F.get(F.col("__lines"), i))
    return out.withColumn("__text", F.when(F.col("__gone").isNull(), F.col(own["text"])).otherwise(F.array_join(kept, "\n"))), own


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, recount: str | None = None) -> DataFrame:
    """``docs`` with its columns, texts without the lines that go; of cut texts, the column named by ``recount`` gets the code points."""
    out, own = _cut(docs, min_chars, min_docs)
    new = {"text": F.col("__text")}
    if recount:
        new[recount] = F.when(F.col("__gone").isNotNull(), F.char_length("__text").cast(docs.schema[recount].dataType)).otherwise(F.col(own[recount]))
    return out.select(*[new.get(c, F.col(own[c])).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and the text that is left, for each row of ``docs`` (doc_id, text)."""
    out, own = _cut(docs.select("doc_id", "text"), min_chars, min_docs)
    return out.select(
        F.col(own["doc_id"]).alias("doc_id"), F.size("__lines").cast("long").alias("n_lines"),
        F.greatest(F.coalesce(F.size("__gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_dropped"), F.col("__text").alias("text"),
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, parts[i] AS line,
    translate(trim(parts[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), f AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT l.*, coalesce(f.keeper > l.doc_id, false) AS gone FROM l LEFT JOIN f USING (key))
GROUP BY doc_id
"""
