"""Search over the index of fields: phrases by positions, web-style queries, and the best of many queries by ranges that are worth reading."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.markdown import parse_query
from marlstone.sources.fielded import HEADING, TEXT, Fielded
from marlstone.sources.scan import Texts
from marlstone.sources.store import collected, drop, written

CHUNK = ["tenant", "id", "seq"]


def phrases(ix: Fielded | Texts, words: DataFrame) -> DataFrame:
    """query_id, part, tenant, id, seq, len, in_heading, in_text: how often the words of a part stand in a chunk as their slots say.

    ``words``: query_id, part, slot, stem; a part of one word is the word. Places are shifted by their slots and
    intersected within a field, for parts of any length; no text is read. Where there is no index, texts are read once for all parts.
    """
    if isinstance(ix, Texts):
        return ix.phrases(words)
    need = words.groupBy("query_id", "part").agg(F.count(F.lit(1)).alias("need"), F.min("slot").alias("first"))
    words = words.join(need, ["query_id", "part"])
    shifted = lambda c: F.transform(c, lambda x: x - (F.col("slot") - F.col("first"))).alias(c)
    hits = ix.of(words).select("query_id", "part", *CHUNK, "len", "need", shifted("heading"), shifted("body"))
    one = hits.where("need = 1").select("query_id", "part", *CHUNK, "len", F.size("heading").alias("in_heading"), F.size("body").alias("in_text"))
    met = hits.where("need > 1").groupBy("query_id", "part", *CHUNK, "len", "need").agg(F.collect_list(F.struct("heading", "body")).alias("l")).where(F.size("l") == F.col("need"))
    common = lambda c: F.size(F.aggregate(F.slice("l", 2, F.size("l")), F.get("l", 0)[c], lambda a, x: F.array_intersect(a, x[c])))
    many = met.select("query_id", "part", *CHUNK, "len", common("heading").alias("in_heading"), common("body").alias("in_text")).where("in_heading + in_text > 0")
    return one.unionByName(many)


def parsed(queries: DataFrame) -> DataFrame:
    """query_id, part, negated, slot, term of web-style queries (query_id, query): a part is a word or a quoted phrase."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q, text in zip(b["query_id"], b["query"]):
                terms, quoted, negated = parse_query(text or "")
                parts = [([t], False) for t in dict.fromkeys(terms)] + [(p, False) for p in quoted] + [([t], True) for t in dict.fromkeys(negated)]
                rows += [(q, n, no, k, t) for n, (words, no) in enumerate(parts) for k, t in enumerate(words)]
            yield pd.DataFrame(rows, columns=["query_id", "part", "negated", "slot", "term"])

    return queries.select("query_id", "query").mapInPandas(run, "query_id string, part int, negated boolean, slot int, term string")


def web_matches(ix: Fielded | Texts, queries: DataFrame, docs: DataFrame | None = None, best: bool = False) -> DataFrame:
    """query_id, tenant, id, seq, rank, strict: chunks that hold a part of a web-style query, and whether they hold all of it.

    Rank is the weighted, length-normalised frequency of the parts. Excluded words are never relaxed: no chunk that holds one
    is there, and of a query that has one, chunks with all parts alone. ``docs`` (tenant, id): those that may be seen.
    ``best``: the best chunk of a document is enough, so that texts give no more.
    """
    weight = F.col("in_heading") * HEADING + F.col("in_text") * TEXT
    if isinstance(ix, Texts):
        m = ix.matches(written(parsed(queries).withColumnRenamed("term", "stem"), "query-words"), best).withColumn("weight", weight)
        if docs is not None and not ix.seen:
            m = m.join(docs.select("tenant", "id"), ["tenant", "id"], "left_semi")
        return m.select("query_id", *CHUNK, F.round(F.col("weight") / (1 + F.ln("len")), 9).alias("rank"), "strict")
    words = written(ix.stemmed(parsed(queries)), "query-words")
    asked = words.groupBy("query_id").agg(F.count_distinct(F.when(~F.col("negated"), F.col("part"))).alias("parts"), F.max("negated").alias("excludes"))
    hits = phrases(ix, words.drop("negated"))
    if docs is not None:
        hits = hits.join(docs.select("tenant", "id"), ["tenant", "id"], "left_semi")
    of = words.select("query_id", "part", "negated").distinct()
    m = hits.join(of, ["query_id", "part"]).groupBy("query_id", *CHUNK).agg(
        F.sum(F.when(~F.col("negated"), weight)).alias("weight"), F.count_if(~F.col("negated")).alias("found"), F.max("negated").alias("out"), F.min("len").alias("len"))
    m = m.where("found > 0 AND NOT out").join(asked, "query_id").withColumn("strict", F.col("found") == F.col("parts"))
    rank = F.round(F.col("weight") / (1 + F.ln("len")), 9)  # so that ties are ties in whatever order weights are summed
    return m.where("strict OR NOT excludes").select("query_id", *CHUNK, rank.alias("rank"), "strict")


def field_rank(ix: Fielded | Texts, words: DataFrame) -> DataFrame:
    """query_id, tenant, id, seq, rank of loose queries (query_id, stem): a word in the heading weighs more than one in the text."""
    if isinstance(ix, Texts):
        parts = words.select("query_id", F.dense_rank().over(Window.partitionBy("query_id").orderBy("stem")).alias("part"), F.lit(False).alias("negated"), F.lit(0).alias("slot"), "stem")
        weight = F.col("in_heading") * HEADING + F.col("in_text") * TEXT
        return ix.matches(parts).select("query_id", *CHUNK, (weight / (1 + F.ln("len"))).alias("rank"))
    weight = F.size("heading") * HEADING + F.size("body") * TEXT
    return ix.of(words).groupBy("query_id", *CHUNK).agg((F.sum(weight) / (1 + F.ln(F.min("len")))).alias("rank"))


def scored(ix: Fielded, words: DataFrame, ranges: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """query_id, id, score: the best chunk of each document by saturated, rarity-weighted frequency; in the ranges given (query_id, range), or all."""
    hits = ix.of(words)
    if ranges is not None:
        hits = hits.join(ranges.select("query_id", "range"), ["query_id", "range"], "left_semi")
    if docs is not None:
        hits = hits.join(docs.select("tenant", "id"), ["tenant", "id"], "left_semi")
    chunks = hits.groupBy("query_id", *CHUNK).agg(F.sum(F.col("idf") * ix.saturated()).alias("score"))
    return chunks.groupBy("query_id", "id").agg(F.round(F.max("score"), 5).alias("score"))


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_documents(ix: Fielded | Texts, words: DataFrame, k: int = 50, docs: DataFrame | None = None, first: int = 8, growth: int = 8, read: list | None = None) -> DataFrame:
    """query_id, id, score, rank: the ``k`` best documents of each query (query_id, stem), the same as of a full scan.

    The best that a query's words have in a range bounds every chunk of it. The most promising ranges of each query are read
    first; the k-th best score so far is a floor, and ranges whose bound lies below it are never read. The number of ranges
    read grows by ``growth`` from wave to wave, so there are few waves, and each is written. ``read`` takes the number of postings
    that each wave reads. Where there is no index, texts are read twice, for the words' rarity and for the scores, and ``docs`` have title and body.
    """
    if isinstance(ix, Texts):
        part = ix if docs is None else Texts.read(docs)
        return _top(part.best(words.select("query_id", "stem").distinct(), k, ix, HEADING / TEXT), k)
    words = written(ix.rarity(words.select("query_id", "stem").distinct()), "rare-words")
    bound = F.sum(F.col("idf") * F.col("best"))
    left = written(ix.best_of(words).groupBy("query_id", "range").agg((F.round(bound, 5) + 1e-5).alias("bound"), F.sum("n").alias("n")), "bounds")
    found = None
    while True:
        w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
        wave = written(left.withColumn("k", F.row_number().over(w)).where(F.col("k") <= first).drop("k"), "wave")
        if read is not None:
            read.append(collected(wave.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))[0]["n"])
        new = scored(ix, words, wave, docs)
        found_now = written(_top(new if found is None else new.unionByName(found.drop("rank")), k), "found")
        floor = found_now.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        rest = left.join(wave.select("query_id", "range"), ["query_id", "range"], "left_anti").join(floor, "query_id", "left")
        rest = written(rest.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))).drop("floor"), "bounds")
        drop(left, wave, *([found] if found is not None else []))
        left, found, first = rest, found_now, first * growth
        if not collected(left.limit(1)):
            break
    drop(left, words)
    return found


