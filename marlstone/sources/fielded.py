"""The index of fields: postings with positions in heading and text, stemmed or plain, in ranges of documents with their best score.

A posting is a row for a stem in a chunk: its places among the words of the heading
and of the text. The English configuration leaves stop words out, but they keep
their places, so phrases count them. Documents are dealt to ranges by their id, about
``PER_RANGE`` chunks to each; what a stem can add to any chunk of a range, up to its
rarity, is kept beside the postings, so that a search can leave ranges out unread.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.stem import STOP, stems
from marlstone.sources.catalog import sections, terms
from marlstone.sources.store import collected, drop, state, written

PER_RANGE = 64
WORDS = 50_000  # words of one batch of queries that are looked up by value
# What a term weighs in the heading and in the text, and the constants of the saturated score.
HEADING, TEXT = 1.0, 0.2
K1, B = 1.2, 0.75
_built: dict = {}


class Fielded(NamedTuple):
    postings: DataFrame  # stem, range, tenant, id, seq, heading, body (array<int>), len
    best: DataFrame  # stem, range, best (the most that saturation gives in the range), n (postings)
    terms: DataFrame  # stem, df, cf
    chunks: int
    avgdl: float
    ranges: int
    english: bool

    def of(self, words: DataFrame) -> DataFrame:
        """Postings of a table of words (stem). Files are laid out by stem, so a few stems read a few row groups."""
        return self._met(self.postings, words)

    def best_of(self, words: DataFrame) -> DataFrame:
        return self._met(self.best, words)

    def _met(self, table: DataFrame, words: DataFrame) -> DataFrame:
        some = [r["stem"] for r in collected(words.select("stem").limit(WORDS + 1))]
        if len(some) > WORDS:
            return table.join(words, "stem")
        return table.where(F.col("stem").isin(sorted(set(some)))).join(F.broadcast(words), "stem")

    def rarity(self, words: DataFrame) -> DataFrame:
        """``words`` with df and idf; those that no chunk holds are left out."""
        df = F.col("df")
        met = self.terms.join(words, "stem")
        return met.drop("cf").withColumn("idf", F.ln(1 + (self.chunks - df + 0.5) / (df + 0.5)))

    def saturated(self) -> Column:
        """What a posting adds to its chunk's score, but for the stem's rarity."""
        tf = F.size("heading") * (HEADING / TEXT) + F.size("body")
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(self.avgdl)))

    def stemmed(self, words: DataFrame) -> DataFrame:
        """``words`` (term and what else) with stem in place of term; words that are not indexed are left out."""
        if not self.english:
            return words.withColumnRenamed("term", "stem")
        kept = words.where(~F.col("term").isin(STOP))
        return kept.join(stems(kept), "term").drop("term")


def _occurrences(chunks: DataFrame, english: bool) -> DataFrame:
    """tenant, id, seq, len, term, heading, body: words are sorted in their chunk's row, where equal ones stand side by side."""
    at = lambda words, field: F.transform(words, lambda t, i: F.struct(t.alias("term"), F.lit(field).alias("field"), i.alias("at")))
    words = F.concat(at(F.coalesce(terms(F.col("heading")), F.array().cast("array<string>")), 0), at(terms(F.col("text")), 1))
    c = chunks.select("tenant", "id", "seq", words.alias("w")).withColumn("len", F.size("w"))
    if english:
        c = c.withColumn("w", F.filter("w", lambda x: ~x["term"].isin(STOP)))
    c = c.withColumn("w", F.sort_array("w"))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda k: (k == 1) | (F.get("w", k - 2)["term"] != F.get("w", k - 1)["term"]))
    c = c.where(F.size("w") > 0).withColumn("starts", places)
    run = lambda p, k: F.slice("w", p, F.coalesce(F.get("starts", k + 1), F.size("w") + 1) - p)
    c = c.select("tenant", "id", "seq", "len", F.explode(F.transform("starts", run)).alias("x"))
    of = lambda field: F.transform(F.filter("x", lambda o: o["field"] == field), lambda o: o["at"])
    return c.select("tenant", "id", "seq", "len", F.get("x", 0)["term"].alias("term"), of(0).alias("heading"), of(1).alias("body"))


def build(chunks: DataFrame, english: bool) -> Fielded:
    """The index of chunks (tenant, id, seq, heading, text)."""
    size = F.size(terms(F.coalesce("heading", F.lit("")))) + F.size(terms(F.col("text")))
    n = collected(chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(size).alias("avgdl")))[0]
    found = written(_occurrences(chunks, english), "occurrences")
    keyed = found.withColumnRenamed("term", "stem")
    if english:
        stem_of = written(stems(found), "stems")
        keyed = found.join(stem_of, "term").groupBy("stem", "tenant", "id", "seq", "len").agg(*[F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in ("heading", "body")])
    ranges = max(1, round(n["n"] / PER_RANGE))
    keyed = keyed.withColumn("range", F.pmod(F.xxhash64("tenant", "id"), F.lit(ranges)).cast("int"))
    laid = keyed.select("stem", "range", "tenant", "id", "seq", "heading", "body", "len").repartitionByRange("stem", "range").sortWithinPartitions("stem", "range", "tenant", "id", "seq")
    postings = written(laid, "fielded")
    drop(found, *([stem_of] if english else []))
    ix = Fielded(postings, postings, postings, n["n"], n["avgdl"] or 1.0, ranges, english)
    best = written(postings.groupBy("stem", "range").agg(F.max(ix.saturated()).alias("best"), F.count(F.lit(1)).alias("n")).repartitionByRange("stem").sortWithinPartitions("stem", "range"), "best")
    counts = written(postings.groupBy("stem").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("heading") + F.size("body")).alias("cf")), "stem-counts")
    return ix._replace(best=best, terms=counts)


def fielded(spark: SparkSession, sf_dir: str, english: bool = True) -> Fielded:
    """The index of the documents of a folder, built when it is first asked for and after they change."""
    key, now = (spark.sparkContext.applicationId, sf_dir, english), state(spark, f"{sf_dir}/documents.parquet")
    if key not in _built or _built[key][0] != now:
        _built[key] = now, build(sections(spark, sf_dir), english)
    return _built[key][1]
