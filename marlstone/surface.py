"""The library in SQL: table functions for lateral joins, over views of what a viewer may see.

``register`` makes the views ``catalog_docs``, ``catalog_links`` and ``catalog_postings`` and the functions

* ``expand(id)``: id, rel, direction of the documents linked to one; nothing where that one may not be seen.
* ``search(query, k)``: id, score, position of the ``k`` best documents for the words of a query.
* ``code_windows(body, size, step)``: a, b, text, windows of lines that overlap.

The first two are SQL, so what calls them is planned with them; the third is a Python table function that checks its arguments when a query
is analysed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from marlstone.operators.search import visible
from marlstone.sources.catalog import view
from marlstone.sources.postings import TERMS, lexical
from marlstone.sources.scan import Texts
from marlstone.sources.store import collected


class CodeWindows:
    @staticmethod
    def analyze(body: AnalyzeArgument, size: AnalyzeArgument, step: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(body.dataType, StringType):
            raise ValueError("code_windows: body must be a string")
        for name, x in (("size", size), ("step", step)):
            if not x.isConstantExpression or not isinstance(x.value, int) or x.value < 1:
                raise ValueError(f"code_windows: {name} must be a whole number above 0")
        return AnalyzeResult(StructType().add("a", IntegerType()).add("b", IntegerType()).add("text", StringType()))

    def eval(self, body: str, size: int, step: int):
        """The last window ends at the last line; null has none."""
        if body is None:
            return
        lines = body.split("\n")
        for a in range(0, max(1, len(lines) - max(0, size - step)), step):
            yield a + 1, min(a + size, len(lines)), "\n".join(lines[a : a + size])


EXPAND = """CREATE OR REPLACE TEMPORARY FUNCTION expand(doc STRING) RETURNS TABLE (id STRING, rel STRING, direction STRING) RETURN
SELECT e.id, e.rel, e.direction FROM catalog_links e WHERE e.focal_id = doc"""

SEARCH = """CREATE OR REPLACE TEMPORARY FUNCTION search(query STRING, k INT) RETURNS TABLE (id STRING, score DOUBLE, position INT) RETURN
SELECT r.id, r.score, r.position FROM (SELECT s.id, s.score, CAST(row_number() OVER (PARTITION BY s.q ORDER BY s.score DESC, s.id) AS INT) AS position
 FROM (SELECT t.q, p.id, round(sum(p.weight), 6) AS score FROM (SELECT query AS q, explode(array_distinct(split(lower(query), '[^a-z0-9]+'))) AS term) t JOIN catalog_postings p ON p.term = t.term GROUP BY t.q, p.id) s) r WHERE r.position <= k"""


def register(spark: SparkSession, sf_dir: str, principal: str, groups: tuple = (), tenant: str = "default", search: bool = True, queries: DataFrame | None = None) -> None:
    """``search``: whether ``search`` is made too, which needs postings. ``queries`` (query): all that will be searched for, if that is known; the
    texts are then read for their words (up to ``TERMS``) and no index is built."""
    docs = visible(view(spark, sf_dir, "docs"), principal, groups, tenant)
    docs.createOrReplaceTempView("catalog_docs")
    links, ids = view(spark, sf_dir, "links").where(F.col("tenant") == tenant), docs.select("id")
    one_way = lambda a, b, name: links.select(F.col(a).alias("focal_id"), F.col(b).alias("id"), "rel", F.lit(name).alias("direction"))
    both = one_way("src_id", "dst_id", "out").unionByName(one_way("dst_id", "src_id", "in"))
    both.join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "focal_id"), "focal_id", "left_semi").createOrReplaceTempView("catalog_links")
    spark.sql(EXPAND)
    spark.udtf.register("code_windows", F.udtf(CodeWindows))
    if search:
        _postings(spark, sf_dir, docs, tenant, queries).createOrReplaceTempView("catalog_postings")
        spark.sql(SEARCH)


def _postings(spark: SparkSession, sf_dir: str, docs: DataFrame, tenant: str, queries: DataFrame | None) -> DataFrame:
    """term, id and weight of the documents that may be seen; how rare a word is follows from all documents."""
    words = None if queries is None else [r["term"] for r in collected(queries.select(F.explode(F.split(F.lower("query"), "[^a-z0-9]+", -1)).alias("term")).distinct().limit(TERMS + 1))]
    if words is None or len(words) > TERMS:
        ix = lexical(spark, sf_dir)
        terms, chunks, found = ix.terms, ix.chunks, ix.postings.where(F.col("tenant") == tenant).join(docs.select("id"), "id", "left_semi")
    else:
        none = F.lit(None).cast("string").alias("heading")
        df, chunks, _ = Texts(view(spark, sf_dir, "docs").select("tenant", "id", none, "body")).counts(words)
        terms, found = F.broadcast(spark.createDataFrame(list(df.items()), "term string, df long")), Texts(docs.select("tenant", "id", none, "body"), seen=True).postings(words)
    idf = terms.select("term", F.ln(1 + (chunks - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") / (1 + F.ln("len"))
    return found.join(idf, "term").select("term", "id", weight.alias("weight"))
