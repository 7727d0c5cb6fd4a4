"""Hand-computed values of scalar functions."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import ranking, text, vector


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("identifier,want", [
    ("parseHTTPResponse", ["parse", "http", "response"]),
    ("OAuth2Client", ["oauth2", "oauth", "client"]),
    ("sha256Hash", ["sha256", "sha", "256", "hash"]),
    ("aB", []),
])
def test_subtokens(spark, identifier, want):
    assert one(spark, text.subtokens(F.lit(identifier))) == want


@pytest.mark.parametrize("query,want", [
    ("PAY-981", "entity"), ("UTF-8 encoding", "docs"), ("src/a/b.py", "path"), ('say "hello there"', "exact"), ("BootException now", "exact"), ("handleRetry", "symbol"), ("how do retries work", "docs"),
])
def test_route(spark, query, want):
    assert one(spark, text.classify_route(F.lit(query))) == want


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, vector.signature(v(0.5, -0.2, 0, -1))) == [0b0101]
    assert one(spark, vector.hamming(vector.signature(v(1, -1, 1, -1)), vector.signature(v(-1, 1, -1, 1)))) == 4
    assert one(spark, vector.cosine(v(0, 0), v(1, 0))) == 0.0
    assert one(spark, vector.unit(v(3, 4))) == [0.6, 0.8]


def test_modifier(spark):
    assert one(spark, ranking.modifier(F.lit("authored"), F.lit(180))) == pytest.approx(0.8)
    assert one(spark, ranking.modifier(F.lit("raw"), F.lit(None).cast("int"))) == pytest.approx(0.48)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
