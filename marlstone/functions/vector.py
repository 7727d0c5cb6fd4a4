"""Vector functions over array columns, in double precision and array order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Unit length; zero stays zero."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))[0]


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def signature(a: Column) -> Column:
    """64-bit words, bit i set where a[i] >= 0."""
    word = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.call_function("shiftleft", F.when(F.coalesce(F.get(a, k * 64 + i), F.lit(-1.0)) >= 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")), i)))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(a) - 1) / 64).cast("int"))), word)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
