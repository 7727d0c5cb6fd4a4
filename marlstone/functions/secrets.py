"""Secrets in texts: shapes that are secrets by themselves, and tokens too even to be words; with a hint that does not tell them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules by shape, and bits a character from which a token of hexadecimal or of base-64 characters is no word.
SHAPES = {"aws-key-id": r"\bAKIA[0-9A-Z]{16}\b", "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----", "jwt": r"\beyJ[\w-]+\.eyJ[\w-]+\.[\w-]+", "url-credentials": r"://[^\s/@:]+:[^\s/@]+@"}
TOKEN, HEX = r"[A-Za-z0-9+/=_-]{20,}", r"^[0-9a-fA-F]{32,}$"
HEX_BITS, BASE64_BITS = 3.0, 4.5
#: longer tokens are measured piece by piece, since what surrounds a secret may be dull
LONG, PIECE, STEP = 64, 40, 20


def entropy(s: Column) -> Column:
    """Bits a character of a string, from the counts of its characters; 0 for the empty string."""
    n = F.char_length(s)
    chars = F.filter(F.array_distinct(F.split(s, "")), lambda c: c != "")
    share = lambda c: (n - F.char_length(F.replace(s, c, F.lit("")))) / n
    return F.round(F.aggregate(F.transform(chars, share), F.lit(0.0), lambda a, p: a - p * F.log2(p)), 9)


def pieces(token: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(token) - PIECE + 1), F.lit(STEP))
    return F.when(F.char_length(token) <= LONG, F.array(token)).otherwise(F.transform(starts, lambda k: F.substr(token, k, F.lit(PIECE))))


def too_even(token: Column) -> Column:
    """hex-entropy or base64-entropy, by the token's most even piece; null for what may be a word."""
    most = F.array_max(F.transform(pieces(token), entropy))
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return F.when(token.rlike(HEX) & mixed & (most >= HEX_BITS), "hex-entropy").when(mixed & (most >= BASE64_BITS), "base64-entropy")


def hint(secret: Column) -> Column:
    """What tells secrets apart without telling them: four characters and the head of a digest."""
    return F.concat(F.substring(secret, 1, 4), F.lit(":"), F.substring(F.sha2(secret, 256), 1, 8))


def findings(docs: DataFrame, key: str, accepted: DataFrame | None = None) -> DataFrame:
    """``key``, rule, hint, start: each secret of a text of ``docs`` (key, text) once, at its first place (from 1); without those ``accepted`` (rule, hint).

    Null and empty texts have none; rows that share a key are searched each on its own.
    """
    t = F.col("text")
    ruled = lambda name, p: F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda s: F.struct(F.lit(name).alias("rule"), s.alias("secret")))
    shaped = F.flatten(F.array(*[ruled(name, p) for name, p in SHAPES.items()]))
    even = F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))), lambda s: F.struct(too_even(s).alias("rule"), s.alias("secret")))
    found = F.array_distinct(F.filter(F.concat(shaped, even), lambda x: x["rule"].isNotNull()))
    rows = docs.select(key, "text", F.explode(found).alias("x"))
    out = rows.select(key, "x.rule", hint(F.col("x.secret")).alias("hint"), F.instr(t, F.col("x.secret")).alias("start"))
    return out if accepted is None else out.join(accepted.select("rule", "hint").distinct(), ["rule", "hint"], "left_anti").select(*out.columns)
