"""Op 7: quality rules with adaptive thresholds, in Spark's own functions.

Each text gets word, symbol, line and repetition counts. Four integer rates
are gathered into quantile sketches for each language and source: histograms
with buckets of 6 significant bits (relative error below 1/32), which merge
by adding counts, exactly and in any order, so reruns agree. Thresholds are a low
and a high quantile (deciles of word lengths, quartiles of rates that are zero
in most texts) widened by ``FENCE`` times their distance. A group's quantiles are drawn
to its language's, and those to the whole corpus's, as if ``WEIGHT`` texts of
the wider group came with it, so a group's own texts count the more the more
there are, at every size. The thresholds are joined back and applied.

Defined cases: null text has no words and fails the base rules; null language
or source is a group of its own; texts of any length are measured whole, by
arrays of their words; values that tie share a bucket; empty tables give empty
results; repeated rows are judged alike; other columns are left alone,
whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm._shared import collected, table, written

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS, FENCE, WEIGHT = 50, 3, 100
GROUPS = 100_000  # so many groups' fences are broadcast at most, some ten megabytes
#: Rate, share of the texts in each tail (one in so many), least distance of the quantiles, whether a low value is bad too.
RATES = (("r_length", 10, 20, True), ("r_symbols", 4, 40, False), ("r_lines", 4, 100, False), ("r_repeats", 4, 100, False))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES, -1))


def repeat_words(windows: str) -> Column:
    """Words in 3-word windows that occur twice: sort hashes with their places, mark equal neighbours, return to text order."""
    packed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows)

    def marks(s: Column) -> Column:
        return F.sort_array(
            F.filter(
                F.transform(s, lambda x, k: F.when(x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"]), x["i"])),
                lambda i: i.isNotNull(),
            )
        )

    def covered(m: Column) -> Column:
        """Each marked window covers 3 words; what it shares with the next one counts once."""
        return F.aggregate(
            F.transform(m, lambda i, k: F.when(F.get(m, k + 1).isNull(), 3).otherwise(F.least(F.lit(3), F.get(m, k + 1) - i))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    once = F.transform(F.array(packed), lambda s: covered_of(s, marks, covered))
    return F.when(n < 2, F.lit(0).cast("long")).when(F.size(F.array_distinct(windows)) == n, F.lit(0).cast("long")).otherwise(F.get(once, F.lit(0)))


def covered_of(s: Column, marks, covered) -> Column:
    return F.get(F.transform(F.array(marks(s)), covered), F.lit(0))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.withColumn("__w", words_of(F.col("text")))
    d = d.withColumn(
        "__h",
        F.when(F.size("__w") < 4, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(F.get(F.col("__w"), i), F.get(F.col("__w"), i + 1), F.get(F.col("__w"), i + 2)))
        ),
    )
    d = d.withColumn("__l", F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    return d.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": repeat_words("__h"),
    }).drop("__w", "__h", "__l")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bucket(v: Column) -> Column:
    """The 6 leading bits of v, the rest zero."""
    shift = F.greatest(F.char_length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def rates(d: DataFrame) -> DataFrame:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return d.withColumns({
        "r_length": F.floor(100 * F.col("word_chars") / words).cast("long"),
        "r_symbols": F.floor(1000 * F.col("n_symbols") / words).cast("long"),
        "r_lines": F.floor(1000 * F.col("n_dup_lines") / lines).cast("long"),
        "r_repeats": F.floor(1000 * F.col("n_repeat_words") / words).cast("long"),
    })


def sketches(d: DataFrame) -> DataFrame:
    """lang, source, rate, bucket, n: the mergeable sketch of each group, over texts that pass the base rules."""
    one = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bucket(F.col(r)).alias("bucket")) for r, _, _, _ in RATES])).alias("x")
    return d.where(~base_failed()).select("lang", "source", one).groupBy("lang", "source", "x.rate", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """total, and the low and the high quantile, of each rate in the groups by ``keys``."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rate")
    merged = merged.withColumns({"total": F.sum("n").over(w), "cum": F.sum("n").over(w.orderBy("bucket"))})
    tail = F.expr("CASE rate " + " ".join(f"WHEN '{r}' THEN {t}" for r, t, _, _ in RATES) + " END")
    q = lambda p: F.min(F.when(F.col("cum") * tail >= F.col("total") * p, F.col("bucket")))
    return merged.groupBy(*keys, "rate").agg(F.max("total").alias("total"), q(F.lit(1)).alias("low"), q(tail - 1).alias("high"))


def fences(sketch: DataFrame, weight: int = WEIGHT, fence: int = FENCE) -> DataFrame:
    """lang, source and for each rate its lowest and highest accepted value."""
    by_source, by_lang, by_all = quantiles(sketch, ["lang", "source"]), quantiles(sketch, ["lang"]), quantiles(sketch, [])
    b = by_source.alias("s").join(by_lang.alias("l"), F.expr("s.rate = l.rate AND s.lang <=> l.lang")).join(by_all.alias("a"), F.expr("s.rate = a.rate"))
    drawn = lambda c: F.expr(f"(s.total * s.{c} + {weight} * ((l.total * l.{c} + {weight} * a.{c}) div (l.total + {weight}))) div (s.total + {weight})")
    b = b.select("s.lang", "s.source", "s.rate", drawn("low").alias("low"), drawn("high").alias("high"))
    aggs = []
    for r, _, least, low in RATES:
        mine, spread = F.col("rate") == r, fence * F.greatest(F.col("high") - F.col("low"), F.lit(least))
        aggs.append(F.max(F.when(mine, F.col("high") + spread)).alias(f"hi_{r}"))
        if low:
            aggs.append(F.max(F.when(mine, F.col("low") - spread)).alias(f"lo_{r}"))
    return b.groupBy("lang", "source").agg(*aggs)


def judge(docs: DataFrame, weight: int = WEIGHT, fence: int = FENCE) -> DataFrame:
    """``docs`` (already measured, with lang and source) with base_failed and kept. ``docs`` should be cheap to read twice."""
    d = rates(docs)
    f = written(fences(sketches(d), weight, fence).withColumnsRenamed({"lang": "__lang", "source": "__source"}), "fences")
    if collected(f.agg(F.count(F.lit(1)).alias("n")))[0]["n"] <= GROUPS:  # else the texts go to the fences
        f = F.broadcast(f)
    out = d.join(f, d["lang"].eqNullSafe(f["__lang"]) & d["source"].eqNullSafe(f["__source"]), "left")
    inside = [F.col(r) <= F.col(f"hi_{r}") for r, _, _, _ in RATES] + [F.col(r) >= F.col(f"lo_{r}") for r, _, _, low in RATES if low]
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(reduce(lambda a, b: a & b, inside), F.lit(True)))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, __hash (of the text), the counts and the verdict; the texts are read once."""
    counts = measure(docs.select("doc_id", "lang", "source", "text", F.xxhash64("text").alias("__hash"))).drop("text")
    return judge(written(counts, "quality"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns. Texts are written once with their counts, so that the verdicts need no join with them."""
    own = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c not in ("lang", "source", "text")}
    m = written(measure(docs.withColumnsRenamed(own)), "measured")
    out = judge(m).where("kept")
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, i, w[i] || chr(32) || w[i+1] || chr(32) || w[i+2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1) GROUP BY rid
), m AS (
  SELECT t.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS u_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN rep USING (rid)
), d AS (
  SELECT *, n_lines - u_lines AS n_dup_lines, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    100 * word_chars // greatest(n_words, 1) AS r_length, 1000 * n_symbols // greatest(n_words, 1) AS r_symbols,
    1000 * (n_lines - u_lines) // greatest(n_lines, 1) AS r_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS r_repeats FROM m
), s AS (
  SELECT lang, source, rate, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket, count(*) AS n FROM (
    SELECT lang, source, 'r_length' AS rate, r_length AS v FROM d WHERE NOT base_failed UNION ALL
    SELECT lang, source, 'r_symbols', r_symbols FROM d WHERE NOT base_failed UNION ALL
    SELECT lang, source, 'r_lines', r_lines FROM d WHERE NOT base_failed UNION ALL
    SELECT lang, source, 'r_repeats', r_repeats FROM d WHERE NOT base_failed) GROUP BY ALL
), qs AS (
  SELECT lang, source, rate, max(total) AS total, min(bucket) FILTER (WHERE cum * (CASE rate WHEN 'r_length' THEN 10 ELSE 4 END) >= total) AS low,
    min(bucket) FILTER (WHERE cum * (CASE rate WHEN 'r_length' THEN 10 ELSE 4 END) >= total * (CASE rate WHEN 'r_length' THEN 9 ELSE 3 END)) AS high
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, rate) AS total, sum(n) OVER (PARTITION BY lang, source, rate ORDER BY bucket) AS cum FROM s) GROUP BY ALL
), ql AS (
  SELECT lang, rate, max(total) AS total, min(bucket) FILTER (WHERE cum * (CASE rate WHEN 'r_length' THEN 10 ELSE 4 END) >= total) AS low,
    min(bucket) FILTER (WHERE cum * (CASE rate WHEN 'r_length' THEN 10 ELSE 4 END) >= total * (CASE rate WHEN 'r_length' THEN 9 ELSE 3 END)) AS high
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, rate) AS total, sum(n) OVER (PARTITION BY lang, rate ORDER BY bucket) AS cum FROM (SELECT lang, rate, bucket, sum(n) AS n FROM s GROUP BY ALL)) GROUP BY ALL
), qa AS (
  SELECT rate, max(total) AS total, min(bucket) FILTER (WHERE cum * (CASE rate WHEN 'r_length' THEN 10 ELSE 4 END) >= total) AS low,
    min(bucket) FILTER (WHERE cum * (CASE rate WHEN 'r_length' THEN 10 ELSE 4 END) >= total * (CASE rate WHEN 'r_length' THEN 9 ELSE 3 END)) AS high
  FROM (SELECT *, sum(n) OVER (PARTITION BY rate) AS total, sum(n) OVER (PARTITION BY rate ORDER BY bucket) AS cum FROM (SELECT rate, bucket, sum(n) AS n FROM s GROUP BY ALL)) GROUP BY ALL
), f AS (
  SELECT qs.lang, qs.source, qs.rate,
    (qs.total * qs.low + 100 * ((ql.total * ql.low + 100 * qa.low) // (ql.total + 100))) // (qs.total + 100) AS low,
    (qs.total * qs.high + 100 * ((ql.total * ql.high + 100 * qa.high) // (ql.total + 100))) // (qs.total + 100) AS high,
    CASE qs.rate WHEN 'r_length' THEN 20 WHEN 'r_symbols' THEN 40 ELSE 100 END AS least
  FROM qs JOIN ql ON qs.rate = ql.rate AND qs.lang IS NOT DISTINCT FROM ql.lang JOIN qa ON qs.rate = qa.rate
), g AS (
  SELECT lang, source,
    max(high + 3 * greatest(high - low, least)) FILTER (WHERE rate = 'r_length') AS hl, max(low - 3 * greatest(high - low, least)) FILTER (WHERE rate = 'r_length') AS ll,
    max(high + 3 * greatest(high - low, least)) FILTER (WHERE rate = 'r_symbols') AS hs, max(high + 3 * greatest(high - low, least)) FILTER (WHERE rate = 'r_lines') AS hi,
    max(high + 3 * greatest(high - low, least)) FILTER (WHERE rate = 'r_repeats') AS hr
  FROM f GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(r_length <= hl AND r_symbols <= hs AND r_lines <= hi AND r_repeats <= hr AND r_length >= ll, true) AS kept
FROM d LEFT JOIN g ON d.lang IS NOT DISTINCT FROM g.lang AND d.source IS NOT DISTINCT FROM g.source
"""
