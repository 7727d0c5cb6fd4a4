"""Op 12: mergeable quantile summaries: greedy histograms of buckets (low, high, count).

A summary of integers (scale other numbers first) is a list of disjoint buckets
in order. Packing walks the distinct values with their counts: values whose
cumulative counts end in the same of ``WINDOWS`` equal windows share a bucket,
so one holds less than 2 / ``WINDOWS`` of the rows; a value that fills a window,
and the two least and two greatest, stand alone, and all do where there are no
more than ``WINDOWS``. So a summary has at most ``2 * WINDOWS + 5`` buckets.

Merging takes all buckets of the summaries, cuts those that overlap at each
other's ends, spreads their counts evenly over the integers they span, and packs
again. A rank read off at the end of a bucket is off by no more than what the
buckets of the merged summaries that span it held; summaries of disjoint ranges
lose nothing by merging.

How it runs: values are counted (combined on the map side), dealt by ranges of
group and value, and sorted. Each task summarises its runs, and only a group at
the edge of a range can go on in the next one: such pieces, adjacent ranges, are
merged ``FAN`` at a time until one is left. No group is ever whole in one task
but as a summary, and nothing is collected but the number of ranges.

``exact_ranks`` counts, over the same dealt values, where answers stand: a task
sums its own range, and sums of ranges (one row for each group in a range) give
what lies before it.

Defined cases: rows without a value are left out (null groups and batches are
groups like others); a summary of no rows does not exist; repeated rows and ties
count; an empty table gives an empty result; other columns are ignored. Values
are whole numbers below 2**52 in size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm._shared import collected, table, written

WINDOWS = 180
FAN = 16
BUFFER = 1 << 18
BUCKETS = "array<struct<low:bigint,high:bigint,count:bigint>>"


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and 0, 1, ... counts[r] - 1 for every row r."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _sizes(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each run of equal values."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(group)))


def pack(group: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> tuple:
    """Disjoint buckets, in order within each group, packed: group, low, high, count."""
    first, size = _sizes(group)
    if not len(first):
        return group, low, high, count
    total = np.repeat(np.add.reduceat(count, first), size)
    end = np.cumsum(count)
    end -= np.repeat(end[first] - count[first], size)
    place = np.arange(len(group)) - np.repeat(first, size)
    many = np.repeat(size, size)
    alone = (many <= WINDOWS) | (count * WINDOWS >= total) | (place < 2) | (place >= many - 2)
    window = ((end - 1) * (WINDOWS / total)).astype(np.int64)
    new = alone | (place == 0)
    new[1:] |= alone[:-1] | (window[1:] != window[:-1])
    at = np.flatnonzero(new)
    return group[at], low[at], high[np.append(at[1:], len(new)) - 1], np.add.reduceat(count, at)


def merge(group: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> tuple:
    """Buckets of any summaries of a group, overlaps cut and spread, in order: group, low, high, count, not packed."""
    m = len(group)
    ends, own = np.concatenate([low, high + 1]), np.concatenate([group, group])
    by = np.lexsort((ends, own))
    new = np.append(True, (ends[by][1:] != ends[by][:-1]) | (own[by][1:] != own[by][:-1])) if m else np.zeros(0, bool)
    knot_of = np.empty(2 * m, np.int64)
    knot_of[by] = np.cumsum(new) - 1
    knot, knot_group = ends[by][new], own[by][new]
    row, k = _spread(knot_of[m:] - knot_of[:m])
    seg = knot_of[:m][row] + k
    width = (high - low + 1)[row].astype(float)
    part = lambda at: np.floor(count[row] * ((knot[at] - low[row]) / width)).astype(np.int64)
    sums = np.zeros(len(knot), np.int64)
    if len(seg):
        np.add.at(sums, seg, part(seg + 1) - part(seg))
    at = np.flatnonzero(sums)
    return knot_group[at], knot[at], knot[np.minimum(at + 1, len(knot) - 1)] - 1, sums[at]


def answers(group: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets, targets and answers (a column for each i from 1 to parts - 1) of each summary."""
    first, size = _sizes(group)
    end = np.cumsum(count)
    before = end[first] - count[first] if len(first) else end
    n = np.add.reduceat(count, first) if len(first) else end
    target = -(-np.arange(1, parts)[None, :] * n[:, None] // parts)
    b = np.searchsorted(end, (before[:, None] + target).ravel()).reshape(target.shape)
    if len(first):
        inside = before[:, None] + target - (end[b] - count[b])  # 1 .. count
        width = high[b] - low[b] + 1
        answer = low[b] + np.clip(np.ceil(inside * (width / count[b])).astype(np.int64), 1, width) - 1
    else:
        answer = target
    return n, size, target, answer


def _lists(group: np.ndarray, n: int, *cols: np.ndarray) -> pa.ListArray:
    """Buckets as a list for each of the groups 0 .. n - 1."""
    offsets = np.searchsorted(group, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["low", "high", "count"]))


def _flat(lists) -> tuple:
    """group, low, high, count of a column of lists of buckets."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    size = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(size)), size), *(flat.field(k).to_numpy() for k in range(3))


def _shape(df: DataFrame, cols: list) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def dealt(rows: DataFrame, by: list, batch: str, value: str, weight: str | None = None) -> DataFrame:
    """by, batch, x, c (how often), piece: distinct values in order of by and x, dealt in ranges; written."""
    c = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, batch, F.col(value).cast("long").alias("x")).agg(c.cast("long").alias("c"))
    counts = written(counts, "values")  # or sampling for the ranges would count twice
    ranges = counts.repartitionByRange(*by, "x").sortWithinPartitions(*by, "x").withColumn("piece", F.spark_partition_id())
    return written(ranges, "dealt")


def summarise(values: DataFrame, by: list, batch: str) -> DataFrame:
    """by, batch, buckets: a summary of each batch of each group of ``dealt`` values."""
    cols = [*by, batch]

    def work(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BUFFER:
                yield from some(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from some(pa.Table.from_batches(held))

    def some(t):
        code = lambda c: t.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        piece = t.column("piece").to_numpy()
        turn = np.zeros(len(piece), bool)
        turn[1:] = piece[1:] != piece[:-1]
        new = turn.copy()
        for c in by:
            k = code(c)
            new[1:] |= k[1:] != k[:-1]
        run = np.cumsum(new)
        # a group at either end of a piece, or of what is held, may go on elsewhere
        edge = np.zeros(run[-1] + 1, bool)
        at = np.flatnonzero(turn)
        edge[[0, -1]] = True
        edge[run[at]] = edge[run[at - 1]] = True
        order = np.lexsort((code(batch), run))  # stable: values stay in order
        key = run[order] * np.int64(len(run)) + code(batch)[order]
        first, size = _sizes(key)
        group = np.repeat(np.arange(len(first)), size)
        x, c = t.column("x").to_numpy()[order], t.column("c").to_numpy()[order]
        lists = _lists(*(lambda g, *b: (g, len(first), *b))(*pack(group, x, x, c)))
        keys = t.select([*cols, "piece"]).take(pa.array(order[first]))
        out = pa.table([*keys.columns, pa.array(edge[run[order[first]]]), lists], [*cols, "piece", "edge", "buckets"])
        yield from out.combine_chunks().to_batches()

    found = written(values.mapInArrow(work, f"{_shape(values, [*cols, 'piece'])}, edge boolean, buckets {BUCKETS}"), "summaries")
    pieces = found.where("edge")
    ranges = collected(pieces.agg(F.max("piece").alias("last")))[0]["last"]
    step = 1
    while True:  # adjacent ranges, FAN at a time
        pieces = merged(pieces.withColumn("piece", F.expr(f"piece div {FAN if step > 1 else 1}")), [*cols, "piece"])
        if step > (ranges or 0):
            break
        pieces = written(pieces, "pieces")
        step *= FAN
    return found.where("NOT edge").select(*cols, "buckets").unionByName(pieces.select(*cols, "buckets"))


def merged(summaries: DataFrame, by: list) -> DataFrame:
    """by, buckets: summaries of each group merged into one. The number of summaries in a group should be bounded."""

    def work(batches):
        for b in batches:
            lists = b.column(b.num_columns - 1)
            packed = pack(*merge(*_flat(lists)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(packed[0], len(lists), *packed[1:])], b.schema.names)

    met = summaries.groupBy(*by).agg(F.flatten(F.collect_list("buckets")).alias("buckets"))
    return met.mapInArrow(work, f"{_shape(summaries, by)}, buckets {BUCKETS}")


def quantiles(summaries: DataFrame, by: list, parts: int, least: int = 1) -> DataFrame:
    """by, n, points, targets and answers (arrays by i from 1 to parts - 1) of summaries of at least ``least`` rows."""

    def work(batches):
        for b in batches:
            n, points, target, answer = answers(*_flat(b.column(b.num_columns - 1)), parts)
            wide = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (parts - 1)), pa.array(a.ravel()))
            out = pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n), pa.array(points.astype(np.int64)), wide(target), wide(answer)], [*by, "n", "points", "targets", "answers"])
            yield out.filter(pa.array(n >= least))

    return summaries.select(*by, "buckets").mapInArrow(work, f"{_shape(summaries, by)}, n bigint, points bigint, targets array<bigint>, answers array<bigint>")


def exact_ranks(values: DataFrame, asked: DataFrame, by: list, batch: str, whole: int, parts: int) -> DataFrame:
    """by, batch, exact (array<struct<x,below,upto>> by i): the value of each target's rank among ``dealt`` values, and how many lie below and up to each answer.

    ``asked`` has by, batch, targets and answers; batch ``whole`` is all batches together.
    """
    keys = [*by, batch]
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    rows = values.select(*by, "piece", "x", "c", F.explode(F.array(F.col(batch), F.lit(whole))).alias(batch))
    sums = rows.groupBy(*keys, "piece").agg(F.sum("c").alias("c"))
    before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).alias("s")
    a = asked.select(*keys, "targets", "answers").alias("a")
    wanted = sums.join(a, [F.col(f"s.{c}").eqNullSafe(F.col(f"a.{c}")) for c in keys]).select(*[f"s.{c}" for c in keys], "piece", "before", "targets", "answers")
    upto = Window.partitionBy(*keys, "piece").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cum", F.sum("c").over(upto)).alias("r")
    met = rows.join(written(wanted, "wanted").alias("w"), [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*keys, "piece"]])
    met = met.select(*[F.col(f"r.{c}").alias(c) for c in keys], "x", "c", (F.col("cum") + F.col("before")).alias("cum"), "targets", "answers")
    at = lambda col, i: F.get(F.col(col), F.lit(i))
    zero = F.lit(0).cast("long")
    aggs = []
    for i in range(parts - 1):
        aggs += [
            F.min(F.when(F.col("cum") >= at("targets", i), F.col("x"))).alias(f"x{i}"),
            F.sum(F.when(F.col("x") < at("answers", i), F.col("c")).otherwise(zero)).alias(f"below{i}"),
            F.sum(F.when(F.col("x") <= at("answers", i), F.col("c")).otherwise(zero)).alias(f"upto{i}"),
        ]
    exact = F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"below{i}").alias("below"), F.col(f"upto{i}").alias("upto")) for i in range(parts - 1)])
    return met.groupBy(*keys).agg(*aggs).select(*keys, exact.alias("exact"))


def quantile_report(rows: DataFrame, by: list, batch: str, value: str, weight: str | None = None, parts: int = 10, least: int = 20, whole: int = -1) -> DataFrame:
    """by, batch, i, n, target, exact_x, points, answer, n_below, n_upto: every batch of every group, and batch ``whole``, merged from the summaries of the others."""
    values = dealt(rows, by, batch, value, weight)
    parts_of = written(summarise(values, by, batch), "batches")
    total = merged(parts_of, by).withColumn(batch, F.lit(whole).cast(parts_of.schema[batch].dataType))
    keys = [*by, batch]
    asked = written(quantiles(parts_of, keys, parts, least).unionByName(quantiles(total, keys, parts, least)), "asked")
    exact = exact_ranks(values, asked, by, batch, whole, parts)
    out = asked.alias("a").join(exact.alias("e"), [F.col(f"a.{c}").eqNullSafe(F.col(f"e.{c}")) for c in keys])
    out = out.select(*[f"a.{c}" for c in keys], "n", "points", F.posexplode(F.arrays_zip("targets", "answers", "exact")).alias("k", "z"))
    return out.select(
        *keys, (F.col("k") + 1).alias("i"), "n", F.col("z.targets").alias("target"), F.col("z.exact.x").alias("exact_x"), "points",
        F.col("z.answers").alias("answer"), F.col("z.exact.below").alias("n_below"), F.col("z.exact.upto").alias("n_upto"),
    )


def _batch(c: Column) -> Column:
    """CRC-32 of the number in decimal, mod 8; null is the empty text."""
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 8).cast("int")


def money_streams(spark, sf_dir: str) -> DataFrame:
    """stream, grp, batch, x and weight of the shop's two streams of money. Money that is no finite number is lacking."""
    # of repeated clicks one row: the greatest, so one with a client before one without
    clicks = table(spark, sf_dir, "clicks").groupBy("click_id").agg(F.max(F.struct("client_id", "value")).alias("v"))
    value = clicks.select(F.lit("value").alias("stream"), F.col("v.client_id").cast("string").alias("grp"), _batch(F.col("click_id")).alias("batch"), F.col("v.value").alias("money"), F.lit(1).cast("long").alias("weight"))
    # lines of an item are counted by batch before they meet it: no item is hot then
    lines = table(spark, sf_dir, "sale_lines").where("item_id IS NOT NULL").groupBy("item_id", _batch(F.col("vendor_id")).alias("batch")).agg(F.count(F.lit(1)).alias("weight"))
    price = lines.join(table(spark, sf_dir, "items"), "item_id").select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), "batch", F.col("price").alias("money"), "weight")
    both = value.unionByName(price).where(F.col("grp").isNotNull() & (F.abs("money") < 1e13))
    return both.select("stream", "grp", "batch", (F.floor(100 * F.col("money") + 0.5).cast("long") + 1000 * F.col("batch")).alias("x"), "weight")


def op12_quantile_histogram(spark, sf_dir: str) -> DataFrame:
    out = quantile_report(money_streams(spark, sf_dir), ["stream", "grp"], "batch", "x", "weight")
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return out.withColumn("rank_error", error).withColumn("within", 1000 * F.col("rank_error") <= 50 * F.col("n"))
