import math
import random
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import histogram as hg

rng = random.Random(9)


def summary(xs, group=0):
    v, c = np.unique(np.array(xs, np.int64), return_counts=True)
    return hg.pack(np.full(len(v), group), v, v, c)


def columns(n):
    """Lists of integers of many shapes."""
    yield [int(rng.lognormvariate(5, 2)) for _ in range(n)]
    yield [rng.choice([3, 3, 3, 8]) for _ in range(n)]
    yield list(range(n))
    yield [7] * n + [1, 2, 9, 12]
    yield [rng.randrange(10**12) for _ in range(n)]
    yield [5] * (n // 2) + [rng.randrange(1000) - 500 for _ in range(n // 2)]
    yield [rng.choice([0, 10**15 * 4]) for _ in range(n)] + [int(rng.gauss(0, 10**9)) for _ in range(n)]
    yield [1] * (100 * n) + list(range(2, n))


def held_to(xs, group, share):
    _, low, high, count = group
    xs = sorted(xs)
    n, distinct = len(xs), len(set(xs))
    assert count.sum() == n and (count > 0).all() and (low <= high).all() and (low[1:] > high[:-1]).all()
    assert low[0] == xs[0] and high[-1] == xs[-1]
    assert min(4, distinct) <= len(low) <= min(n, 2 * hg.WINDOWS + 5)
    _, _, target, answer = hg.answers(*group, 10)
    assert list(target[0]) == [math.ceil(i * n / 10) for i in range(1, 10)]
    assert (np.diff(answer[0]) >= 0).all() and xs[0] <= answer[0][0] and answer[0][-1] <= xs[-1]
    for t, a in zip(target[0], answer[0]):
        assert max(0, bisect_left(xs, a) + 1 - t, t - bisect_right(xs, a)) <= share * n


@pytest.mark.parametrize("n", [20, 150, 3000, 40000])
def test_a_summary_and_merged_ones_stay_below_their_share_of_error(n):
    for xs in columns(n):
        held_to(xs, summary(xs), 2 / hg.WINDOWS)
        rng.shuffle(xs)
        some = [summary([x + 1000 * k for x in xs[k::8]]) for k in range(8) if xs[k::8]]
        flat = [np.concatenate(c) for c in zip(*some)]
        all_xs = [x + 1000 * k for k in range(8) for x in xs[k::8]]
        held_to(all_xs, hg.pack(*hg.merge(*flat)), 4 / hg.WINDOWS)


def test_merging_summaries_of_disjoint_ranges_loses_nothing():
    xs = sorted(int(rng.lognormvariate(9, 2)) for _ in range(30000))
    parts = [xs[k : k + 5000] for k in range(0, 30000, 5000)]
    parts = [[x for x in p if k == 0 or x > parts[k - 1][-1]] for k, p in enumerate(parts)]
    flat = [np.concatenate(c) for c in zip(*map(summary, parts))]
    merged = hg.pack(*hg.merge(*flat))
    held_to([x for p in parts for x in p], merged, 2 / hg.WINDOWS)
    ends = np.searchsorted(sorted(x for p in parts for x in p), merged[2], "right")
    assert list(np.cumsum(merged[3])) == list(ends)


def test_groups_do_not_meet():
    lists = [list(c) for c in columns(500)]
    flat = [np.concatenate(c) for c in zip(*(summary(xs, g) for g, xs in enumerate(lists)))]
    g, low, high, count = hg.pack(*hg.merge(*flat))
    for k, xs in enumerate(lists):
        held_to(xs, tuple(c[g == k] for c in (np.zeros_like(g), low, high, count)), 4 / hg.WINDOWS)
    n, points, target, answer = hg.answers(g, low, high, count, 10)
    assert list(n) == [len(xs) for xs in lists] and list(points) == [int((g == k).sum()) for k in range(len(lists))]


def brute(rows):
    groups = {}
    for stream, grp, batch, x in rows:
        for b in (batch, -1):
            groups.setdefault((stream, grp, b), []).append(x)
    return {k: sorted(v) for k, v in groups.items() if len(v) >= 20}


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hg, "BUFFER", 2000)
    batch = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 8
    clicks = [(k, rng.choice([None, 1, 7, 7, 7, 7, 7, rng.randrange(60)]), rng.choice([None, round(rng.lognormvariate(3, 2), 2), float(rng.randrange(9)), float("nan"), -round(rng.random() * 50, 2)] + [round(rng.random() * 900, 2)] * 5)) for k in range(9000)]
    items = [(k, rng.choice([None, "B1", "B1", "B2", "é"]), rng.choice([None] + [round(rng.random() * 300, 2)] * 9)) for k in range(400)] + [(None, "B1", 3.0)]
    lines = [(s, rng.choice([None, 5, 5, 5, rng.randrange(450)]), rng.choice([None, 3, rng.randrange(70)])) for s in range(6000)]
    for name, rows, shape in (("clicks", clicks + clicks[::9], "click_id long, client_id long, value double"), ("items", items, "item_id long, brand string, price double"), ("sale_lines", lines, "sale_id long, item_id long, vendor_id long")):
        spark.createDataFrame(rows, shape).repartition(4).write.parquet(str(tmp_path / f"{name}.parquet"))
    cents = lambda m, b: math.floor(100 * m + 0.5) + 1000 * b
    rows = [("value", str(c), batch(k), cents(v, batch(k))) for k, c, v in clicks if c is not None and v is not None and v == v]
    of = {k: (b, p) for k, b, p in items if k is not None}
    rows += [("price", of[i][0], batch(v), cents(of[i][1], batch(v))) for _, i, v in lines if i in of and None not in of[i]]
    want = brute(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    got = hg.op12_quantile_histogram(spark, str(tmp_path)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["stream"], r["grp"], r["batch"]) for r in got} == set(want) and len(got) == 9 * len(want)
    for r in got:
        xs = want[r["stream"], r["grp"], r["batch"]]
        n, t, a = len(xs), math.ceil(r["i"] * len(xs) / 10), r["answer"]
        below, upto = bisect_left(xs, a), bisect_right(xs, a)
        error = max(0, below + 1 - t, t - upto)
        assert (r["n"], r["target"], r["exact_x"], r["n_below"], r["n_upto"], r["rank_error"], r["within"]) == (n, t, xs[t - 1], below, upto, error, True)
        assert min(4, len(set(xs))) <= r["points"] <= min(n, 400) and xs[0] <= a <= xs[-1] and r["rank_error"] <= max(1, 0.023 * n)
    assert max(r["n"] for r in got) > 3000


def test_nulls_are_groups_and_empty_tables_are_empty(spark):
    rows = [(None, None, k % 30) for k in range(90)] + [("a", 1, None)] * 30 + [("a", 1, 4)] * 25
    df = spark.createDataFrame(rows, "g string, b int, v long").withColumns({"x": F.lit(1), "c": F.lit(2), "piece": F.lit(3), "n": F.lit(4)})
    got = hg.quantile_report(df.select("g", "b", "v", *[c for c in df.columns if c not in "gbv"]), ["g"], "b", "v").collect()
    assert {(r["g"], r["b"], r["n"]) for r in got} == {(None, None, 90), (None, -1, 90), ("a", 1, 25), ("a", -1, 25)}
    assert all(r["n_below"] < r["target"] <= r["n_upto"] and r["exact_x"] == r["answer"] for r in got)
    assert hg.quantile_report(df.where("false"), ["g"], "b", "v").collect() == []
