import math
import random

import pytest
from pyspark.sql import functions as F

from marlstone.llm import mixing


def fill(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    """Targets by hand: share out what is left by weight, fill who would get too much, and go on with the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            open_.remove(s)
        left -= sum(out[s] for s in over)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets_match_water_filling_by_hand(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.randrange(1, 10 ** rng.randrange(1, 5)) for s in [None, *"abcdefg"][: rng.randrange(1, 9)]}
    share, most = rng.choice([(1.5, 2), (0.3, 1), (1.9, 2)])
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), share=share, max_repeat=most).collect()
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == fill(sizes, share=share, most=most)


def test_taken_and_shards_come_from_the_tree(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", "c", None]), rng.randrange(0, 9)) for k in range(400)] + [(99, None, 5), (99, None, 5), (None, "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    for share, most, blocks in ((1.5, 2, 16), (3.0, 4, 1024), (0.4, 1, 7)):
        how = {"share": share, "max_repeat": most, "block_docs": blocks}
        d = mixing.drawn_copies(docs, **how).collect()
        assert sorted(((r["doc_id"], r["source"], r["size"]) for r in d), key=str) == sorted(rows, key=str)
        size = {s: sum(n for _, x, n in rows if x == s) for s in {x for _, x, _ in rows}}
        want = fill(size, share=share, most=most)
        for s in size:
            assert abs(sum(c["words"] for r in d if r["source"] == s for c in r["copies"]) - want[s]) <= 0.5
        assert all(0 < c["words"] <= r["size"] and 0 <= c["shard"] < 8 for r in d for c in r["copies"])
        assert all(len(r["copies"]) <= most and len({c["pass"] for c in r["copies"]}) == len(r["copies"]) for r in d)
        m = mixing.mix(docs, **how)
        assert m.agg(F.sum("words")).first()[0] == sum(c["words"] for r in d for c in r["copies"])
        spread = {r["shard"]: r["n"] for r in m.groupBy("shard").agg(F.countDistinct("source", "pass", "shard").alias("n")).collect()}
        assert blocks == 1024 or len(spread) == 8


def test_shards_stand_in_their_own_order(spark):
    m = mixing.mix(spark.createDataFrame([(k, "ab"[k % 2], 3) for k in range(300)], "doc_id long, source string, size long"), block_docs=8)
    rows = [(r["shard"], r["place"]) for r in m.collect()]
    assert rows == sorted(rows) and [r for r in rows] != sorted(rows, key=lambda x: x[1])


@pytest.mark.parametrize("n", [0, 1, 7, 300, 5000])
def test_shards_follow_the_number_of_copies(spark, n):
    docs = spark.createDataFrame([(k, "abc"[k % 7 % 3], 3) for k in range(n)], "doc_id long, source string, size long")
    leaves = mixing.tree(*mixing.dealt(docs, 8)).toPandas()
    spread = leaves.groupby("shard").size()
    shards = 2 ** max(0, round(math.log2(max(1, len(leaves)) / 4)))
    assert len(spread) == (shards if n else 0) and (not n or spread.max() - spread.min() <= 1)
    if n == 5000:  # sources stand in a shard as a draw without replacement has it
        for s, g in leaves.groupby("source"):
            share = g.groupby("shard").size().reindex(range(shards), fill_value=0)
            p, m = len(g) / len(leaves), len(leaves) / shards
            assert abs(share.mean() - p * m) < 1e-6 and 0.5 < share.var() / (m * p * (1 - p)) < 1.6
