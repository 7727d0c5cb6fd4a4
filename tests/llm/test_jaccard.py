import random
import re

import pytest

from marlstone.llm import jaccard


def brute(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and den * both >= num * len(sets[x] | sets[y]):
                up[max(top(x), top(y))] = min(top(x), top(y))
    ids = [jaccard.NO_ID if i is None else i for i, _ in rows]
    least = {}
    for x, i in enumerate(ids):
        least[top(x)] = min(least.get(top(x), i), i)
    return sorted((i, len(s), least[top(x)]) for x, (i, s) in enumerate(zip(ids, sets)))


def near(rng, words, k):
    w = list(words)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("size,num,den,hot", [(3, 90, 100, 4096), (5, 80, 100, 4096), (3, 90, 100, 1), (5, 80, 100, 1)])
def test_components_match_brute_force(spark, monkeypatch, size, num, den, hot):
    monkeypatch.setattr(jaccard, "HOT_LEAST", hot)
    if hot == 1:  # nearly all shared tokens are salted
        monkeypatch.setattr(jaccard, "HOT_TIMES", 0)
    monkeypatch.setattr(jaccard, "FEW", 4)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 12)
    rng = random.Random(3)
    voc = [f"w{k}" for k in range(400)]
    texts = [None, "", " \n", "One", "one", "ONE two", "one two", "É é", "é é"]
    base = [rng.choice(voc) for _ in range(200)]
    texts += [near(rng, base, rng.randrange(0, 9)) for _ in range(60)]  # a group of several blocks
    for _ in range(12):
        own = [rng.choice(voc) for _ in range(rng.randrange(3, 150))]
        texts += [near(rng, own, rng.randrange(0, 4)) for _ in range(rng.randrange(1, 5))]
    texts += [texts[20]] * 6
    rows = [(None if k == 7 else k, t) for k, t in enumerate(texts)] + [(30, texts[30])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in jaccard.similar(docs, size, num, den).drop("hash").collect())
    assert got == brute(rows, size, num, den)


def test_empty_table(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id long, text string, key string"), 3, 90, 100).collect() == []


def test_candidates_do_not_depend_on_batches():
    """Postings in order, cut into batches at any place, give the same pairs and the same groups of stars."""
    import pyarrow as pa

    rng = random.Random(9)
    rows = sorted({(t, s, rng.randrange(20, 60), c, rng.randrange(5)) for t in range(6) for s in ([0] if t < 4 else [1, 2]) for c in rng.sample(range(300), (3, 9, 17, 90, 40, 70)[t])})
    rows += rows[-1:]

    def run(cuts):
        cols = list(zip(*rows))
        table = pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))], ["token", "salt", "n", "number", "pos"]).select(["token", "salt", "number", "n", "pos"])
        batches = [b for i, j in zip([0, *cuts], [*cuts, len(rows)]) for b in table.slice(i, j - i).combine_chunks().to_batches()]
        out = [r for b in jaccard._candidates(80, 100)(iter(batches)) for r in b.to_pylist()]
        return [{(r["kind"], r["token"], r["a"], r["b"]) for r in out if r["kind"] == k} for k in (0, 1, 2)]

    whole = run([])
    assert all(whole)
    for _ in range(20):
        pairs, stars, again = run(sorted(rng.sample(range(1, len(rows)), rng.randrange(1, 60))))
        assert pairs == whole[0] and again == whole[2]
        join = lambda edges: {(t, frozenset(x for _, u, a, b in edges if u == t and c == b for x in (a, b))) for _, t, _, c in edges}
        assert {x for x in join(stars)} == {x for x in join(whole[1])}
    assert run(range(1, len(rows)))[0] == whole[0]
