import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from marlstone.llm import class_lm as C


def rows():
    rng = random.Random(5)
    a, b = [f"ka{k}" for k in range(60)], [f"zo{k}" for k in range(60)]
    out = [(k, " ".join(x for _ in range(rng.randrange(5, 40)) for x in (rng.choice(a), rng.choice(b)))) for k in range(300)]
    return out + [(1000, None), (1001, ""), (None, "Ka1 KA1 unseen\twords"), (3, out[3][1]), (1002, "neverseen ever")]


def test_base_and_counts_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "SCORED", 50)  # most words go the way of the rare ones
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' AS score").repartition(3)
    got = sorted(C.score(docs).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for _, t in data]
    c = Counter(w for (i, _), ws in zip(data, tokens) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for (i, _), ws in zip(data, tokens)), key=lambda r: (str(r[0]), r[2]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert math.isclose(g["base_score"], w[5], rel_tol=1e-9)
    test = [g for g in got if g["held_out"]]
    assert sum(g["score"] for g in test) > sum(g["base_score"] for g in test)  # the classes say which words come next


def likelihood(m, cls, k):
    n = np.eye(k)[cls].T @ m @ np.eye(k)[cls]
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(n) - f(n.sum(0)) - f(n.sum(1))


def test_exchange_finds_two_classes():
    m = np.random.default_rng(1).integers(0, 2, (8, 8)).astype(float)
    m[:4, 4:] += 5
    m[4:, :4] += 3
    cls = C.exchange(m, 2)
    assert len(set(cls[:4])) == 1 and len(set(cls[4:])) == 1 and cls[0] != cls[4]


def test_exchange_ends_where_no_move_helps():
    m = np.random.default_rng(2).integers(0, 9, (12, 12)).astype(float)
    cls = C.exchange(m, 3, 0.0)
    best = likelihood(m, cls, 3)
    for u in range(12):
        for b in range(3):
            other = cls.copy()
            other[u] = b
            assert likelihood(m, other, 3) <= best + 1e-6


def test_no_training_text(spark):
    assert C.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    i = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    (r,) = C.score(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_middle_words_join_the_words_they_act_like(spark, monkeypatch):
    """Middle words with one ending in common, that act like one of two kinds of frequent words: their ending's one class cannot tell them apart."""
    monkeypatch.setattr(C, "SCORED", 21)  # the frequent words and the end
    monkeypatch.setattr(C, "CLASSES", 4)
    rng = random.Random(8)
    kinds = [[f"ka{k}" for k in range(10)], [f"zo{k}" for k in range(10)]]
    rare = [[f"{k}axyz" for k in range(20)], [f"{k}bxyz" for k in range(20)]]
    pick = lambda k: rng.choice(rare[k] if rng.random() < 0.15 else kinds[k])
    rows = [" ".join(pick(k) for _ in range(20) for k in (0, 1)) for _ in range(200)] + ["once twice"]
    model, _ = C.train(spark.createDataFrame([(t,) for t in rows], "text string").repartition(3))
    assert len(model.units.middle) == 40  # every word of five occurrences or more that is not a frequent one
    w = C.W.Words(*C.W.utf8(C.pa.array(rare[0] + rare[1])), 0, 40, C.W.SPACED)
    cls = model.cls[model.units.of(w.hash, C._endings(w))].tolist()
    assert not set(cls[:20]) & set(cls[20:])


def test_sweeps_count_all_bigrams_and_raise_the_likelihood(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(60)) for _ in range(80)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    monkeypatch.setattr(C, "SCORED", 40)
    kept, run = [], C.sweep
    monkeypatch.setattr(C, "sweep", lambda bigrams, cls, n: kept.append((cls, n, run(bigrams, cls, n))) or kept[0][2])
    model, _ = C.train(docs)
    (_, before, (cls, after)) = kept[0]
    assert C.likelihood(after) > C.likelihood(before)
    want = np.zeros_like(after)
    w = C.W.Words(*C.W.utf8(C.pa.array(texts)), 0, len(texts), C.W.SPACED)
    h, e, _ = C._tokens(w)
    c = cls[model.units.of(h, e)]
    np.add.at(want, (np.append(cls[model.end], c[:-1]), c), 1)
    assert (want == after).all()


def test_scores_match_a_class_model_by_hand(spark, monkeypatch):
    """Transitions and emissions, counted again in plain Python from the classes that training gave."""
    monkeypatch.setattr(C, "SCORED", 30)
    monkeypatch.setattr(C, "CLASSES", 5)
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), ""] for _, t in data]
    model, _ = C.train(spark.createDataFrame([(t,) for i, t in data if not held(i)], "text string"))
    words = sorted({w for ws in tokens for w in ws if w})
    w = C.W.Words(*C.W.utf8(C.pa.array(words)), 0, len(words), C.W.SPACED)
    cls = dict(zip(words, model.cls[model.units.of(w.hash, C._endings(w))].tolist())) | {"": int(model.cls[model.end])}
    size = len(model.out)
    train = [ws for (i, _), ws in zip(data, tokens) if not held(i)]
    count = Counter(x for ws in train for x in ws)
    step = Counter((cls[a], cls[b]) for ws in train for a, b in zip(["", *ws], ws))
    out = [0.5 * (sum(cls[x] == c for x in count) + 1) + sum(n for x, n in count.items() if cls[x] == c) for c in range(size)]
    before = [sum(step[c, d] for d in range(size)) for c in range(size)]
    assert math.isclose(sum(out[c] for c in range(size)), sum(count.values()) + 0.5 * (len(count) + size))
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in C.score(docs).collect()}
    for (i, _), ws in zip(data, tokens):
        p = 0.0
        for a, b in zip(["", *ws], ws):
            p += math.log10((step[cls[a], cls[b]] + C.BACK * out[cls[b]] / sum(out)) / (before[cls[a]] + C.BACK)) + math.log10((count[b] + 0.5) / out[cls[b]])
        assert math.isclose(got[i, len(ws)], p, rel_tol=1e-9)
