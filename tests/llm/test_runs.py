import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from marlstone.llm import runs

rng = random.Random(3)


def plain(words, min_length, min_exponent):
    """All runs, by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, min_exponent * q):
                w = words[i : i + length]
                if not any(all(w[x] == w[x + d] for x in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize(("min_length", "min_exponent"), [(2, 2), (6, 2), (9, 3), (24, 3)])
def test_runs_of_a_sequence_are_those_of_brute_force(min_length, min_exponent):
    texts = ["a" * 60, fibonacci(200), "ab" * 40 + "c" + "ab" * 40, "abcabcabcab", "x", "xy", "aab" * 20 + "aab"[:2], "abcd" * 8 + "bcda" * 8]
    for _ in range(150):
        kinds, n = rng.choice([2, 2, 3, 5]), rng.randrange(1, 120)
        t = "".join(rng.choice("abcde"[:kinds]) for _ in range(n))
        k = rng.randrange(len(t))
        texts += [t, t[:k] + t[k : k + 7] * rng.randrange(1, 9) + t[k:]]
    for t in texts:
        got = runs.repetitions(np.unique(list(t), return_inverse=True)[1], min_length, min_exponent)
        assert list(zip(*(x.tolist() for x in got))) == plain(t, min_length, min_exponent), t


def test_texts_of_a_batch_do_not_meet():
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(90))) for _ in range(60)] + ["a " * 50, "a " * 50, None, "", " \n"]
    counts, found = runs._batch(runs.pa.array(texts), 9, 3)
    assert counts == [len((t or "").split()) for t in texts]
    for r, t in enumerate(texts):
        assert found.get(r, []) == plain((t or "").split(), 9, 3)


def test_long_texts_in_bounded_time():
    period = [f"w{rng.randrange(9000)}" for _ in range(20_000)]
    text = " ".join(period * 10 + ["a"] * 50_000)
    began = time.time()
    _, found = runs._batch(runs.pa.array([text]), 24, 3)
    assert found == {0: [(0, 200_000, 20_000), (200_000, 50_000, 1)]} and time.time() - began < 30


def test_query_against_brute_force(spark, tmp_path):
    rows = [(k, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(160)))) for k in range(240)] + [(7, "A a " * 20), (7, "A a " * 20), (900, None), (901, ""), (None, "b\t\x0bc\n" * 30), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in runs.op13_word_runs(spark, str(tmp_path)).collect() if r["doc_id"] is not None)
    want = []
    for i, t in rows:
        words = (t or "").split()
        n, h = len(words), zlib.crc32(("" if i is None else str(i)).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[x] if x < a else words[a + (x - a) % p] for x in range(n)]
        found = plain(words, 24, 3)
        best = next((r for r in found if all(r[1] * o[2] >= o[1] * r[2] for o in found)), None)
        gone = {x for s, length, q in found for x in range(s + q, s + length)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for x, w in enumerate(words) if x not in gone))))
    assert got == sorted(w for w in want if w[0] is not None) and sum(w[1] for w in want) > 15


def test_columns_and_empty_tables(spark):
    clash = ["words", "runs", "collapsed", "n", "__n", "__runs", "row"]
    text = "one  two " * 20
    docs = spark.createDataFrame([(1, text), (2, "a  b"), (3, None)], "doc_id long, text string").selectExpr("*", *[f"{k} AS `{c}`" for k, c in enumerate(clash)])
    out = runs.collapse_runs(docs)
    assert out.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, "one two"), (2, "a  b"), (3, None)]
    assert all([r[c] for c in clash] == list(range(len(clash))) for r in out.collect())
    assert runs.collapse_runs(docs.where("false")).collect() == []
