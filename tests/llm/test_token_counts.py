import random
import re

import pytest

from marlstone.llm import token_counts as T


def greedy(word: bytes, pieces: set) -> int:
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), at + 1)
        at, n = end, n + 1
    return n


def brute(rows, pieces):
    out = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out.append((i, len(words), sum(greedy(b" " + w.encode(), pieces) for w in words), len(t or "")))
    return out


def test_public_vocabulary(spark):
    pieces = T.read_pieces(T.VOCABULARY)
    rows = [(1, "The quick brown fox don't jumps, über éléphants 漢字 antidisestablishmentarianism"), (2, None), (3, ""), (4, " \t\n"), (5, "x" * 5000), (None, "a b A a"), (1, "dup dup")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words")
    got = [tuple(r) for r in T.count_tokens(docs, pieces).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, set(pieces)), key=str)
    assert T.count_tokens(docs.limit(0), pieces).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_random_vocabularies(spark, seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abc") for _ in range(k))
    pieces = [(" " * rng.randrange(2) + word(rng.randrange(1, 7))).encode() for _ in range(40)]
    rows = [(k, " ".join(word(rng.randrange(1, 25)) for _ in range(20))) for k in range(60)]
    got = T.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), pieces).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, {*pieces, *(bytes([c]) for c in range(256))})
