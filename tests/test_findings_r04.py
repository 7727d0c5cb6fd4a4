"""What FINDINGS_r04 names: disk that grew faster than the input."""

import random

import numpy as np
import pytest

import corpus_pipeline
from marlstone.llm import jaccard

SF = "/root/testdata/sf0.001"


def test_tokens_that_a_sketch_cannot_tell_from_rare_ones_tie_no_sets(spark, monkeypatch):
    """Each of a few cells holds many tokens, as in a large table; only sets that may be similar are sent to be compared."""
    monkeypatch.setattr(jaccard, "FEW", 4)
    monkeypatch.setattr(jaccard, "CELL_BITS", 6)
    monkeypatch.setattr(jaccard, "MOST_BITS", 6, raising=False)
    rng = random.Random(5)
    texts = [" ".join(f"w{x}" for x in rng.sample(range(400), 60)) for _ in range(300)]
    texts += [t.replace(t.split(" ")[0], "other", 1) for t in texts[:20]]
    held, real = {}, jaccard.written

    def kept(df, name):
        out = real(df, name)
        if name == "sets":
            held[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["id"]: r["component"] for r in jaccard.similar(docs, 1, 80, 100).collect()}
    assert got == {k: k - 300 if k >= 300 else k for k in range(320)}
    assert 40 <= held["sets"] < 80


def test_common_phrases_tie_no_documents_of_the_pipeline(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 4)
    monkeypatch.setattr(jaccard, "CELL_BITS", 6)
    monkeypatch.setattr(jaccard, "MOST_BITS", 6, raising=False)
    rng = random.Random(6)
    phrases = [" ".join(f"p{p}w{k}" for k in range(30)) for p in range(40)]
    texts = [" ".join(rng.sample(phrases, 8)) for _ in range(300)]
    texts += [t.replace("w15", "w15x", 1) for t in texts[:20]]
    held, real = {}, jaccard.written

    def kept(df, name):
        out = real(df, name)
        if name == "sets":
            held[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(300))
    assert 40 <= held["sets"] < 80


def test_the_sketch_grows_with_the_table():
    assert [jaccard.cell_bits(n) for n in (0, 10**6, 128 << 20, (128 << 20) + 128, 128 << 23, 10**12)] == [20, 20, 20, 21, 23, 24]
    counts = np.array([0, 1, 90, 100, 10**9])
    assert jaccard.levels_of(counts)[0] == 0 and len(set(jaccard.levels_of(counts))) == 5


@pytest.mark.parametrize("length,rows", [(1 << 20, 3000), (1 << 23, 3000), (5000, 4000)])
def test_counts_leave_the_executors_as_bytes(spark, length, rows):
    from marlstone.llm._tally import tally

    df = spark.range(rows).selectExpr("id * id % 4999 AS code").repartition(5)
    want = 2 * np.bincount(np.arange(rows, dtype=np.int64) ** 2 % 4999, minlength=length)
    got = tally(df, lambda b: [b.column(0).to_numpy()] * 2, length, jaccard.levels_of)
    assert got.dtype == np.uint8 and (got == jaccard.levels_of(want)).all()
    assert (tally(df, lambda b: [b.column(0).to_numpy()] * 2, length) == want).all()
