"""What the review of round 3 found."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import lexical
from marlstone.sources import fielded, postings, scan
from marlstone.streaming import events


def test_a_table_in_a_folder_is_streamed_whole(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = events.upsert(spark, str(tmp_path)).collect()
    assert {r["id"]: r["revision"] for r in got} == {f"doc:{k}": 1 for k in range(50)} and len(got) == 50


def _bodies(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "retry", "Queue", "ha", "b2", "policy", "rare" + str(rng.randrange(30))])
    rows = [("t", f"d{k:03}", " ".join(word() for _ in range(rng.randrange(4))) or None, "\n".join(" ".join(word() for _ in range(rng.randrange(9))) for _ in range(rng.randrange(5)))) for k in range(150)]
    return spark.createDataFrame([*rows, ("t", "none", None, None)], "tenant string, id string, title string, body string").repartition(3)


def _both(spark):
    docs = _bodies(spark)
    lines = docs.select("tenant", "id", F.col("title").alias("heading"), F.posexplode(F.filter(F.split("body", "\n", -1), lambda x: x.rlike("[a-z0-9]"))).alias("seq", "text"))
    return docs, scan.Texts.read(docs), fielded.build(lines, False)


def _rows(df, *columns):
    return sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("block", [2, 4096])
def test_texts_give_what_the_index_gives(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    monkeypatch.setattr(scan, "PAIRS", 50)
    docs, texts, ix = _both(spark)
    seen = docs.where("id LIKE '%1%'")
    asked = ['retry "the queue"', "ha -retry of", "ha", '-the policy "of the"', "", "-ha", "nowhere b2", '"ha ha" "ha ha" -rare1', 'the the "the of retry"']
    q = spark.createDataFrame([(f"q{n}", x) for n, x in enumerate(asked)], "query_id string, query string")
    columns = ["query_id", "id", "seq", "rank", "strict"]
    for some in (None, seen):
        want = _rows(lexical.web_matches(ix, q, some), *columns)
        assert _rows(lexical.web_matches(texts, q, some), *columns) == want and want
    best: dict = {}
    for r in _rows(lexical.web_matches(ix, q), *columns):
        best[r[:2]] = min(best.get(r[:2], r), r, key=lambda x: (not x[4], -x[3], x[2]))
    assert _rows(lexical.web_matches(texts, q, best=True), *columns) == sorted(best.values())
    parts = [["the"], ["ha", "ha"], ["of", "the"], ["retry", "the", "of"], ["nowhere", "the"], ["rare2"]]
    w = spark.createDataFrame([(f"q{n % 3}", n, k, x) for n, p in enumerate(parts) for k, x in enumerate(p)], "query_id string, part int, slot int, stem string")
    columns = ["query_id", "part", "id", "seq", "len", "in_heading", "in_text"]
    assert _rows(lexical.phrases(texts, w), *columns) == _rows(lexical.phrases(ix, w), *columns)
    w = w.select("query_id", "stem").distinct()
    assert _rows(lexical.field_rank(texts, w), "query_id", "id", "seq", "rank") == _rows(lexical.field_rank(ix, w), "query_id", "id", "seq", "rank")
    for some in (None, seen):
        want = _rows(lexical.top_documents(ix, w, 7, some), "query_id", "id", "score", "rank")
        assert _rows(lexical.top_documents(texts, w, 7, some), "query_id", "id", "score", "rank") == want and want


def test_a_few_words_need_no_index(spark, tmp_path):
    spark.createDataFrame([(1, "The cat and the dog"), (2, "a dog\n\nthe end"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    few = postings.asked(spark, str(tmp_path), ["the", "dog", "nowhere"], counted=True)
    assert (spark.sparkContext.applicationId, str(tmp_path)) not in postings._built
    whole = postings.build(spark, str(tmp_path))
    want = _rows(whole.postings.where("term IN ('the', 'dog')"), "id", "seq", "term", "tf", "len")
    assert _rows(few.postings, "id", "seq", "term", "tf", "len") == want == [("doc:1", 0, "dog", 1, 5), ("doc:1", 0, "the", 2, 5), ("doc:2", 0, "dog", 1, 2), ("doc:2", 1, "the", 1, 2)]
    asked = spark.createDataFrame([("dog",), ("nowhere",)], "term string")
    assert (few.chunks, few.avgdl, _rows(few.df(asked), "term", "df")) == (whole.chunks, whole.avgdl, _rows(whole.df(asked), "term", "df"))
