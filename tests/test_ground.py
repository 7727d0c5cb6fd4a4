import random

import pytest

from marlstone.operators import ground
from marlstone.operators.answers import Answers

rng = random.Random(1)
TOPICS = ["retry", "backoff", "payment", "ledger", "queue", "in-flight", "window", "kafka"]


def plain(question, text):
    """The best paragraph, by the rule."""
    words, best = ground.content_words(question), None
    for p in (text or "").split("\n\n"):
        hits = sum(w in ground.flat(p).lower() for w in words)
        if words and hits >= 2 and hits / len(words) >= 0.6 and (best is None or hits > best[0]):
            best = (hits, ground.flat(p))
    return best and best[1]


@pytest.fixture
def questions(spark):
    rows = [(f"q{k}", f"What is the {' '.join(rng.sample(TOPICS, rng.choice([2, 3, 4])))}?") for k in range(30)] + [("none", "what is the"), ("null", None), ("far", "zebra unicorn basilisk")]
    return rows, spark.createDataFrame(rows, "query_id string, question string")


def test_words_of_a_topic():
    assert ground.content_words("What does the In-Flight retry-policy do, in v2 of it?") == ["in-flight", "retry-policy"] and ground.content_words(None) == []


@pytest.mark.parametrize("block", [20_000, 7])
def test_a_rung_answers_by_its_first_document(spark, questions, monkeypatch, block):
    monkeypatch.setattr(ground, "BLOCK", block)
    rows, q = questions
    docs = [(f"d{k:02}", k // 2, "\n\n".join(" ".join(rng.sample(TOPICS, 3)) + f" p{k}{p}" for p in range(3)).upper() if k % 5 else None) for k in range(12)]
    got = {r["query_id"]: (r["id"], r["answer"]) for r in ground.first_document(ground.fitting(q, spark.createDataFrame(docs, "id string, rank long, body string"))).collect()}
    want = {}
    for i, question in rows:
        hits = [(rank, d, plain(question, body)) for d, rank, body in docs if plain(question, body)]
        if hits:
            want[i] = min(hits)[1:]
    assert got == want and 5 < len(want) < len(rows)


def answered(spark, results, contract):
    return lambda q: Answers(
        spark.createDataFrame(results, "query_id string, id string, position int").join(q.select("query_id"), "query_id", "left_semi"),
        spark.createDataFrame(contract, "query_id string, top_score double, score_gap double, n_above_threshold long").join(q.select("query_id"), "query_id", "left_semi"))


def test_the_first_source_wins_and_the_rest_goes_on(spark):
    q = spark.createDataFrame([(k, "retry backoff policy") for k in ("high", "flat", "low", "lied", "silent")] + [("local", "ledger window"), ("later", "queue kafka"), ("empty", "")], "query_id string, question string")
    rungs = [("context", spark.createDataFrame([("c", 0, "About the ledger window.")], "id string, rank long, body string")), ("docs", spark.createDataFrame([("p", 0, "No ledger window, but\nthe kafka queue")], "id string, rank long, body string"))]
    bodies = spark.createDataFrame([("a", "Unlike it.\n\nThe retry  backoff\npolicy is five."), ("b", "other")], "id string, body string")
    scores = {"high": (0.03, 0.011, 1), "flat": (0.03, 0.001, 4), "low": (0.02, 0.02, 1), "lied": (0.03, 0.02, 1), "silent": (0.03, 0.02, 1)}
    search = answered(spark, [(k, "a", 1) for k in scores] + [("high", "b", 2)], [(k, *v) for k, v in scores.items()])

    def judge(asked, shown):
        said = ground.best_paragraph(asked, shown).where("query_id <> 'silent'")
        return said.selectExpr("query_id", "IF(query_id = 'lied', 'what nobody wrote', quote) AS quote")

    got = {r["query_id"]: r for r in ground.resolve(q, rungs, search, bodies, judge).collect()}
    assert {k: r["rung"] for k, r in got.items()} == {"local": "context", "later": "docs", "high": "knowledge_base", **dict.fromkeys(["flat", "low", "lied", "silent", "empty"], "human")}
    assert got["high"]["answer"] == "The retry backoff policy is five." and got["high"]["id"] == "a" and got["later"]["answer"] == "No ledger window, but the kafka queue"
    assert got["flat"]["score_gap"] == 0.001 and got["lied"]["answer"] is None and got["empty"]["top_score"] is None and got["local"]["top_score"] is None
