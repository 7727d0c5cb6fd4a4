"""The index of fields against plain loops over the texts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions.markdown import parse_query
from marlstone.functions.stem import STOP, stem
from marlstone.operators import evaluate, lexical
from marlstone.plans.lexical import STEMS
from marlstone.sources import fielded

rng = random.Random(4)
WORDS = ["the", "of", "retry", "retries", "retrying", "payment", "payments", "policy", "queue", "ha", "not", "knots", "b2"]
CHUNKS = [("t", f"d{k % 40}", k // 40, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(4))) or None, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 18)))) for k in range(120)]
MORE = ("consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistent consist consolation consol "
        "consolatory consolatori consolidate consolid consolingly consol consonant conson conspicuous conspicu conspiracy conspiraci conspirator conspir conspire conspir "
        "constable constabl constance constanc constant constant knack knack knackeries knackeri knavish knavish kneaded knead kneel kneel knees knee knew knew knif knif "
        "knife knife knightly knight knits knit knitting knit knives knive knocker knocker knocking knock knots knot skies sky dying die news news ugly ugli "
        "generous generous communication communic proceed proceed hopping hop hoping hope cries cri ties tie by by luxuriated luxuri sized size").split()


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "tenant string, id string, seq int, heading string, text string").repartition(3)


@pytest.fixture(scope="module", params=[True, False])
def ix(request, chunks):
    return fielded.build(chunks, request.param)


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def indexed(ix, ws):
    """The words by place, None where none is indexed."""
    return [(stem(w) if w not in STOP else None) if ix.english else w for w in ws]


def test_stems_are_those_published():
    assert {w: stem(w) for w in STEMS} == STEMS
    assert [(w, stem(w)) for w in MORE[::2]] == list(zip(MORE[::2], MORE[1::2]))
    assert [stem(w) for w in ("", "a", "é", "x1", "naïve")] == ["", "a", "é", "x1", "naïve"]


def test_postings_hold_every_place(ix):
    want = set()
    for t, i, s, h, b in CHUNKS:
        for w in {*indexed(ix, words(h)), *indexed(ix, words(b))} - {None}:
            want.add((w, i, s, tuple(k for k, x in enumerate(indexed(ix, words(h))) if x == w), tuple(k for k, x in enumerate(indexed(ix, words(b))) if x == w), len(words(h)) + len(words(b))))
    got = [(r["stem"], r["id"], r["seq"], tuple(r["heading"]), tuple(r["body"]), r["len"]) for r in ix.postings.collect()]
    assert len(got) == len(want) and set(got) == want
    assert {(r["stem"], r["df"]) for r in ix.terms.collect()} == {(w, len({x[1:3] for x in want if x[0] == w})) for w in {x[0] for x in want}}


def stands(ix, phrase, text):
    """How often the phrase stands in the text; words that are not indexed stand for any."""
    p, t = indexed(ix, phrase), indexed(ix, words(text))
    while p and p[0] is None:
        p = p[1:]
    while p and p[-1] is None:
        p = p[:-1]
    return sum(all(a is None or a == b for a, b in zip(p, t[k:])) for k in range(len(t) - len(p) + 1)) if p else 0


def test_phrases_of_any_length(spark, ix):
    asked = [[rng.choice(WORDS) for _ in range(rng.choice([1, 2, 2, 2, 3, 4]))] for _ in range(60)] + [["ha", "ha"], ["retry", "the", "payment"], ["nowhere", "ha"]]
    rows = [(f"q{n}", 0, k, w) for n, p in enumerate(asked) for k, w in enumerate(p)]
    got = lexical.phrases(ix, ix.stemmed(spark.createDataFrame(rows, "query_id string, part int, slot int, term string"))).collect()
    want = {(f"q{n}", i, s): (stands(ix, p, h), stands(ix, p, b)) for n, p in enumerate(asked) for _, i, s, h, b in CHUNKS}
    assert {(r["query_id"], r["id"], r["seq"]): (r["in_heading"], r["in_text"]) for r in got} == {k: v for k, v in want.items() if any(v)}


def test_phrases_read_no_text(spark, ix):
    rows = [("q", 0, 0, "retry"), ("q", 0, 1, "policy")]
    df = lexical.phrases(ix, ix.stemmed(spark.createDataFrame(rows, "query_id string, part int, slot int, term string")))
    assert not [f for f in df.inputFiles() if "fielded" not in f]


def test_web_queries(spark, ix):
    asked = ['retry "payment policy"', "queue -knots", "ha", '-the payments "of the retries"', "", "-ha", "nowhere policy", 'retry retry "queue"', '"ha ha" -b2 retrying']
    got = lexical.web_matches(ix, spark.createDataFrame([(f"q{n}", q) for n, q in enumerate(asked)], "query_id string, query string")).collect()
    want = {}
    for n, q in enumerate(asked):
        terms, quoted, negated = parse_query(q)
        parts = [p for p in [*([t] for t in dict.fromkeys(terms)), *quoted] if any(indexed(ix, p))]
        excluded = [w for w in negated if indexed(ix, [w]) != [None]]
        for _, i, s, h, b in CHUNKS:
            found = [(stands(ix, p, h), stands(ix, p, b)) for p in parts]
            hits = [f for f in found if any(f)]
            if not hits or any(stands(ix, [w], h) + stands(ix, [w], b) for w in excluded):
                continue
            strict = len(hits) == len(parts)
            if strict or not excluded:
                want[f"q{n}", i, s] = (round(sum(x + 0.2 * y for x, y in hits) / (1 + math.log(len(words(h)) + len(words(b)))), 9), strict)
    assert {(r["query_id"], r["id"], r["seq"]): (round(r["rank"], 9), r["strict"]) for r in got} == want and len(want) > 60


def test_a_word_in_the_heading_changes_the_order(spark):
    rows = [("t", "body", 0, "other words here", "retry retry retry retry text"), ("t", "head", 0, "Retrying it", "some other words in here now")]
    ix = fielded.build(spark.createDataFrame(rows, "tenant string, id string, seq int, heading string, text string"), True)
    asked = ix.stemmed(spark.createDataFrame([("q", "retries")], "query_id string, term string"))
    assert [r["id"] for r in lexical.field_rank(ix, asked).orderBy(F.desc("rank")).collect()] == ["head", "body"]
    flat = lambda r: len(r["heading"]) + len(r["body"])
    assert [r["id"] for r in sorted(ix.of(asked).collect(), key=flat, reverse=True)] == ["body", "head"]


def test_best_documents_without_reading_all(spark, monkeypatch):
    monkeypatch.setattr(fielded, "PER_RANGE", 4)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [("t", f"d{k:04}", 0, None, " ".join(rng.choices(vocabulary, [1 / (n + 1) for n in range(300)], k=rng.randrange(5, 40)))) for k in range(3000)]
    ix = fielded.build(spark.createDataFrame(rows, "tenant string, id string, seq int, heading string, text string"), False)
    asked = [(f"q{n}", w) for n in range(12) for w in rng.sample(vocabulary[5:], 3)] + [("none", "nowhere")]
    w = spark.createDataFrame(asked, "query_id string, stem string")
    docs = ix.postings.select("tenant", "id").distinct().where("id NOT LIKE '%7'")
    for seen in (None, docs):
        read: list = []
        got = lexical.top_documents(ix, w, 10, seen, read=read)
        full = lexical._top(lexical.scored(ix, ix.rarity(w.distinct()), None, seen), 10)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.select(*got.columns).collect())) and got.count() == 120
        assert sum(read) < 0.7 * ix.of(w).count(), read


def test_measures(spark):
    ranked = spark.createDataFrame([("a", f"d{k}", k) for k in range(1, 61)] + [("b", "x", 1), ("c", "y", 1)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("a", "d2", 2), ("a", "d55", 1), ("a", "d1", 0), ("a", "gone", 1), ("b", "z", 1), ("d", "z", 1)], "query_id string, doc_id string, grade int")
    got = {r["query_id"]: r for r in evaluate.measured(ranked, qrels).collect()}
    a = got["a"]
    ideal = 2 + 1 / math.log2(3) + 1 / 2
    assert (a["returned"], a["relevant"], a["recall_10"], a["recall_50"], a["mrr"], a["judged_10"]) == (60, 3, 1 / 3, 1 / 3, 0.5, 0.2) and abs(a["ndcg_10"] - 2 / math.log2(3) / ideal) < 1e-9
    assert got["b"]["recall_10"] == 0 and got["b"]["mrr"] == 0 and got["c"]["recall_10"] is None and got["d"]["returned"] == 0 and got["d"]["ndcg_10"] == 0
    s = evaluate.summary(evaluate.measured(ranked, qrels)).first()
    assert (s["queries"], s["judged"], s["mrr"]) == (4, 3, round(0.5 / 3, 6))


def test_an_empty_table_gives_an_empty_index(spark, chunks):
    for english in (True, False):
        ix = fielded.build(chunks.where("false"), english)
        w = spark.createDataFrame([("q", "retry")], "query_id string, stem string")
        assert ix.postings.count() == 0 and lexical.top_documents(ix, w).collect() == []
        assert lexical.web_matches(ix, spark.createDataFrame([("q", 'retry "of it" -x')], "query_id string, query string")).collect() == []
