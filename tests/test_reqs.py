"""Every rule of the requirement-tree analyser on bodies with planted findings."""

import json

import pytest

from marlstone.reqs import rules, samples, tree
from marlstone.sources.store import written


@pytest.fixture(scope="module")
def trees(spark):
    t = tree.read(spark.createDataFrame(samples.bodies(), "body_id string, body string").coalesce(1))
    return tree.Trees(written(t.bodies, "test-bodies"), written(t.nodes, "test-nodes"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(samples.DOCS, "doc_id string, text string")


def test_there_are_46_rules():
    assert len(rules.RULES) == 46
    fired = {r for f in samples.PLANTED.values() for r, _ in f}
    assert fired == set(rules.RULES) - {"TRACE-007"}  # that one is reserved


@pytest.mark.parametrize("name", list(rules.RULES))
def test_rule_finds_what_is_planted(trees, docs, name):
    got = sorted((r["body_id"], r["path"]) for r in rules.run(name, trees, docs).collect())
    assert got == sorted((b, p) for b, f in samples.PLANTED.items() for r, p in f if r == name)


def test_without_documents_the_quote_rule_is_skipped(spark):
    b = spark.createDataFrame([x for x in samples.bodies() if x[0] in ("sound", "misquoted")], "body_id string, body string")
    assert [tuple(r) for r in rules.verdicts(b).orderBy("body_id").collect()] == [("misquoted", 0, 0, 45, True), ("sound", 0, 0, 45, True)]


def test_trees_deeper_than_one_projection(spark):
    b = samples.sound()
    at = b["tree"]["children"][1]
    for k in range(30):
        child = samples.node(at["id"] + ".3", f"k{k}", 3, 5, "decompose", children=[])
        at["children"].append(child)
        at = child
    t = tree.read(spark.createDataFrame([("x", json.dumps(b)), ("y", None), ("z", "[]"), ("w", "{}")], "body_id string, body string"))
    assert t.nodes.count() == 35 and t.nodes.selectExpr("max(depth)").first()[0] == 32
    assert {r["body_id"] for r in rules.run("SCHEMA-001", t).collect()} == {"y", "z", "w"}


def test_generated_fields(trees):
    got = {r["id"]: tuple(r)[2:] for r in rules.assembled_fields(trees).where("body_id = 'sound'").collect()}
    assert got["REQ-ROOT.1"] == (2, "atomic", True, "leaf") and got["REQ-ROOT"] == (8, "must_break_down", False, "decompose") and got["REQ-ROOT.2.2"][1] == "review"
