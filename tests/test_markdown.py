"""Hand-computed values of the markdown functions, and files as sources."""

from pyspark.sql import functions as F

from marlstone.functions import markdown as M
from marlstone.sources import files

BODY = "intro\n\n# A\n\ntext a\n## B\nfirst\n\nsecond\n# C\n\n# D\nlast"


def test_sections_and_spans():
    assert list(M.sections("T", BODY)) == [("T", "intro", 1, 1), ("T > A", "text a", 5, 5), ("T > A > B", "first\n\nsecond", 7, 9), ("T > D", "last", 13, 13)]
    assert list(M.sections("T", None)) == list(M.sections("T", " \n# x\n")) == []


def test_packing():
    assert list(M.packed("aa\n\nbb\n\ncc", 6)) == ["aa\n\nbb", "cc"]
    assert list(M.packed("aa\n\n" + "x" * 13 + "\n\nbb", 6)) == ["aa", "x" * 6, "x" * 6, "x", "bb"]


def test_chunks(spark):
    docs = spark.createDataFrame([("1", "T", BODY), ("2", None, None)], "id string, title string, body string")
    got = M.chunk_markdown(docs).orderBy("seq").collect()
    assert [(r.id, r.seq, r.heading_path, r.line_start) for r in got] == [("1", 0, "T", 1), ("1", 1, "T > A", 5), ("1", 2, "T > A > B", 7), ("1", 3, "T > D", 13)]


def test_columns(spark):
    x = spark.range(1).select(
        M.first_heading(F.lit("~~~\n# no\n~~~ \n## two\n# Yes it is \n")).alias("h"), M.first_heading(F.lit("```\n# open")).alias("none"),
        M.golden(F.lit("- `how to retry` → a:1, b:2 — a note")).alias("g"), M.golden(F.lit("text")).alias("other"),
        M.zones(F.lit(2), F.lit(1)).alias("atomic"), M.zones(F.lit(3), F.lit(1)).alias("review"), M.zones(F.lit(5), F.lit(1)).alias("both"), M.zones(F.lit(1), F.lit(5)).alias("top"),
    ).first()
    assert (x.h, x.none, x.other) == ("Yes it is", None, None)
    assert (x.g.query, x.g.ids) == ("how to retry", ["a:1", "b:2"])
    assert (x.atomic, x.review, x.both, x.top) == (["leaf"], ["leaf", "decompose"], ["decompose", "clarify"], ["decompose"])


def test_parse_query():
    assert M.parse_query('retry "back off" -legacy "one"') == (["retry", "one"], [["back", "off"]], ["legacy"])
    assert M.parse_query("") == ([], [], [])


def test_sources(spark, tmp_path):
    for name, body in (("a/x.md", "# Title\ntext"), ("y.md", "no heading"), (".trash/z.md", "# gone"), ("n.txt", "# no")):
        f = tmp_path / "v" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    assert sorted(r.title for r in files.vault(spark, str(tmp_path / "v")).collect()) == ["Title", "y"]
    (tmp_path / "one.json").write_text('{\n"id": "1"}')
    (tmp_path / "two.json").write_text('[{"id": "2"},\n{"id": "3"}]')
    assert sorted(r.id for r in files.payloads(spark, str(tmp_path / "*.json"), "id string").collect()) == ["1", "2", "3"]
