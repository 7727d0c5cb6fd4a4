import json
import subprocess
import sys

import pytest

from marlstone import __main__ as cli
from marlstone import providers, report

SF = "/root/testdata/sf0.001"


def test_report_is_one_page_with_what_views_hold_escaped(spark, tmp_path):
    out = tmp_path / "r.html"
    assert cli.main(["--data", SF, "report", "--out", str(out)], spark) == 0
    page = out.read_text()
    assert page.count("<section>") == len(report.SECTIONS) and "<svg" in page and "src=" not in page
    assert "&lt;b&gt;" in report.table(["a"], [("<b>",), (None,)], 5) and "2 of 5" in report.table(["a"], [("x",), ("y",)], 5)
    assert "no data yet" in report.table(["a"], [], 0) and report.bars([]) == "" and "&lt;" in report.bars([("<", 0)])


def test_command_line(spark, tmp_path, capsys):
    out = str(tmp_path / "o")
    assert cli.main(["--data", SF, "sql", "SELECT count(*) AS n FROM nation", "--out", out], spark) == 0 and spark.read.parquet(out).first()["n"] == 25
    assert cli.main(["--data", SF, "run", "corpus_mode"], spark) == 0 and cli.main(["run", "none"], spark) == 2
    capsys.readouterr()
    assert cli.main(["list"]) == 0 and "search_docs" in capsys.readouterr().out.split()
    capsys.readouterr()
    assert cli.main(["--data", SF, "call", "get_doc", "id=doc:none", "--principal", "u"], spark) == 1
    assert "doc:none" in json.loads(capsys.readouterr().out)["error"]
    assert cli.arguments("search_docs", ["query=a=b", "limit=3", "include_superseded=true"]) == {"query": "a=b", "limit": 3, "include_superseded": True}


def test_providers(spark):
    http = providers.Http("https://h.example/", "m", "k", lambda url, body, headers: {"choices": [{"message": {"content": url + str(len(body["messages"])) + headers["Authorization"]}}], "usage": {"prompt_tokens": 3}})
    rec = providers.Recorder(http)
    live = rec.complete("p", "s")
    assert live.text == "https://h.example/chat/completions2Bearer k" and live.prompt_tokens == 3 and live.provenance == "live"
    again = providers.provider("recorded", json.loads(json.dumps(rec.answers)))
    assert again.complete("p", "s").text == live.text and again.complete("p", "s").provenance == "replay"
    with pytest.raises(LookupError):
        again.complete("other")
    with pytest.raises(ValueError):
        providers.provider("none")
    echo = providers.Command([sys.executable, "-c", "import sys; print(sys.argv[1])"])
    assert echo.complete("$HOME; x", "s").text == "s\n\n$HOME; x"
    with pytest.raises(subprocess.CalledProcessError):
        providers.Command([sys.executable, "-c", "raise SystemExit(1)"]).complete("x")


def test_prompts_of_a_table_fail_alone(spark):
    known = providers.prompt_key("a", None, None)
    answers = {known: {"text": "A", "provider": "x", "prompt_tokens": 1}}
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, prompt string")
    got = {r["id"]: (r["text"], r["error"] is None) for r in providers.complete_all(df, lambda: providers.Recorded(answers)).collect()}
    assert got == {"1": ("A", True), "2": (None, False), "3": (None, False)}
