from marlstone.operators import maintain


def test_reconcile(spark):
    live = spark.createDataFrame([("t", f"a:{k}") for k in range(10)] + [("t", "b:1")], "tenant string, id string")
    listed = spark.createDataFrame([("t", f"a:{k}") for k in range(8)] * 2 + [("u", "a:9")], "tenant string, id string")
    ask = lambda *a, **b: (lambda v, d: (v, sorted(r["id"] for r in d.collect())))(*maintain.reconcile(live, listed, *a, **b))
    assert ask() == ("retired", ["a:8", "a:9", "b:1"]) and ask(prefix="a:") == ("retired", ["a:8", "a:9"])
    assert ask(complete=False) == ("incomplete", []) and ask(prefix="b:") == ("refused", [])
    assert maintain.reconcile(live.limit(0), listed)[0] == "retired"


def test_a_failed_item_holds_the_cursor_back(spark):
    rows = [("x", 1, True), ("x", 2, False), ("x", 3, True), ("y", 5, True), ("y", 4, True), ("z", 7, False)]
    got = {r["source"]: (r["cursor"], r["failures"]) for r in maintain.advance(spark.createDataFrame(rows, "source string, at int, landed boolean")).collect()}
    assert got == {"x": (2, 1), "y": (5, 0), "z": (7, 1)}


def test_integrity_counts_faults_and_work(spark):
    doc = "tenant string, id string, owner string, source string, quarantined boolean, body string"
    text = "x" * 60
    good = [("t", "a", "kim", "wiki", False, text), ("u", "a", "kim", "code", False, text + "</div>")]
    chunk = "tenant string, id string, len int"
    tables = lambda docs, chunks, vectors=(), links=(), cursors=(): maintain.integrity(
        spark.createDataFrame(docs, doc), spark.createDataFrame(chunks, chunk), spark.createDataFrame([(v,) for v in vectors], "id string"),
        spark.createDataFrame(list(links), "tenant string, dst_id string"), spark.createDataFrame(list(cursors), "age_hours int"))
    ask = lambda *a: {r["check_name"]: r["n"] for r in tables(*a).collect()}
    healthy = ask(good, [("t", "a", 3), ("u", "a", 2)], ["a"], [("t", "a")], [(1,)])
    assert healthy.pop("ok") == 1 and healthy.pop("docs_total") == 2 and len(healthy) == 9 and not any(healthy.values())
    got = ask([*good, ("t", "b", "", "wiki", False, "short </p>"), ("t", "q", "kim", "wiki", True, text)], [("t", "a", 3), ("t", "a", 0), ("t", "b", 1)], ["b"], [("t", "gone"), ("t", "gone"), ("u", "b")], [(25,), (None,), (2,)])
    assert got == {"docs_total": 4, "docs_without_chunks": 1, "docs_unowned": 1, "docs_empty_body": 1, "docs_html_residue": 1, "chunks_null_tsv": 1, "docs_quarantined": 1, "chunks_unembedded": 2, "links_dangling_dst": 3, "stale_sources": 1, "ok": 0}
    assert ask([], [])["ok"] == 1
