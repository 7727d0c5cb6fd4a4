"""Queries of the requirement-tree analyser over one requirement body for each document.

A document's body is the case that its id chooses, with the document as work
item and as the source that is cited; what is cited stands at the end of the
document's own text. The oracles are the findings planted in each case, for the
documents that take it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from marlstone.reqs import rules, samples, tree

Q: dict = {}
O: dict = {}  # noqa: E741


CASES = list(samples.CASES)
CITED = samples.DOCS[0]


def cases(spark):
    """case and template: one row for each sample, a fixed number."""
    return spark.createDataFrame([(k, b) for k, (_, b) in enumerate(samples.bodies())], "case int, template string")


def sources(spark, sf_dir: str):
    """The documents that have an id."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL").select(F.concat(F.lit("doc:"), "doc_id").alias("name"), "doc_id", "text")


def bodies(spark, sf_dir: str):
    """body_id and body, a row for each document."""
    d = sources(spark, sf_dir).select("name", F.pmod("doc_id", F.lit(len(CASES))).cast("int").alias("case"))
    own = F.replace(F.replace("template", F.lit(f'"{CITED[0]}"'), F.concat(F.lit('"'), "name", F.lit('"'))), F.lit('"PAY-1"'), F.concat(F.lit('"'), "name", F.lit('"')))
    return d.join(F.broadcast(cases(spark)), "case").select(F.col("name").alias("body_id"), own.alias("body"))


def docs(spark, sf_dir: str):
    """doc_id and text: each document with the passage that its body cites after its own text."""
    return sources(spark, sf_dir).select(F.col("name").alias("doc_id"), F.concat_ws("\n", "text", F.lit(CITED[1])).alias("text"))


def name_of(rule: str) -> str:
    return "reqs_" + rule.lower().replace("-", "_")


def findings(spark, sf_dir: str, rule: str):
    """body_id, severity and path of one rule's findings in all bodies, whether they parse or not."""
    return rules.run(rule, tree.read(bodies(spark, sf_dir)), docs(spark, sf_dir)).select("body_id", "severity", "path")


def planted(columns: str, rows: list, chosen: str) -> str:
    """SQL for ``rows`` (the case first), once for each document that takes the case."""
    if not rows:
        return f"SELECT 'doc:' || doc_id AS body_id, {chosen} FROM (SELECT doc_id, {', '.join(f"'' AS {c.strip()}" for c in columns.split(','))} FROM documents) WHERE false"
    listed = ", ".join(str((CASES.index(case), *rest)) for case, *rest in rows)
    return f"SELECT 'doc:' || d.doc_id AS body_id, {chosen} FROM documents d JOIN (VALUES {listed}) AS p(k, {columns}) ON d.doc_id % {len(CASES)} = p.k"


for _rule, (_severity, _) in rules.RULES.items():
    Q[name_of(_rule)] = partial(findings, rule=_rule)
    O[name_of(_rule)] = planted("severity, path", [(b, _severity, p) for b, f in samples.PLANTED.items() for r, p in f if r == _rule], "severity, path")


def verdicts(spark, sf_dir: str, lint: bool = False):
    return rules.verdicts(bodies(spark, sf_dir), docs(spark, sf_dir), lint)


def _verdict(body: str, lint: bool) -> tuple:
    found = samples.PLANTED[body]
    broken = any(r == "SCHEMA-001" for r, _ in found)
    kinds = ["warning" if lint and r.startswith("GATE-") else rules.RULES[r][0] for r, _ in found if not broken or r == "SCHEMA-001"]
    return body, kinds.count("error"), kinds.count("warning"), 1 if broken else len(rules.RULES), "error" not in kinds


for _lint, _name in ((False, "reqs_verdicts"), (True, "reqs_lint")):
    Q[_name] = partial(verdicts, lint=_lint)
    O[_name] = planted("errors, warnings, checks_run, ok", [_verdict(b, _lint) for b in samples.PLANTED], "errors, warnings, checks_run, ok")


def _band(size):
    """The least band that is not below ``size``, else the last."""
    return F.coalesce(F.array_min(F.filter(F.array(*[F.lit(float(b)) for b in tree.BANDS]), lambda b: b >= size)), F.lit(float(tree.BANDS[-1])))


def scoring(spark, sf_dir: str):
    """Magnitude, zone, admissible and recommended decisions for every document as a work item.

    Its complexity is the band of its length in hundreds of characters, its unknowns
    the band of its sentences; recommended after a pass of equal unknowns.
    """
    text = F.coalesce("text", F.lit(""))
    d = sources(spark, sf_dir).select("doc_id", _band(F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))).alias("unknowns"), _band(F.length(text) / 100).alias("complexity"))
    d, p = d.withColumn("p", F.struct("unknowns", "complexity")), F.col("p")
    return d.select("doc_id", "unknowns", "complexity", tree.magnitude(p).alias("magnitude"), tree.zone(tree.magnitude(p)).alias("zone"), F.array_join(tree.decision_space(p), ",").alias("admissible"), tree.recommended(p, F.col("unknowns")).alias("recommended"))


def _band_sql(size: str) -> str:
    return "CASE " + " ".join(f"WHEN {size} <= {b} THEN {b}.0" for b in (1, 2, 3, 5, 8, 13)) + " ELSE 21.0 END::DOUBLE"


_LENGTH, _STOPS = "length(coalesce(text, ''))", "length(regexp_replace(coalesce(text, ''), '[^.]', '', 'g'))"
Q["reqs_scoring"] = scoring
O["reqs_scoring"] = f"""SELECT doc_id, u AS unknowns, c AS complexity, greatest(u, c) AS magnitude,
CASE WHEN u <= 2 AND c <= 2 THEN 'atomic' WHEN u < 5 AND c < 5 THEN 'review' ELSE 'must_break_down' END AS zone,
CASE WHEN u <= 2 AND c <= 2 THEN 'leaf' WHEN u < 5 AND c < 5 THEN 'leaf,decompose' WHEN u >= 5 THEN 'decompose,clarify' ELSE 'decompose' END AS admissible,
CASE WHEN u >= 5 THEN 'clarify' WHEN c >= 5 THEN 'decompose' ELSE 'leaf' END AS recommended
FROM (SELECT doc_id, {_band_sql(_STOPS)} AS u, {_band_sql(_LENGTH + " / 100.0")} AS c FROM documents WHERE doc_id IS NOT NULL)"""
