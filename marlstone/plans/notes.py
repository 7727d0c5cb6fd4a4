"""Plans over notes and markdown, each with its oracle where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import markdown, pages, text
from marlstone.operators import ivf
from marlstone.plans.frames import SNIPPET
from marlstone.plans.portable import oracle
from marlstone.sources.catalog import view

Q: dict = {
    "chunk_markdown": lambda s, d: markdown.chunk_markdown(view(s, d, "docs").select("id", "title", F.concat(F.lit("# Top\n\n"), "body").alias("body"))),
    "first_heading": lambda s, d: view(s, d, "docs").select("id", markdown.first_heading(F.concat(F.lit("```\n# code\n```\n# Note "), "id", F.lit(" \n# later\n"), "body")).alias("heading")),
    "truncated_flag": lambda s, d: view(s, d, "docs").select("id", markdown.truncated(text.slice_snippet(F.col("body")), F.col("body")).alias("truncated")),
    "lex_simple_index": lambda s, d: view(s, d, "docs").where("source = 'code'")
    .select("id", F.explode(F.regexp_extract_all(F.lower("body"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")),
}

O: dict = {  # noqa: E741
    "first_heading": oracle("SELECT id, 'Note ' || id AS heading FROM {docs}"),
    "truncated_flag": oracle(f"SELECT id, length({SNIPPET}) < length(regexp_replace(body, '^\\W+|\\W+$', '', 'g')) AS truncated FROM {{docs}}"),
    "lex_simple_index": oracle("SELECT id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(body), '[a-z0-9_]+')) AS term FROM {docs} WHERE source = 'code') GROUP BY id, term"),
}

Q["normalize_page"] = lambda s, d: pages.normalize(
    view(s, d, "docs").selectExpr(
        "id", "title", "url", "owner AS author", "CAST(NULL AS string) AS created", "IF(n % 3 = 0, '2024-01-02', NULL) AS updated", "CAST(NULL AS array<string>) AS ancestors",
        "array(acl_group) AS acl_groups", "CASE n % 4 WHEN 0 THEN array('x', ' Archived ') WHEN 1 THEN array('x') END AS labels", "body",
    )
).select("id", "valid_from", "valid_to", F.sha2("body", 256).alias("digest"), F.array_join("acl_groups", ",").alias("acl"))
O["normalize_page"] = oracle(
    "SELECT 'confluence:page:' || id AS id, CASE WHEN n % 3 = 0 THEN '2024-01-02' END AS valid_from, CASE WHEN n % 4 = 0 THEN CASE WHEN n % 3 = 0 THEN '2024-01-02' ELSE '1970-01-01T00:00:00.000Z' END END AS valid_to,"
    " sha256(CASE n % 4 WHEN 0 THEN '**Labels:** x,  Archived ' || chr(10) || chr(10) WHEN 1 THEN '**Labels:** x' || chr(10) || chr(10) ELSE '' END || body) AS digest, coalesce(acl_group, '') AS acl FROM {docs}"
)

Q["ivf_probe"] = ivf.probes
O["ivf_probe"] = oracle(
    "SELECT query_id, probe FROM (SELECT q.id AS query_id, c.cluster_id AS probe, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.vec::DOUBLE[], c.vec) / sqrt(list_dot_product(c.vec, c.vec)) DESC, c.cluster_id) AS rn"
    " FROM (SELECT id, vec FROM {vectors} WHERE n % 20 = 0) q CROSS JOIN (SELECT cluster_id, list(x ORDER BY pos) AS vec FROM (SELECT cluster_id, pos, avg(x::DOUBLE) AS x FROM"
    " (SELECT cluster_id, unnest(range(1, len(vec) + 1)) AS pos, unnest(vec) AS x FROM {vectors}) GROUP BY cluster_id, pos) GROUP BY cluster_id) c) WHERE rn <= 4"
)
