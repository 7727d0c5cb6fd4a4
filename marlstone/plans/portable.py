"""Plans whose SQL means the same to Spark and to the oracle; ``{name}`` is a catalog view."""

from __future__ import annotations

import re

from marlstone.sources.catalog import VIEWS, prelude, view

VISIBLE = "d.tenant = 'default' AND NOT d.tombstoned AND NOT d.quarantined AND (d.owner = 'user2' OR d.acl_group IN ('g0', 'g1'))"

PLANS = {
    # scans, projections, filters
    "scan_catalog": "SELECT id, source, title FROM {docs} WHERE tenant = 'default' AND source = 'jira'",
    "acl_visible": f"SELECT id FROM {{docs}} d WHERE {VISIBLE} AND NOT d.superseded",
    "acl_restricted_focal": "SELECT id FROM {docs} d WHERE d.tenant = 'default' AND (d.tombstoned OR d.quarantined OR NOT (d.owner = 'user2' OR d.acl_group IN ('g0', 'g1')))",
    "superseded_filter": f"SELECT id, superseded FROM {{docs}} d WHERE {VISIBLE}",
    "source_filter": "SELECT source, CAST(count(*) AS BIGINT) AS docs FROM {docs} WHERE source IN ('code', 'jira') GROUP BY source",
    "source_filter_empty": "SELECT id FROM {docs} WHERE source IN (SELECT source FROM {docs} WHERE false)",
    "evidence_verified": "SELECT c.id, c.seq, coalesce(instr(d.body, CASE WHEN c.seq % 7 = 3 THEN c.text || ' (not in the text)' ELSE c.text END) > 0, false) AS verified FROM {chunks} c JOIN {docs} d ON c.tenant = d.tenant AND c.id = d.id",
    "model_match_filter": "SELECT id, cluster_id FROM {vectors} WHERE CASE WHEN n % 2 = 0 THEN 'm1' ELSE 'm2' END = 'm1'",
    "cluster_filter": "SELECT id FROM {vectors} WHERE cluster_id IN (1, 3, 5)",
    "code_filter": "SELECT id, title FROM {docs} WHERE source = 'code' AND acl_group = 'g1' AND tenant = 'other'",
    "null_safe_neq": "SELECT a.id FROM {docs} a JOIN {docs} b ON a.tenant = b.tenant AND a.n = b.n + 2 WHERE a.age_days IS DISTINCT FROM b.age_days",
    "like_residue": "SELECT id FROM {docs} WHERE body LIKE '%</div>%' OR body LIKE '%&amp;%' OR title LIKE '%&%'",
    "length_threshold": "SELECT id, CASE WHEN length(body) < 40 THEN 'short' WHEN length(body) > 8000 THEN 'huge' WHEN length(body) > 1024 THEN 'long' ELSE 'fit' END AS size FROM {docs}",
    "corpus_mode": "SELECT CASE WHEN sum(CASE WHEN url LIKE '%example%' OR url IS NULL THEN 0 ELSE 1 END) = 0 THEN 'fixtures' ELSE 'live' END AS mode FROM {docs}",
    # joins
    "join_chunks_docs": "SELECT c.id, c.seq, d.source, c.len FROM {chunks} c JOIN {docs} d ON c.tenant = d.tenant AND c.id = d.id",
    "join_code_docs": "SELECT c.id, c.seq FROM {chunks} c JOIN {docs} d ON c.tenant = d.tenant AND c.id = d.id WHERE d.source = 'code'",
    "join_query_const": "SELECT p.id, p.seq, p.tf FROM {postings} p CROSS JOIN (SELECT 'the' AS term) q WHERE p.term = q.term",
    "join_links_left": f"SELECT l.src_id, l.dst_id, l.rel, d.title FROM {{links}} l LEFT JOIN {{docs}} d ON l.tenant = d.tenant AND l.dst_id = d.id WHERE l.tenant = 'default' AND (d.id IS NULL OR ({VISIBLE}))",
    "join_docs_chunks_left": "SELECT d.source, CAST(count(DISTINCT d.id) AS BIGINT) AS docs, CAST(count(c.seq) AS BIGINT) AS chunks FROM {docs} d LEFT JOIN {chunks} c ON d.tenant = c.tenant AND d.id = c.id GROUP BY d.source",
    "join_lexeme_left": "SELECT q.term, CAST(coalesce(s.df, 0) AS BIGINT) AS df FROM (SELECT 'the' AS term UNION ALL SELECT 'de' UNION ALL SELECT 'nosuchterm') q LEFT JOIN (SELECT term, count(*) AS df FROM {postings} GROUP BY term) s ON q.term = s.term",
    "semi_exists": "SELECT id FROM {docs} d WHERE EXISTS (SELECT 1 FROM {links} l WHERE l.tenant = d.tenant AND l.src_id = d.id AND l.rel = 'parent')",
    "anti_unembedded": "SELECT c.id, c.seq FROM {chunks} c WHERE NOT EXISTS (SELECT 1 FROM {vectors} v WHERE v.id = c.id)",
    "anti_unchunked": "SELECT d.id FROM {docs} d WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM {chunks} WHERE len > 3) c WHERE c.tenant = d.tenant AND c.id = d.id AND d.n % 50 <> 7)",
    "anti_dangling": "SELECT l.src_id, l.dst_id, l.rel FROM {links} l WHERE NOT EXISTS (SELECT 1 FROM {docs} d WHERE d.tenant = l.tenant AND d.id = l.dst_id)",
    "anti_orphan_blob": "SELECT DISTINCT b.tenant, b.digest FROM {blobs} b WHERE NOT EXISTS (SELECT 1 FROM {blobs} v WHERE v.tenant = b.tenant AND v.digest = b.digest AND NOT v.expired)",
    "anti_listing": "SELECT d.id FROM {docs} d WHERE d.source = 'jira' AND NOT d.tombstoned AND NOT EXISTS (SELECT 1 FROM {docs} x WHERE x.tenant = d.tenant AND x.id = d.id AND x.n % 4 <> 1)",
    "anti_unjudged": "SELECT DISTINCT r.query_id, r.doc_id FROM {ranked} r WHERE NOT EXISTS (SELECT 1 FROM {qrels} q WHERE q.query_id = r.query_id AND q.doc_id = r.doc_id) AND r.rank <= 20",
    "join_runs_using": "SELECT query_id, a.doc_id, a.rank AS rank_a, b.rank AS rank_b FROM {ranked} a JOIN {ranked} b USING (query_id) WHERE a.run = 1 AND b.run = 2 AND a.doc_id = b.doc_id",
    "join_keys_unnest": "SELECT p.id, CAST(count(*) AS BIGINT) AS n FROM {postings} p WHERE p.id IN (SELECT id FROM {docs} WHERE tombstoned) GROUP BY p.id",
    "scalar_subquery_count": "SELECT d.id, CAST(coalesce(c.n, 0) AS BIGINT) AS section_count FROM {docs} d LEFT JOIN (SELECT tenant, id, count(*) AS n FROM {chunks} GROUP BY tenant, id) c ON d.tenant = c.tenant AND d.id = c.id",
    "keyset_theta": "SELECT id, seq FROM {chunks} WHERE id > 'doc:5' OR (id = 'doc:5' AND seq > 2)",
    # aggregates
    "agg_df": "SELECT term, CAST(count(*) AS BIGINT) AS df FROM {postings} GROUP BY term",
    "agg_corpus_stats": "SELECT CAST(count(*) AS BIGINT) AS n, round(coalesce(avg(len), 0), 6) AS avgdl FROM {chunks}",
    "agg_count_distinct": "SELECT source, CAST(count(DISTINCT owner) AS BIGINT) AS owners FROM {docs} GROUP BY source",
    "agg_distinct_subq": "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT tenant, src_id FROM {links}) x",
    "agg_filter": "SELECT tenant, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS bad FROM {audit} GROUP BY tenant",
    "agg_percentile": "SELECT tool, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY duration_ms), 3) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY duration_ms), 3) AS p95, round(percentile_cont(0.99) WITHIN GROUP (ORDER BY duration_ms), 3) AS p99 FROM {audit} GROUP BY tool",
    "agg_min_guarded": "SELECT tenant, CASE WHEN count(*) = 0 OR count(age_hours) <> count(*) THEN NULL ELSE max(age_hours) END AS oldest FROM {cursors} GROUP BY tenant",
    "agg_max_by": "SELECT id, seq, tf FROM (SELECT id, seq, tf, row_number() OVER (PARTITION BY tenant, id ORDER BY tf DESC, seq) AS rn FROM {postings} WHERE term = 'the') x WHERE rn = 1",
    "agg_family_fold": """SELECT tenant, substr(source, 1, instr(source, ':') - 1) AS family,
  min(CASE WHEN age_hours IS NULL THEN 0 WHEN consecutive_failures > 0 THEN 1 WHEN age_hours > 24 THEN 2 ELSE 3 END) AS worst,
  CASE WHEN count(age_hours) = count(*) THEN max(age_hours) END AS oldest, max(consecutive_failures) AS failures, CAST(sum(item_failures) AS BIGINT) AS item_failures
  FROM {cursors} GROUP BY tenant, substr(source, 1, instr(source, ':') - 1)""",
    "agg_mean_nan_skip": "SELECT run, round(avg(CASE WHEN relevant > 0 THEN hits * 1e0 / relevant END), 6) AS mean_recall FROM (SELECT r.run, r.query_id, count(q.doc_id) AS relevant, count(CASE WHEN r.rank <= 10 THEN q.doc_id END) AS hits FROM {ranked} r LEFT JOIN {qrels} q ON r.query_id = q.query_id AND r.doc_id = q.doc_id AND q.grade > 0 GROUP BY r.run, r.query_id) x GROUP BY run",
    "agg_rollup": "SELECT tenant, tool, CAST(count(*) AS BIGINT) AS calls FROM {audit} GROUP BY ROLLUP (tenant, tool)",
    "agg_cube": "SELECT tenant, tool, CAST(count(*) AS BIGINT) AS calls FROM {audit} GROUP BY CUBE (tenant, tool)",
    # windows, top-k, sets
    "win_quota": "SELECT id, seq, tf FROM (SELECT p.id, p.seq, p.tf, row_number() OVER (PARTITION BY d.source = 'code', p.tf > 1 ORDER BY p.tf DESC, p.id, p.seq) AS rn FROM {postings} p JOIN {docs} d ON p.tenant = d.tenant AND p.id = d.id WHERE p.term = 'the') x WHERE rn <= 24",
    "win_distinct_on": "SELECT id, seq, term FROM (SELECT id, seq, term, row_number() OVER (PARTITION BY tenant, id ORDER BY tf DESC, len, seq, term) AS rn FROM {postings}) x WHERE rn = 1",
    "win_arm_rank": "SELECT run, query_id, doc_id, rank - 1 AS rank0 FROM {ranked} WHERE rank <= 10",
    "topk_final": "SELECT id, n * 7 % 101 AS score FROM {docs} ORDER BY score DESC, id LIMIT 8",
    "topk_per_arm_limit": "SELECT * FROM (SELECT id, 'code' AS arm FROM {docs} WHERE source = 'code' ORDER BY id LIMIT 5) a UNION ALL SELECT * FROM (SELECT id, 'prose' AS arm FROM {docs} WHERE source <> 'code' ORDER BY id LIMIT 5) b",
    "topk_frequent_queries": "SELECT query, CAST(count(*) AS BIGINT) AS n FROM {audit} WHERE ok AND result_count > 0 GROUP BY query ORDER BY n DESC, query LIMIT 10",
    "page_keyset": "SELECT id, seq FROM {chunks} WHERE id > 'doc:20' ORDER BY id, seq LIMIT 2000",
    "page_bytes": "SELECT id, substr(body, 8001, 8000) AS page, CAST(greatest(1, ceil(length(body) / 8000.0)) AS BIGINT) AS pages FROM {docs} WHERE length(body) > 8000",
    "sample_prefix": "SELECT id FROM {vectors} ORDER BY n LIMIT 200",
    "set_union_all_edges": "SELECT * FROM (SELECT src_id AS id, dst_id AS other, rel, 'out' AS way FROM {links} UNION ALL SELECT dst_id, src_id, rel, 'in' FROM {links}) x WHERE id = 'doc:12'",
    "set_requested_absent": "SELECT r.family FROM (SELECT 'jira' AS family UNION ALL SELECT 'vault' UNION ALL SELECT 'logs') r WHERE NOT EXISTS (SELECT 1 FROM {cursors} c WHERE substr(c.source, 1, instr(c.source, ':') - 1) = r.family)",
    # metrics
    "vw_tool_calls": "SELECT day, tenant, principal, tool, CAST(count(*) AS BIGINT) AS calls FROM {audit} GROUP BY day, tenant, principal, tool",
    "vw_zero_results": "SELECT day, tenant, CAST(count(*) FILTER (WHERE result_count = 0) AS BIGINT) AS zero_calls, CAST(count(*) AS BIGINT) AS calls, round(count(*) FILTER (WHERE result_count = 0) * 1e0 / count(*), 3) AS zero_rate FROM {audit} WHERE tool = 'search_docs' GROUP BY day, tenant",
    "vw_two_phase": "SELECT tenant, round(count(*) FILTER (WHERE tool = 'get_doc') * 1e0 / nullif(count(*) FILTER (WHERE tool = 'search_docs'), 0), 3) AS fetch_rate FROM {audit} GROUP BY tenant",
    "vw_fetch_through": "SELECT tenant, round(count(*) FILTER (WHERE tool = 'get_doc') * 1e0 / nullif(sum(CASE WHEN tool = 'search_docs' THEN result_count END), 0), 4) AS fetch_through FROM {audit} GROUP BY tenant",
    "vw_tool_latency": "SELECT day, tool, CAST(round(percentile_cont(0.5) WITHIN GROUP (ORDER BY duration_ms)) AS BIGINT) AS p50, CAST(round(percentile_cont(0.95) WITHIN GROUP (ORDER BY duration_ms)) AS BIGINT) AS p95, CAST(round(percentile_cont(0.99) WITHIN GROUP (ORDER BY duration_ms)) AS BIGINT) AS p99 FROM {audit} GROUP BY day, tool",
    "vw_arm_mix": "SELECT route, executor, CAST(count(*) AS BIGINT) AS calls FROM {audit} GROUP BY route, executor",
    "vw_llm_calls": "SELECT day, provider, model, caller, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failures, round(avg(latency_ms), 4) AS latency FROM {spend} GROUP BY day, provider, model, caller",
    "vw_cost_per_run": "SELECT day, caller, CAST(count(*) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM {spend} GROUP BY day, caller",
    "vw_connector_health": "SELECT tenant, source, age_hours, consecutive_failures, item_failures, age_hours IS NULL AS never FROM {cursors}",
    "vw_eval_trend": "SELECT run, CAST(count(DISTINCT query_id) AS BIGINT) AS queries, CAST(max(rank) AS BIGINT) AS depth FROM {ranked} GROUP BY run",
    "vw_spend_daily": "SELECT day, tenant, provider, CAST(sum(tokens) AS BIGINT) AS quantity, CAST(sum(tokens) AS BIGINT) * 5 AS cost_units FROM {spend} GROUP BY day, tenant, provider",
    "alert_cursor_stale": "SELECT tenant, source FROM {cursors} WHERE age_hours > 24 OR age_hours IS NULL",
    "alert_zero_spike": "SELECT day, tenant FROM {audit} WHERE tool = 'search_docs' GROUP BY day, tenant HAVING count(*) >= 10 AND count(*) FILTER (WHERE result_count = 0) > 0.3 * count(*)",
    "alert_recall_drop": "SELECT run FROM (SELECT r.run, avg(CASE WHEN r.rank <= 10 THEN 1e0 ELSE 0e0 END) AS recall FROM {ranked} r JOIN {qrels} q ON r.query_id = q.query_id AND r.doc_id = q.doc_id AND q.grade > 0 GROUP BY r.run) x WHERE recall < 0.9",
    "drift": "SELECT d.id, d.content_hash <> b.digest AS drifted FROM {docs} d JOIN {blobs} b ON b.tenant = d.tenant AND b.revision = d.n + 2",
    "index_stats": "SELECT d.source, CAST(count(DISTINCT d.id) AS BIGINT) AS docs, CAST(count(c.seq) AS BIGINT) AS chunks, CAST(count(*) FILTER (WHERE length(c.text) > 1024) AS BIGINT) AS oversize FROM {docs} d LEFT JOIN {chunks} c ON d.tenant = c.tenant AND d.id = c.id GROUP BY d.source",
    "ivf_status": "SELECT CAST(count(*) AS BIGINT) AS embedded, CAST(count(cluster_id) AS BIGINT) AS clustered FROM {vectors}",
    "ivf_structural_guard": "SELECT count(*) > 0 AS probe FROM (SELECT 1 AS x FROM {vectors} WHERE cluster_id IS NOT NULL LIMIT 1) t",
    # maintenance
    "upsert_hash_gate": "SELECT n.id, CASE WHEN o.id IS NULL THEN 'insert' WHEN o.content_hash = n.content_hash AND o.acl_group = n.acl_group AND o.owner <> '' AND NOT o.tombstoned THEN 'skip' ELSE 'update' END AS action FROM {docs} n LEFT JOIN (SELECT * FROM {docs} WHERE n % 10 <> 3) o ON n.tenant = o.tenant AND n.id = o.id",
    "upsert_owner_sticky": "SELECT n.id, coalesce(nullif(o.owner, ''), nullif(n.owner, '')) AS owner FROM {docs} n JOIN {docs} o ON n.tenant = o.tenant AND n.n = o.n + 2",
    "chunk_diff": "SELECT coalesce(o.id, n.id) AS id, coalesce(o.seq, n.seq) AS seq, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'stale' WHEN o.text = n.text THEN 'keep' ELSE 'changed' END AS action FROM (SELECT * FROM {chunks} WHERE seq % 5 <> 4) o FULL JOIN (SELECT tenant, id, seq, CASE WHEN seq % 7 = 1 THEN text || '!' ELSE text END AS text FROM {chunks} WHERE seq % 6 <> 5) n ON o.tenant = n.tenant AND o.id = n.id AND o.seq = n.seq",
    "revision_log": "SELECT tenant, native_id, revision, digest, CAST(row_number() OVER (PARTITION BY tenant, native_id ORDER BY revision) AS INT) AS version FROM {blobs}",
    "replace_links": "SELECT tenant, src_id, dst_id, rel FROM {links} WHERE src_id <> 'doc:12' UNION SELECT 'default', 'doc:12', 'doc:13', 'references'",
    "cursor_advance": "SELECT tenant, coalesce(min(CASE WHEN item_failures > 3 THEN age_hours END), max(CASE WHEN item_failures <= 3 THEN age_hours END)) AS target FROM {cursors} GROUP BY tenant",
    "cursor_health": "SELECT tenant, source, CASE WHEN item_failures = 0 THEN 0 ELSE consecutive_failures + 1 END AS consecutive_failures FROM {cursors}",
    "reconcile_refused": "SELECT d.id FROM {docs} d CROSS JOIN (SELECT count(*) AS live, count(*) FILTER (WHERE n % 9 = 2) AS listed FROM {docs} WHERE source = 'confluence' AND NOT tombstoned) s WHERE d.source = 'confluence' AND NOT d.tombstoned AND d.n % 9 <> 2 AND s.listed >= s.live * 0.5",
    "quarantine_clear": "SELECT id, quarantined AND n % 38 <> 0 AS quarantined FROM {docs} WHERE quarantined",
    "purge_expired": """SELECT 'documents' AS what, CAST(count(*) AS BIGINT) AS n FROM {docs} WHERE tombstoned AND age_days > 7
  UNION ALL SELECT 'versions', count(*) FROM {blobs} WHERE expired
  UNION ALL SELECT 'blobs', count(*) FROM (SELECT tenant, digest FROM {blobs} GROUP BY tenant, digest HAVING count(*) FILTER (WHERE NOT expired) = 0) x""",
    "prune_facts": "SELECT a.id FROM {audit} a JOIN (SELECT max(day) AS last FROM {audit}) m ON true WHERE a.day >= m.last - INTERVAL '7' DAY",
    "artifact_put": "SELECT tenant, digest, CAST(min(size) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS versions FROM {blobs} GROUP BY tenant, digest",
    "artifact_get": "SELECT tenant, native_id, digest FROM (SELECT *, row_number() OVER (PARTITION BY tenant, source, native_id ORDER BY revision DESC) AS rn FROM {blobs} WHERE NOT expired) x WHERE rn = 1",
    "artifact_retire": "SELECT tenant, source, native_id, revision FROM {blobs} WHERE revision % 15 = 0 AND NOT expired",
    "artifact_gc": "SELECT tenant, digest FROM {blobs} GROUP BY tenant, digest HAVING count(*) FILTER (WHERE NOT expired) = 0",
    "ivf_supersede": "SELECT run, run < max(run) OVER () AS superseded FROM (SELECT DISTINCT run FROM {ranked}) x",
    "claim_step": """SELECT id, CASE WHEN result_count = 4 AND duration_ms > 500 THEN 'dead_letter' WHEN result_count < 3 OR duration_ms > 500 THEN 'claimed' ELSE 'pending' END AS status,
  CASE WHEN result_count < 3 OR (duration_ms > 500 AND result_count < 4) THEN result_count + 1 ELSE result_count END AS attempts FROM {audit}""",
    # answers
    "withhold_unverified": "SELECT d.id, CAST(count(*) FILTER (WHERE instr(d.body, CASE WHEN c.seq % 7 = 3 THEN c.text || ' (not in the text)' ELSE c.text END) > 0) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE NOT instr(d.body, CASE WHEN c.seq % 7 = 3 THEN c.text || ' (not in the text)' ELSE c.text END) > 0) AS BIGINT) AS withheld FROM {chunks} c JOIN {docs} d ON c.tenant = d.tenant AND c.id = d.id GROUP BY d.id",
    "evidence_bounds": "SELECT source, CASE WHEN count(age_days) = count(*) THEN max(age_days) END AS oldest, min(age_days) AS newest FROM {docs} GROUP BY source",
    "corpus_current_to": "SELECT tenant, CASE WHEN count(*) > 0 AND count(age_hours) = count(*) THEN max(age_hours) END AS hours FROM {cursors} GROUP BY tenant",
    "get_doc": f"SELECT d.id, d.title, substr(d.body, 1, 8000) AS page, CAST(greatest(1, ceil(length(d.body) / 8000.0)) AS BIGINT) AS pages FROM {{docs}} d WHERE d.id = 'doc:12' AND {VISIBLE} AND NOT d.superseded",
    "get_doc_superseded": f"SELECT d.id FROM {{docs}} d WHERE {VISIBLE} AND d.superseded",
    "expand": f"""SELECT way, other, rel, title FROM (SELECT x.*, row_number() OVER (PARTITION BY way ORDER BY rel, other) AS rn FROM (
  SELECT 'out' AS way, l.dst_id AS other, l.rel, d.title FROM {{links}} l LEFT JOIN {{docs}} d ON l.tenant = d.tenant AND l.dst_id = d.id WHERE l.tenant = 'default' AND l.src_id = 'doc:12' AND (d.id IS NULL OR ({VISIBLE}))
  UNION ALL SELECT 'in', l.src_id, l.rel, d.title FROM {{links}} l LEFT JOIN {{docs}} d ON l.tenant = d.tenant AND l.src_id = d.id WHERE l.tenant = 'default' AND l.dst_id = 'doc:12' AND (d.id IS NULL OR ({VISIBLE}))) x) y WHERE rn <= 50""",
    "entity_route": f"SELECT d.id, d.title, CAST(count(l.dst_id) AS BIGINT) AS neighbours FROM {{docs}} d LEFT JOIN {{links}} l ON l.tenant = d.tenant AND l.src_id = d.id WHERE d.source = 'jira' AND {VISIBLE} GROUP BY d.id, d.title",
    "context_cost": "SELECT d.id, CAST(length(d.body) AS BIGINT) AS pass_through, CAST(least(540, length(d.body)) AS BIGINT) AS two_phase, round(length(d.body) * 1e0 / greatest(1, least(540, length(d.body))), 3) AS ratio FROM {docs} d",
    "src_elk_logs": "SELECT a.id, a.query, a.ts FROM {audit} a JOIN (SELECT max(ts) AS last FROM {audit}) m ON true WHERE a.ts >= m.last - INTERVAL '60' MINUTE AND NOT a.ok ORDER BY a.ts DESC, a.id LIMIT 50",
    "coverage": """SELECT family, CASE min(state) WHEN 0 THEN 'never_synced' WHEN 1 THEN 'failing' WHEN 2 THEN 'stale' ELSE 'current' END AS state, CAST(sum(item_failures) AS BIGINT) AS item_failures, min(state) = 3 AND sum(item_failures) = 0 AS complete
  FROM (SELECT substr(source, 1, instr(source, ':') - 1) AS family, item_failures, CASE WHEN age_hours IS NULL THEN 0 WHEN consecutive_failures > 0 THEN 1 WHEN age_hours > 24 THEN 2 ELSE 3 END AS state FROM {cursors}) x GROUP BY family""",
    "win_dense_history": "SELECT id, principal, duration_ms, duration_ms - lag(duration_ms) OVER (PARTITION BY tenant, principal ORDER BY ts, id) AS change FROM {audit}",
    # evaluation
    "ir_recall": "SELECT j.run, j.query_id, round(j.hits * 1e0 / r.relevant, 6) AS recall FROM (SELECT r.run, r.query_id, count(q.doc_id) AS hits FROM {ranked} r LEFT JOIN {qrels} q ON r.query_id = q.query_id AND r.doc_id = q.doc_id AND q.grade > 0 WHERE r.rank <= 10 GROUP BY r.run, r.query_id) j JOIN (SELECT query_id, count(*) AS relevant FROM {qrels} WHERE grade > 0 GROUP BY query_id) r ON j.query_id = r.query_id",
    "ir_precision": "SELECT r.run, r.query_id, round(count(q.doc_id) * 1e0 / count(*), 6) AS prec FROM {ranked} r LEFT JOIN {qrels} q ON r.query_id = q.query_id AND r.doc_id = q.doc_id AND q.grade > 0 WHERE r.rank <= 10 GROUP BY r.run, r.query_id",
    "ir_ndcg": """WITH gains AS (SELECT r.run, r.query_id, sum(q.grade / log2(r.rank + 1)) AS dcg FROM {ranked} r JOIN {qrels} q ON r.query_id = q.query_id AND r.doc_id = q.doc_id WHERE r.rank <= 10 GROUP BY r.run, r.query_id),
  ideal AS (SELECT query_id, sum(grade / log2(rn + 1)) AS idcg FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS rn FROM {qrels}) x WHERE rn <= 10 GROUP BY query_id)
  SELECT g.run, g.query_id, round(g.dcg, 6) AS dcg, round(g.dcg / nullif(i.idcg, 0), 6) AS ndcg FROM gains g JOIN ideal i ON g.query_id = i.query_id""",
    "ir_mrr": "SELECT r.run, r.query_id, round(1e0 / min(r.rank), 6) AS mrr FROM {ranked} r JOIN {qrels} q ON r.query_id = q.query_id AND r.doc_id = q.doc_id AND q.grade > 0 GROUP BY r.run, r.query_id",
    "ir_judged": "SELECT r.run, round(count(q.doc_id) * 1e0 / count(*), 6) AS judged FROM {ranked} r LEFT JOIN {qrels} q ON r.query_id = q.query_id AND r.doc_id = q.doc_id WHERE r.rank <= 10 GROUP BY r.run",
    "ir_rbo": """SELECT d.query_id, round(sum(CASE WHEN x.both IS NULL THEN 0e0 ELSE x.both * 1e0 / d.depth END * power(0.9, d.depth - 1)) * 0.1 / (1 - power(0.9, 10)), 6) AS rbo
  FROM (SELECT DISTINCT query_id, rank AS depth FROM {ranked} WHERE rank <= 10) d
  LEFT JOIN (SELECT d2.query_id, d2.depth, count(*) AS both FROM (SELECT DISTINCT query_id, rank AS depth FROM {ranked} WHERE rank <= 10) d2
    JOIN (SELECT a.query_id, greatest(a.rank, b.rank) AS seen FROM {ranked} a JOIN {ranked} b ON a.query_id = b.query_id AND a.doc_id = b.doc_id WHERE a.run = 1 AND b.run = 2 AND a.rank <= 10 AND b.rank <= 10) m
    ON m.query_id = d2.query_id AND m.seen <= d2.depth GROUP BY d2.query_id, d2.depth) x ON d.query_id = x.query_id AND d.depth = x.depth GROUP BY d.query_id""",
    "mine_queries": "SELECT query, CAST(count(*) AS BIGINT) AS n FROM {audit} a WHERE ok AND result_count > 0 AND NOT EXISTS (SELECT 1 FROM {qrels} q WHERE 'query ' || substr(q.query_id, 2) = a.query) GROUP BY query ORDER BY n DESC, query LIMIT 20",
    "compare_runs": "SELECT query_id, a.mrr AS a, b.mrr AS b FROM (SELECT r.query_id, round(1e0 / min(r.rank), 6) AS mrr FROM {ranked} r JOIN {qrels} q ON r.query_id = q.query_id AND r.doc_id = q.doc_id AND q.grade > 0 WHERE r.run = 1 GROUP BY r.query_id) a JOIN (SELECT r.query_id, round(1e0 / min(r.rank), 6) AS mrr FROM {ranked} r JOIN {qrels} q ON r.query_id = q.query_id AND r.doc_id = q.doc_id AND q.grade > 0 WHERE r.run = 2 GROUP BY r.query_id) b USING (query_id)",
    "build_pool": "SELECT DISTINCT r.query_id, r.doc_id FROM {ranked} r LEFT JOIN {qrels} q ON r.query_id = q.query_id AND r.doc_id = q.doc_id WHERE q.doc_id IS NULL AND r.rank <= 10",
}


def names_in(sql: str) -> list[str]:
    return [v for v in VIEWS if "{" + v + "}" in sql]


def query(sql: str):
    def run(spark, sf_dir):
        return spark.sql(sql, **{v: view(spark, sf_dir, v) for v in names_in(sql)})

    return run


def oracle(sql: str) -> str:
    used = names_in(sql)
    body = re.sub(r"\{(\w+)\}", r"\1", sql).strip()
    if not used:
        return body
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + prelude(used) + ", " + body[len("WITH RECURSIVE ") :]
    return "WITH " + prelude(used) + (", " + body[5:] if body.startswith("WITH ") else "\n" + body)
