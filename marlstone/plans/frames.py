"""Plans in the DataFrame API, each with its oracle where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import ranking, text, vector
from marlstone.operators import ivf
from marlstone.operators import search as S
from marlstone.plans.portable import VISIBLE, oracle
from marlstone.sources.catalog import view
from marlstone.sources.postings import lexical
from marlstone.streaming import events as stream

Q: dict = {}
O: dict = {}  # noqa: E741


def plan(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = oracle(sql)
        return f

    return add


TERMS = "(SELECT 'q1' AS query_id, 'the' AS term, 3 AS n_terms UNION ALL SELECT 'q1', 'and', 3 UNION ALL SELECT 'q1', 'retry', 3 UNION ALL SELECT 'q2', 'der', 2 UNION ALL SELECT 'q2', 'die', 2 UNION ALL SELECT 'q3', 'nosuchterm', 2 UNION ALL SELECT 'q3', 'of', 2)"
MODIFIER = "(CASE quality_tier WHEN 'curated' THEN 1.15e0 WHEN 'generated' THEN 0.9e0 WHEN 'raw' THEN 0.8e0 ELSE 1e0 END * coalesce(0.6e0 + 0.4e0 * power(2e0, -age_days / CASE WHEN quality_tier = 'curated' THEN 365e0 ELSE 180e0 END), 0.6e0))"
MATCH = f"SELECT t.query_id, p.tenant, p.id, p.seq, sum(p.tf) / (1 + ln(min(p.len))) AS rank, count(*) = t.n_terms AS strict FROM {{postings}} p JOIN {TERMS} t ON p.term = t.term"

SEARCH = f"""WITH v AS (SELECT * FROM {{docs}} d WHERE {VISIBLE} AND NOT d.superseded), m AS ({MATCH} JOIN v ON v.tenant = p.tenant AND v.id = p.id GROUP BY t.query_id, p.tenant, p.id, p.seq, t.n_terms),
b AS (SELECT m.*, v.source = 'code' AS code, row_number() OVER (PARTITION BY query_id, m.id ORDER BY strict DESC, rank DESC, seq) AS b FROM m JOIN v ON m.id = v.id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, code, strict ORDER BY rank DESC, id) AS k FROM b WHERE b = 1),
a AS (SELECT query_id, id, rank, CASE WHEN code THEN 'fts_code_loose' ELSE 'fts_prose_loose' END AS arm FROM k WHERE k <= 24 UNION ALL SELECT query_id, id, rank, CASE WHEN code THEN 'fts_code' ELSE 'fts_prose' END FROM k WHERE k <= 24 AND strict),
r AS (SELECT query_id, id, CASE WHEN arm LIKE 'fts_code%' THEN 0.6e0 ELSE 1e0 END / (60 + row_number() OVER (PARTITION BY query_id, arm ORDER BY rank DESC, id)) AS w FROM a),
f AS (SELECT query_id, id, sum(w) AS fused FROM r GROUP BY query_id, id),
s AS (SELECT query_id, f.id, round(fused * {MODIFIER}, 6) AS score FROM f JOIN v ON f.id = v.id)
SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS position FROM s) WHERE position <= 8"""
plan("search_docs", SEARCH)(S.search_docs)
VEC = """n AS (SELECT query_id, id, 1e0 / (60 + rn) AS w FROM (SELECT q.query_id, x.id, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_dot_product(x.vec::DOUBLE[], q.vec::DOUBLE[]), 6) DESC, x.id) AS rn
FROM {vectors} x JOIN v ON x.id = v.id CROSS JOIN (SELECT 'q' || CAST(n + 1 AS VARCHAR) AS query_id, vec FROM {vectors} WHERE n < 3) q) WHERE rn <= 24),
f AS (SELECT query_id, id, sum(w) AS fused FROM (SELECT * FROM r UNION ALL SELECT * FROM n) GROUP BY query_id, id),"""
plan("search_hybrid", SEARCH.replace("f AS (SELECT query_id, id, sum(w) AS fused FROM r GROUP BY query_id, id),", VEC))(S.search_hybrid)

plan("lex_strict", f"SELECT query_id, id, seq FROM ({MATCH} GROUP BY t.query_id, p.tenant, p.id, p.seq, t.n_terms) WHERE strict")(
    lambda s, d: S.matches(S.sampled(s, d).of(S.query_terms(s))).where("strict").select("query_id", "id", "seq"))
plan("lex_rank", f"SELECT query_id, id, seq, round(rank, 6) AS rank FROM ({MATCH} GROUP BY t.query_id, p.tenant, p.id, p.seq, t.n_terms)")(
    lambda s, d: S.matches(S.sampled(s, d).of(S.query_terms(s))).select("query_id", "id", "seq", F.round("rank", 6).alias("rank")))
plan("lex_loose", f"SELECT DISTINCT t.query_id, p.id, p.seq FROM {{postings}} p JOIN {TERMS} t ON p.term = t.term")(
    lambda s, d: S.matches(S.sampled(s, d).of(S.query_terms(s))).select("query_id", "id", "seq"))
plan("lex_index", "SELECT id, seq, term, tf FROM {postings}")(lambda s, d: lexical(s, d).postings.select("id", "seq", "term", "tf"))
plan("lex_negation", "SELECT id, seq FROM {postings} p WHERE term = 'the' AND NOT EXISTS (SELECT 1 FROM {postings} x WHERE x.id = p.id AND x.seq = p.seq AND x.term = 'and')")(S.negation)
plan("bm25_score", f"""WITH t AS (SELECT * FROM {TERMS}), c AS (SELECT count(*) AS n, avg(len) AS avgdl FROM {{chunks}}), p AS (SELECT t.query_id, p.* FROM {{postings}} p JOIN t ON p.term = t.term), f AS (SELECT query_id, term, count(*) AS df FROM p GROUP BY query_id, term)
SELECT p.query_id, p.id, p.seq, round(sum(ln(1 + (c.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.len / c.avgdl))), 5) AS score FROM p JOIN f ON p.query_id = f.query_id AND p.term = f.term CROSS JOIN c GROUP BY p.query_id, p.id, p.seq""")(
    lambda s, d: S.bm25(S.sampled(s, d, counted=True), S.query_terms(s)).select("query_id", "id", "seq", F.round("score", 5).alias("score")))
plan("df_prune", f"""WITH t AS (SELECT * FROM {TERMS}), n AS (SELECT count(*) AS n FROM {{chunks}}), f AS (SELECT t.query_id, t.term, count(p.term) AS df FROM t LEFT JOIN {{postings}} p ON p.term = t.term GROUP BY t.query_id, t.term),
r AS (SELECT f.*, f.df < 0.15 * n.n AS rare, bool_or(f.df < 0.15 * n.n) OVER (PARTITION BY query_id) AS any_rare, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS rn FROM f CROSS JOIN n)
SELECT query_id, term, df FROM r WHERE CASE WHEN any_rare THEN rare ELSE rn <= 3 END""")(lambda s, d: S.df_prune(S.sampled(s, d, counted=True), S.query_terms(s)))

plan("rank_modifier", f"SELECT id, round({MODIFIER}, 8) AS modifier FROM {{docs}}")(lambda s, d: view(s, d, "docs").select("id", F.round(ranking.modifier(F.col("quality_tier"), F.col("age_days")), 8).alias("modifier")))
plan("rrf_fuse", "SELECT query_id, doc_id, round(sum(CASE run WHEN 1 THEN 1e0 ELSE 0.6e0 END / (60 + rank)), 8) AS score FROM {ranked} WHERE rank <= 20 GROUP BY query_id, doc_id")(
    lambda s, d: view(s, d, "ranked").where("rank <= 20").groupBy("query_id", "doc_id").agg(F.round(F.sum(ranking.rrf(F.when(F.col("run") == 1, 1.0).otherwise(0.6), F.col("rank") - 1)), 8).alias("score")))
plan("agg_sum_weighted", "SELECT query_id, doc_id, round(sum(1e0 / (60 + rank)), 8) AS score FROM {ranked} GROUP BY query_id, doc_id")(
    lambda s, d: view(s, d, "ranked").groupBy("query_id", "doc_id").agg(F.round(F.sum(ranking.rrf(F.lit(1.0), F.col("rank") - 1)), 8).alias("score")))
plan("set_arm_union", "SELECT query_id, doc_id, CASE run WHEN 1 THEN 'fts_prose' ELSE 'vec' END AS arm FROM {ranked} WHERE rank <= 5")(
    lambda s, d: view(s, d, "ranked").where("run = 1 AND rank <= 5").select("query_id", "doc_id", F.lit("fts_prose").alias("arm")).unionByName(view(s, d, "ranked").where("run = 2 AND rank <= 5").select("query_id", "doc_id", F.lit("vec").alias("arm"))))
plan("arm_weights", "SELECT route, executor, CASE WHEN executor LIKE 'fts_code%' THEN CASE WHEN route = 'symbol' THEN 1e0 ELSE 0.6e0 END WHEN executor LIKE 'fts_prose%' THEN CASE WHEN route = 'symbol' THEN 0.6e0 ELSE 1e0 END ELSE 1e0 END AS weight FROM (SELECT DISTINCT route, executor FROM {audit})")(
    lambda s, d: view(s, d, "audit").select("route", "executor").distinct().withColumn("weight", ranking.arm_weight(F.col("executor"), F.col("route"))))
plan("confidence", "SELECT query_id, max(score) AS top_score, max(score) - min(score) AS score_gap, CAST(count(*) FILTER (WHERE score >= 0.95 * top) AS BIGINT) AS near_top FROM (SELECT query_id, 1000 - rank * rank AS score, max(1000 - rank * rank) OVER (PARTITION BY query_id) AS top FROM {ranked} WHERE run = 1 AND rank <= 5) GROUP BY query_id")(
    lambda s, d: view(s, d, "ranked").where("run = 1 AND rank <= 5").withColumn("score", 1000 - F.col("rank") * F.col("rank")).groupBy("query_id").agg(F.max("score").alias("top_score"), (F.max("score") - F.min("score")).alias("score_gap"), F.collect_list("score").alias("l")).select("query_id", "top_score", "score_gap", F.size(F.filter("l", lambda x: x >= 0.95 * F.col("top_score"))).cast("long").alias("near_top")))

plan("vec_norm", "SELECT id, round(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])), 6) AS norm FROM {vectors}")(lambda s, d: view(s, d, "vectors").select("id", F.round(vector.norm(F.col("vec")), 6).alias("norm")))
PAIRS = "(SELECT q.id AS query_id, v.id, q.vec AS qv, v.vec, list_dot_product(q.vec::DOUBLE[], v.vec::DOUBLE[]) AS s, list_sum(list_transform(list_zip(q.vec, v.vec), lambda x: CASE WHEN (x[1] >= 0) <> (x[2] >= 0) THEN 1 ELSE 0 END)) AS h FROM {vectors} q CROSS JOIN {vectors} v WHERE q.n % 20 = 0)"
plan("vec_cosine", f"SELECT query_id, id, round(s / sqrt(list_dot_product(qv::DOUBLE[], qv::DOUBLE[]) * list_dot_product(vec::DOUBLE[], vec::DOUBLE[])), 5) AS cosine FROM {PAIRS}")(
    lambda s, d: ivf.measured(s, d).select("query_id", "id", F.round("cosine", 5).alias("cosine")))
plan("vec_exact_topk", f"SELECT query_id, id, score FROM (SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rn FROM {PAIRS}) WHERE rn <= 10")(lambda s, d: ivf.scan(s, d, 10).drop("distance"))
plan("topk_vec_docs", f"SELECT query_id, id, score FROM (SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rn FROM {PAIRS}) WHERE rn <= 24")(lambda s, d: ivf.scan(s, d, 24).drop("distance"))
plan("topk_hamming", f"SELECT query_id, id, distance FROM (SELECT query_id, id, CAST(h AS INT) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY h, id) AS rn FROM {PAIRS}) WHERE rn <= 40")(lambda s, d: ivf.scan(s, d, 40, by_signature=True).drop("score"))
plan("vec_hamming", f"SELECT query_id, id, CAST(h AS INT) AS distance FROM {PAIRS}")(
    lambda s, d: ivf.measured(s, d).select("query_id", "id", "distance"))
plan("vec_signature", "SELECT id, array_to_string(list_transform(vec, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS bits FROM {vectors}")(S.signatures)
plan("vec_funnel")(ivf.funnel)
CENTROIDS = "(SELECT cluster_id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY cluster_id)) AS x FROM (SELECT cluster_id, pos, avg(x::DOUBLE) AS x FROM (SELECT cluster_id, unnest(range(0, len(vec))) AS pos, unnest(vec) AS x FROM {vectors}) GROUP BY cluster_id, pos))"
plan("agg_centroid", f"SELECT cluster_id, CAST(pos AS INT) AS pos, round(x, 6) AS x FROM {CENTROIDS}")(
    lambda s, d: S.centroids(view(s, d, "vectors")).select("cluster_id", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 6)))
plan("ivf_assign_given", f"SELECT id, label FROM (SELECT v.id, c.cluster_id AS label, row_number() OVER (PARTITION BY v.id ORDER BY list_dot_product(v.vec::DOUBLE[], c.vec) DESC, c.cluster_id) AS rn FROM {{vectors}} v CROSS JOIN (SELECT cluster_id, list(x ORDER BY pos) AS vec FROM {CENTROIDS} GROUP BY cluster_id) c) WHERE rn = 1")(ivf.assign_given)
plan("ivf_kmeans")(ivf.kmeans)
plan("ivf_assign")(ivf.assign)
plan("ivf_calibrate")(ivf.calibrate)
plan("near_dup", "SELECT a.id, b.id AS other FROM {vectors} a JOIN {vectors} b ON a.id < b.id WHERE list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[]) > 0.95")(ivf.near_dup)
plan("near_dup_planted", "SELECT a.id, b.id AS other FROM w a JOIN w b ON a.id < b.id WHERE list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[]) > 0.95".join(["WITH w AS (SELECT id, vec FROM {vectors} UNION ALL SELECT id || ':copy', list_transform(vec, lambda x: CAST(x + 0.001 AS FLOAT)) FROM {vectors} WHERE n % 10 = 0) ", ""]))(lambda s, d: ivf.near_dup(s, d, planted=True))

plan("classify_route", "SELECT id, CASE n % 6 WHEN 0 THEN 'entity' WHEN 1 THEN 'path' WHEN 2 THEN 'exact' WHEN 3 THEN 'exact' WHEN 4 THEN 'symbol' ELSE 'docs' END AS route FROM {notes}")(
    lambda s, d: view(s, d, "notes").select("id", text.classify_route(F.col("query")).alias("route")))
plan("extract_ticket_keys", "SELECT id, 'PAY-1,ABC-2,OPS-' || CAST(n AS VARCHAR) AS keys FROM {notes}")(lambda s, d: view(s, d, "notes").select("id", F.array_join(text.ticket_keys(F.col("text")), ",").alias("keys")))
plan("extract_url_links", "SELECT id, 'confluence:page:' || CAST(n AS VARCHAR) || ',jira:issue:OPS-' || CAST(n AS VARCHAR) AS links FROM {notes}")(
    lambda s, d: view(s, d, "notes").select("id", F.array_join(text.url_links(F.col("text")), ",").alias("links")))
plan("extract_links", "SELECT id, 'jira:issue:PAY-1,jira:issue:ABC-2,jira:issue:OPS-' || CAST(n AS VARCHAR) || ',confluence:page:' || CAST(n AS VARCHAR) || ',Other Note' AS links FROM {notes}")(
    lambda s, d: view(s, d, "notes").select("id", F.array_join(text.links(F.col("text"), F.col("id")), ",").alias("links")))
plan("scrub_secrets", "SELECT id, regexp_replace(regexp_replace(url, '://[^\\s/@]+(:[^\\s/@]*)?@', '://***@', 'g'), '([?&]token=)[^&\\s]*', '\\1***', 'g') AS url FROM {docs}")(
    lambda s, d: view(s, d, "docs").select("id", text.redact(F.col("url")).alias("url")))
plan("secret_scan", "SELECT id, 'aws-key-id,url-credentials' AS rules FROM {notes}")(lambda s, d: view(s, d, "notes").select("id", F.array_join(text.secrets(F.col("text")), ",").alias("rules")))
plan("subtokens", "SELECT id, 'parse,http,response' || CAST(n AS VARCHAR) || ',response,' || CASE WHEN n > 9 THEN CAST(n AS VARCHAR) || ',' ELSE '' END || 'oauth2,oauth,client,sha256,sha,' || CASE WHEN n = 256 THEN '' ELSE '256,' END || 'hash,snake,case,name' AS tokens FROM {notes}")(
    lambda s, d: view(s, d, "notes").select("id", F.array_join(text.subtokens(F.col("code")), ",").alias("tokens")))
SNIPPET = "CASE WHEN length(body) <= 540 THEN body WHEN regexp_matches(substr(body, 1, 540), '\\S\\s') THEN regexp_replace(regexp_replace(substr(body, 1, 540), '\\S*\\z', ''), '\\s+\\z', '') ELSE substr(body, 1, 540) END"
plan("slice_snippet", f"SELECT id, {SNIPPET} AS snippet FROM {{docs}}")(
    lambda s, d: view(s, d, "docs").select("id", text.slice_snippet(F.col("body")).alias("snippet")))
plan("chunk_paragraph", "SELECT id, seq, text FROM {chunks}")(lambda s, d: view(s, d, "chunks").select("id", "seq", "text"))
plan("chunk_code", "SELECT id, a, least(a + 59, n) AS b, sha256(array_to_string(parts[a : least(a + 59, n)], chr(10))) AS digest FROM (SELECT id, parts, CAST(len(parts) AS INT) AS n, CAST(unnest(range(1, greatest(len(parts) - 10, 1) + 1, 50)) AS INT) AS a FROM (SELECT id, string_split(body, chr(10)) AS parts FROM {docs}))")(
    lambda s, d: view(s, d, "docs").select("id", F.explode(text.code_chunks(F.col("body"))).alias("c")).select("id", "c.a", "c.b", F.sha2("c.text", 256).alias("digest")))
plan("embed_windows", """SELECT id, CAST(len(range(0, greatest(length(body) - (budget - step) - 1, 0) + 1, step)) AS INT) AS windows FROM
(SELECT *, greatest(1, CAST(floor(budget * 0.75) AS INT)) AS step FROM (SELECT id, body, 1024 - length(substr(title || chr(10) || chr(10), 1, 512)) AS budget FROM {docs}))""")(
    lambda s, d: view(s, d, "docs").select("id", F.size(text.windows(F.col("body"), F.col("title"))).alias("windows")))
plan("lexicon", """SELECT id, CASE n % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS hedged, n % 4 = 2 AS defers, n % 3 < 2 AS observable FROM {notes}""")(lambda s, d: S.lexicons(view(s, d, "notes")))
plan("set_dedupe_first", "SELECT id, array_to_string(list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda x: list_position(t, x[1]) = x[2]), lambda x: x[1]), ' ') AS terms FROM (SELECT id, regexp_extract_all(lower(title), '[a-z0-9]+') AS t FROM {docs})")(
    lambda s, d: view(s, d, "docs").select("id", F.array_join(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), F.lit(0))), " ").alias("terms")))
plan("zip_unnest", "SELECT id, round(list_dot_product(vec::DOUBLE[], vec::DOUBLE[]), 6) AS score FROM {vectors}")(lambda s, d: view(s, d, "vectors").select("id", F.round(vector.dot(F.col("vec"), F.col("vec")), 6).alias("score")))
plan("agg_string_ordered", "SELECT src_id, string_agg(dst_id, ',' ORDER BY dst_id, rel) AS dsts FROM {links} WHERE tenant = 'default' GROUP BY src_id")(
    lambda s, d: view(s, d, "links").where("tenant = 'default'").groupBy("src_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst_id", "rel"))), lambda x: x["dst_id"]), ",").alias("dsts")))


plan("refresh_stats", "SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {postings} GROUP BY term")(S.term_stats)
plan("sample_stride", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM {docs}) x WHERE rn % 25 = 0")(lambda s, d: S.stride(view(s, d, "docs").select("id"), "id", 25))


@plan("win_budget", """WITH RECURSIVE c AS (SELECT k.id, row_number() OVER (PARTITION BY k.id ORDER BY k.seq) AS i, length(k.text) AS n FROM {chunks} k JOIN {docs} d ON k.id = d.id WHERE d.source = 'code'),
w AS (SELECT id, i, CAST(CASE WHEN n <= 16000 THEN 1 ELSE 0 END AS INT) AS kept, CAST(CASE WHEN n <= 16000 THEN n ELSE 0 END AS INT) AS chars FROM c WHERE i = 1
UNION ALL SELECT c.id, c.i, CAST(w.kept + CASE WHEN w.chars + c.n <= 16000 THEN 1 ELSE 0 END AS INT), CAST(w.chars + CASE WHEN w.chars + c.n <= 16000 THEN c.n ELSE 0 END AS INT) FROM w JOIN c ON c.id = w.id AND c.i = w.i + 1)
SELECT id, arg_max(kept, i) AS kept, arg_max(chars, i) AS chars FROM w GROUP BY id""")
def win_budget(s, d, most: int = 16_000):
    """Citations in order; one that would pass the budget is skipped and later, smaller ones may still fit."""
    c = view(s, d, "chunks").join(view(s, d, "docs").where("source = 'code'").select("tenant", "id"), ["tenant", "id"], "left_semi")
    g = c.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", F.char_length("text").alias("n")))).alias("l"))
    kept = F.aggregate("l", F.struct(F.lit(0).alias("n"), F.lit(0).alias("kept")), lambda a, x: F.when(a["n"] + x["n"] <= most, F.struct((a["n"] + x["n"]).alias("n"), (a["kept"] + 1).alias("kept"))).otherwise(a))
    return g.select("id", kept["kept"].alias("kept"), kept["n"].alias("chars"))


plan("sample_random")(lambda s, d: view(s, d, "docs").select("id").orderBy(F.rand(42)).limit(20))
plan("stream_tumbling", "SELECT date_trunc('hour', ts) AS start, CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (WHERE result_count = 0) AS BIGINT) AS zero_calls FROM {audit} GROUP BY 1")(stream.tumbling)
plan("stream_sliding", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS start, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k + INTERVAL 1 HOUR AS \"end\", CAST(count(*) AS BIGINT) AS calls, round(sum(value), 4) AS total FROM (SELECT CAST(ts AS TIMESTAMP) AS ts, value FROM events) e, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")(lambda s, d: stream.windows(s, d, "sliding"))
plan("stream_sessions", "WITH g AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS \"end\", CAST(count(*) AS BIGINT) AS calls, round(sum(value), 4) AS total FROM k GROUP BY user_id, k")(lambda s, d: stream.windows(s, d, "sessions"))
plan("stream_upsert")(stream.upsert)
O["stream_upsert"] = "SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS id, 1 AS revision FROM documents"
