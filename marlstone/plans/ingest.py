"""Plans of ingestion, code search, embedding and evaluation; oracles say in closed form what the generated inputs must give."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import htmlmd, markdown, notes, paths, text
from marlstone.operators import code, embed, maintain
from marlstone.plans.portable import oracle
from marlstone.sources import rules
from marlstone.sources.catalog import view

Q: dict = {}
O: dict = {}  # noqa: E741


def plan(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = oracle(sql)
        return f

    return add


def n_text(*parts):
    """Text with the row's number in place of None."""
    return F.concat(*[F.col("n").cast("string") if p is None else F.lit(p) for p in parts])


# sources
@plan("glob_filter", "SELECT id FROM {files} WHERE n % 3 = 1 AND CAST(n AS VARCHAR) LIKE '%1' AND length(CAST(n AS VARCHAR)) = 2")
def glob_filter(s, d):
    return view(s, d, "files").where(rules.wanted(F.concat_ws("/", "repo", "path"), ["r1/**/f??.ts"], ["**/f?[!1].ts", *[f"**/f?{k}.ts" for k in "023456789"]]) & rules.is_text(F.col("body"))).select("id")


@plan("canonical_path", "SELECT id, CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'docs/n' || CAST(n AS VARCHAR) || '.md' END AS path, CASE n % 5 WHEN 0 THEN 'absolute' WHEN 1 THEN 'escapes-root' END AS reason FROM {notes}")
def canonical_path(s, d):
    raw = F.when(F.col("n") % 5 == 0, n_text("/n", None)).when(F.col("n") % 5 == 1, n_text("a/../../n", None)).when(F.col("n") % 5 == 2, n_text("docs\\n", None, ".md")).otherwise(n_text("./docs//x/../n", None, ".md"))
    return view(s, d, "notes").select("id", paths.canonical(raw).alias("c")).select("id", "c.path", "c.reason")


@plan("resolve_links", "SELECT a.id, CASE WHEN a.n % 2 = 0 THEN 'vault/a b' ELSE 'vault/n' END || CAST(a.n + 1 AS VARCHAR) || '.md' AS target, b.id AS found FROM {notes} a LEFT JOIN {notes} b ON b.n = a.n + 1 AND a.n % 2 = 1")
def resolve_links(s, d):
    """Links of a note to its neighbour, half of them to a name that no note has."""
    v = view(s, d, "notes")
    target = F.when(F.col("n") % 2 == 0, F.concat(F.lit("../a%20b"), (F.col("n") + 1).cast("string"), F.lit(".md#x"))).otherwise(F.concat(F.lit("../n"), (F.col("n") + 1).cast("string"), F.lit(".md")))
    links = v.select("id", paths.link_target(F.lit("vault/sub"), target)["path"].alias("target"))
    known = v.select(n_text("vault/n", None, ".md").alias("target"), F.col("id").alias("found"))
    unique = known.groupBy("target").agg(F.min("found").alias("found"), F.count(F.lit(1)).alias("k")).where("k = 1").drop("k")  # a name that two notes have resolves to neither
    return links.join(unique, "target", "left").select("id", "target", "found")


@plan("frontmatter", "SELECT id, 'n-' || CAST(n AS VARCHAR) AS note_id, 'a,b' || CAST(n AS VARCHAR) AS tags, 'x' AS aliases, 'Body ' || CAST(n AS VARCHAR) AS body FROM {notes}")
def frontmatter(s, d):
    raw = n_text("---\nid: n-", None, "\ntags: [a, 'b", None, "']\naliases:\n  - x\nother: y\n---\nBody ", None)
    m = view(s, d, "notes").select("id", notes.front_matter(raw).alias("m"))
    return m.select("id", F.col("m.id").alias("note_id"), F.array_join("m.tags", ",").alias("tags"), F.array_join("m.aliases", ",").alias("aliases"), "m.body")


@plan("html_to_markdown", "SELECT id, '# T ' || CAST(n AS VARCHAR) || chr(10) || chr(10) || 'A **b** [l](/x' || CAST(n AS VARCHAR) || ')' || chr(10) || chr(10) || '- one' || chr(10) || '- two' AS md FROM {notes}")
def html_to_markdown(s, d):
    page = n_text("<h1>T ", None, "</h1><script>x</script><p>A <b>b</b>\n<a href='/x", None, "'>l</a></p><ul><li>one</li><li>two</li></ul>")
    return view(s, d, "notes").select("id", htmlmd.html_to_markdown(page).alias("md"))


plan("pages_to_markdown")(lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", htmlmd.html_to_markdown(F.col("html")).alias("md")))

# code
NEXT = "'./f' || CAST(n + 1 AS VARCHAR)"
plan("extract_code_index", f"""SELECT id, 'path' AS kind, path AS raw_value, 1 AS line FROM {{files}} UNION ALL SELECT id, 'import', {NEXT}, 1 FROM {{files}} UNION ALL SELECT id, 'literal', {NEXT}, 1 FROM {{files}}
UNION ALL SELECT id, 'symbol', 'C' || CAST(n AS VARCHAR), 2 FROM {{files}} UNION ALL SELECT id, 'export', 'export class C' || CAST(n AS VARCHAR) || ' ' || chr(123) || chr(125), 2 FROM {{files}}
UNION ALL SELECT id, 'symbol', 'v' || CAST(n AS VARCHAR), 3 FROM {{files}} UNION ALL SELECT id, 'literal', 'lit ' || CAST(n AS VARCHAR), 3 FROM {{files}}""")(
    lambda s, d: code.code_index(view(s, d, "files")).select("id", "kind", "raw_value", "line"))
plan("normalize_code", "SELECT id, path AS title, repo || '/src' AS folders, 'typescript' AS language, 'code:' || repo || ':src/f' || CAST(n + 1 AS VARCHAR) || ' imports' AS links FROM {files}")(
    lambda s, d: code.normalize(view(s, d, "files")).select("id", "title", F.array_join("hierarchy", "/").alias("folders"), "language", F.array_join(F.transform("links", lambda x: F.concat_ws(" ", x["id"], x["rel"])), ",").alias("links")))


@plan("code_route", "SELECT 'q' || CAST(n AS VARCHAR) AS query_id, id, CAST(2 AS INT) AS line, 'symbol' AS kind, sha256(body) AS digest FROM {files} WHERE n % 20 = 0")
def code_route(s, d):
    f = view(s, d, "files")
    q = f.where("n % 20 = 0").select(n_text("q", None).alias("query_id"), n_text("c", None).alias("query"))
    return code.lookup(q, code.code_index(f), f).select("query_id", "id", "line", "kind", F.sha2("text", 256).alias("digest"))


# the tokens of a file of the view, by the rules that make them, and the queries of every twentieth file
RULES = [
    ("path_suffix", "1.0", 1, "path, 'f' || n || '.ts'"), ("path_segment", "1.0", 1, "'src', 'f' || n || '.ts', 'f' || n"), ("subtoken", "1.0", 1, "'src', 'f' || n, n, 'ts', m"),
    *[(rule, "1.0", 1, "'import', 'from', 'f' || m, 'export', 'class', 'const', 'lit'") for rule in ("exact", "subtoken")],
    ("exact", "10.0", 2, "'c' || n"), ("subtoken", "10.0", 2, "'c' || n, n"), ("exact", "5.0", 3, "'v' || n"), ("subtoken", "5.0", 3, "'v' || n, n"),
]
EMITTED = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT id, '{rule}' AS match_class, {factor} AS factor, {line} AS line, unnest([{tokens}]) AS token FROM (SELECT id, path, CAST(n AS VARCHAR) AS n, CAST(n + 1 AS VARCHAR) AS m FROM {{files}})" for rule, factor, line, tokens in RULES) + ") WHERE length(token) >= 2"
ASKED = """SELECT query_id, unnest([t for t in tokens if length(t) >= 2]) AS token FROM (SELECT 's' || n AS query_id, ['c' || n, n] AS tokens FROM n UNION ALL SELECT 'p' || n, ['f' || n || '.ts', 'f' || n, n, 'ts'] FROM n
UNION ALL SELECT 'w' || n, ['src/f' || n || '.ts', 'f' || n || '.ts', 'src', 'f' || n, n, 'ts'] FROM n UNION ALL SELECT 'm' || n, ['class', 'v' || n, n] FROM n)"""


def code_queries(f):
    """A symbol, a file name, a path and two words for every twentieth file."""
    n = F.col("n").cast("string")
    shapes = [("s", F.concat(F.lit("C"), n)), ("p", F.concat(F.lit("f"), n, F.lit(".ts"))), ("w", F.concat(F.lit("src/f"), n, F.lit(".ts"))), ("m", F.concat(F.lit("class v"), n))]
    return f.where("n % 20 = 0").select(F.explode(F.array(*[F.struct(F.concat(F.lit(k), n).alias("query_id"), q.alias("query")) for k, q in shapes])).alias("q")).select("q.*")


def tokens_of(s, d):
    f = view(s, d, "files")
    return code.token_index(f, code.code_index(f))


plan("code_tokens", f"SELECT id, token, match_class, max(factor) AS factor FROM ({EMITTED}) GROUP BY id, token, match_class")(lambda s, d: tokens_of(s, d).select("id", "token", "match_class", "factor"))
plan("query_tokens", f"WITH n AS (SELECT CAST(n AS VARCHAR) AS n FROM {{files}} WHERE n % 20 = 0) {ASKED}")(
    lambda s, d: code_queries(view(s, d, "files")).select("query_id", F.explode(text.query_tokens(F.col("query"))).alias("token")))
plan("code_score", f"""WITH n AS (SELECT CAST(n AS VARCHAR) AS n FROM {{files}} WHERE n % 20 = 0), e AS ({EMITTED}), a AS ({ASKED}) SELECT query_id, id, max(CASE WHEN match_class IN ('exact', 'path_suffix') THEN 7000 ELSE 4000 END + CASE WHEN match_class = 'exact' THEN 500 ELSE 50 END + 100 * factor)
+ (1 - 1 / count(DISTINCT token)) * 400 AS score FROM e JOIN a USING (token) GROUP BY query_id, id""")(
    lambda s, d: code.ranked(code_queries(view(s, d, "files")), tokens_of(s, d)).select("query_id", "id", "score"))

# vectors
plan("embed_fake", "SELECT id, 1 AS vectors, 32 AS dim, 1.0 AS norm FROM {notes}")(
    lambda s, d: embed.backfill(view(s, d, "notes").select("id", F.lit(0).alias("seq"), F.lit("").alias("heading"), "query"). withColumnRenamed("query", "text"), s.createDataFrame([], "id string, seq int, model string"), embed.embedder("fake"))
    .groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("vectors"), F.max(F.size("vec")).alias("dim"), F.round(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))), 5).alias("norm")))
plan("f32_decode", "SELECT id, 0.6 AS x, 0.8 AS y FROM {notes}")(
    lambda s, d: embed.decoded(view(s, d, "notes").select("id", F.unhex(F.lit("0000404000008040")).alias("data"))).select("id", F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("x"), F.round(F.get("vec", F.lit(1)).cast("double"), 5).alias("y")))


@plan("backfill_vectors", """SELECT id, seq, CAST(len(range(0, greatest(length(text) - (budget - step) - 1, 0) + 1, step)) AS INT) AS windows FROM
(SELECT *, greatest(1, CAST(floor(budget * 0.75) AS INT)) AS step FROM (SELECT c.id, c.seq, c.text, 1024 - length(substr(d.title || chr(10) || chr(10), 1, 512)) AS budget FROM {chunks} c JOIN {docs} d ON c.id = d.id WHERE d.n % 5 = 0 AND c.seq % 2 = 1))""")
def backfill_vectors(s, d):
    """Code chunks; those of even number have vectors already."""
    docs = view(s, d, "docs").where("source = 'code'")
    c = view(s, d, "chunks").select("id", "seq", "text").join(docs.select("id", F.col("title").alias("heading")), "id")
    model = embed.embedder("fake", dim=4)
    have = c.where("seq % 2 = 0").select("id", "seq", F.lit(model.id).alias("model"))
    return embed.backfill(c, have, model).groupBy("id", "seq").agg(F.count(F.lit(1)).cast("int").alias("windows"))


# maintenance
def _live(s, d):
    return view(s, d, "docs").where("source = 'confluence' AND NOT tombstoned").select("tenant", "id", "n")


@plan("reconcile", "SELECT id FROM {docs} WHERE source = 'confluence' AND NOT tombstoned AND n % 9 = 2")
def reconcile(s, d):
    """The listing has eight of nine documents that are live, and some that never were."""
    listed = _live(s, d).where("n % 9 <> 2").unionByName(_live(s, d).withColumn("id", F.concat(F.lit("new:"), "id")))
    return maintain.reconcile(_live(s, d), listed)[1].select("id")


@plan("reconcile_subtree", "SELECT id FROM {docs} WHERE source = 'confluence' AND NOT tombstoned AND id LIKE 'doc:1%' AND n % 4 = 3")
def reconcile_subtree(s, d):
    return maintain.reconcile(_live(s, d), _live(s, d).where("n % 4 <> 3"), prefix="doc:1")[1].select("id")


@plan("reconcile_verdicts", "SELECT * FROM (VALUES ('all there', 'retired'), ('broken off', 'incomplete'), ('nearly empty', 'refused')) AS t(listing, verdict)")
def reconcile_verdicts(s, d):
    few = _live(s, d).where("n % 9 = 2")
    rows = [("all there", _live(s, d), True), ("broken off", few, False), ("nearly empty", few, True)]
    return s.createDataFrame([(name, maintain.reconcile(_live(s, d), listed, complete)[0]) for name, listed, complete in rows], "listing string, verdict string")


# evaluation
@plan("run_eval", """WITH j AS (SELECT r.run, r.query_id, r.rank, coalesce(q.grade, 0) AS grade FROM {ranked} r LEFT JOIN {qrels} q ON r.query_id = q.query_id AND r.doc_id = q.doc_id WHERE r.rank <= 50),
i AS (SELECT query_id, sum(CASE WHEN rn <= 10 THEN grade / log2(rn + 1) ELSE 0 END) AS ideal, count(*) FILTER (WHERE grade > 0) AS relevant FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS rn FROM {qrels}) GROUP BY query_id),
m AS (SELECT run, query_id, count(*) FILTER (WHERE grade > 0) AS hits, sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) ELSE 0 END) AS dcg, min(CASE WHEN grade > 0 THEN rank END) AS first FROM j GROUP BY run, query_id)
SELECT run, CAST(count(*) AS BIGINT) AS queries, round(avg(CASE WHEN relevant > 0 THEN hits * 1e0 / relevant ELSE 0 END), 6) AS recall50, round(avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END), 6) AS ndcg10, round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1e0 / first END), 6) AS mrr FROM m JOIN i ON m.query_id = i.query_id GROUP BY run""")
def run_eval(s, d, depth: int = 50, k: int = 10):
    """Each run's queries to a depth, scored against the judgements and averaged: one pass over both, grouped by query."""
    r, q = view(s, d, "ranked").where(F.col("rank") <= depth), view(s, d, "qrels")
    gain = lambda grade, rank: F.when(rank <= k, grade / F.log2(rank + 1)).otherwise(0.0)
    found = r.join(q, ["query_id", "doc_id"], "left").groupBy("run", "query_id").agg(
        F.count_if(F.col("grade") > 0).alias("hits"), F.sum(gain(F.coalesce("grade", F.lit(0)), F.col("rank"))).alias("dcg"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))
    ideal = q.withColumn("place", place).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("place"))).alias("ideal"), F.count_if(F.col("grade") > 0).alias("relevant"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    mean = lambda c: F.round(F.avg(c), 6)
    return found.join(ideal, "query_id").groupBy("run").agg(F.count(F.lit(1)).alias("queries"), mean(part("hits", "relevant")).alias("recall50"), mean(part("dcg", "ideal")).alias("ndcg10"), mean(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


@plan("golden_eval", "SELECT q.query_id, round(count(r.doc_id) * 1e0 / count(*), 6) AS recall FROM (SELECT DISTINCT query_id, doc_id FROM {qrels} WHERE grade = 3) q LEFT JOIN {ranked} r ON r.run = 1 AND r.rank <= 10 AND r.query_id = q.query_id AND r.doc_id = q.doc_id GROUP BY q.query_id")
def golden_eval(s, d):
    """Recall at 10 of the first run against golden lines, which are written here and read back."""
    lines = view(s, d, "qrels").where("grade = 3").groupBy("query_id").agg(F.concat(F.lit("- `"), F.first("query_id"), F.lit("` → "), F.array_join(F.collect_set("doc_id"), ", "), F.lit(" — of the labels")).alias("line"))
    g = lines.select(markdown.golden(F.col("line")).alias("g")).select(F.col("g.query").alias("query_id"), F.explode("g.ids").alias("doc_id"))
    top = view(s, d, "ranked").where("run = 1 AND rank <= 10").select("query_id", "doc_id", F.lit(1).alias("hit"))
    return g.join(top, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)), 6).alias("recall"))


@plan("judgments_io", "SELECT query_id, doc_id, CAST(rank % 4 AS INT) AS grade FROM {ranked} WHERE run = 1 AND rank <= 10")
def judgments_io(s, d):
    """A worksheet of judgements as markdown lines, each line twice with another grade; the first one read of a pair counts."""
    pool = view(s, d, "ranked").where("run = 1 AND rank <= 10")
    row = lambda n, grade: F.struct(F.lit(n).alias("n"), F.concat(F.lit("| "), "query_id", F.lit(" | "), "doc_id", F.lit(" | "), grade.cast("string"), F.lit(" |")).alias("line"))
    sheet = pool.select(F.explode(F.array(row(2, (F.col("rank") + 1) % 4), row(1, F.col("rank") % 4), row(0, F.lit("?")))).alias("x")).select("x.*")
    return judgments(sheet)


def judgments(sheet):
    """query_id, doc_id, grade of the lines (n, line) that hold a grade from 0 to 3; of several for a pair, the first."""
    shape = r"^\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*([0-3])\s*\|"
    part = lambda k: F.regexp_extract("line", shape, k)
    read = sheet.where(F.col("line").rlike(shape)).select(part(1).alias("query_id"), part(2).alias("doc_id"), part(3).cast("int").alias("grade"), "n")
    return read.groupBy("query_id", "doc_id").agg(F.min_by("grade", "n").alias("grade"))


# functions
@plan("fn_json", "SELECT id, CAST(n AS VARCHAR) AS n, 'b' AS second, true AS equal, 2 AS items FROM {notes}")
def fn_json(s, d):
    """Fields by path, array items, and equality whatever the order of keys."""
    j = F.to_json(F.struct(F.col("n").alias("k"), F.array(F.lit("a"), F.lit("b")).alias("l")))
    other = F.to_json(F.struct(F.array(F.lit("a"), F.lit("b")).alias("l"), F.col("n").alias("k")))
    sorted_ = lambda c: F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))
    return view(s, d, "notes").select("id", F.get_json_object(j, "$.k").alias("n"), F.get_json_object(j, "$.l[1]").alias("second"), (sorted_(j) == sorted_(other)).alias("equal"), F.json_array_length(F.get_json_object(j, "$.l")).alias("items"))


@plan("fn_map", "SELECT id, 'k' || CAST(n AS VARCHAR) || ',z' AS keys, n AS at, CAST(NULL AS BIGINT) AS missing FROM {notes}")
def fn_map(s, d):
    m = F.map_from_entries(F.array(F.struct(n_text("k", None).alias("k"), F.col("n").alias("v")), F.struct(F.lit("z").alias("k"), F.lit(0).cast("long").alias("v"))))
    return view(s, d, "notes").select("id", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"), F.try_element_at(m, n_text("k", None)).alias("at"), F.try_element_at(m, F.lit("none")).alias("missing"))


@plan("fn_hash", "SELECT id, sha256(query) AS sha256, sha1(query)[:12] AS sha1_prefix FROM {notes}")
def fn_hash(s, d):
    return view(s, d, "notes").select("id", F.sha2("query", 256).alias("sha256"), F.substring(F.sha1("query"), 1, 12).alias("sha1_prefix"))
