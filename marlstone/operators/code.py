"""Code files as documents, their index of names, and lookups with bounded context."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import paths, text
from marlstone.sources.scan import PAIRS, Lists, pieces
from marlstone.sources.store import written

# What an index entry is, by the shape of its line.
MOST = 256  # fixed value: longer values are not indexed
SYMBOL = r"\b(?:function|class|interface|type|const|let|var|def|func|struct|enum)\s+([A-Za-z_$][\w$]*)"
IMPORT = r"""\bimport\s+(?:.+?\s+from\s+)?["']([^"']+)["']|\brequire\(["']([^"']+)["']\)"""
LITERAL = r"""["']([^"']{2,})["']"""
FROM = r"\bfrom\s+([\w.]+)\s+import\b"
TEST_PATH, TEST_LINE = r"(^|/)(__tests__/|.*\.(test|spec)\.)", r"\b(describe|it|test|pytest|Test[A-Z])\s*\(?"
EXTENSION = r"\.(?:ts|tsx|js|jsx|mjs|cjs)\z"
CONTEXT, BUDGET = 3, 16_000  # fixed values: lines around a citation, characters of all citations


def _all(line: Column, pattern: str, groups: int = 1) -> Column:
    """The first group of each match that is not empty."""
    found = [F.regexp_extract_all(line, F.lit(pattern), F.lit(k)) for k in range(1, groups + 1)]
    return F.filter(found[0] if groups == 1 else F.zip_with(*found, lambda a, b: F.when(a != "", a).otherwise(b)), lambda x: x != "")


def code_index(files: DataFrame) -> DataFrame:
    """id, kind, value, raw_value, line, symbol_kind and language of ``files`` (id, path, body) in known languages: a row for each name on each line."""
    f = files.withColumn("language", paths.language(F.col("path"))).where("language IS NOT NULL")
    own = f.select("id", F.lit("path").alias("kind"), F.col("path").alias("raw_value"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("symbol_kind"), "language")
    lines = f.select("id", "path", "language", F.posexplode(F.split("body", "\n", -1)).alias("k", "text"))
    line, none = F.col("text"), F.lit(None).cast("string")
    entry = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("raw_value"), none.alias("symbol_kind")))
    symbols = F.transform(F.regexp_extract_all(line, F.lit(SYMBOL), F.lit(0)), lambda m: F.struct(F.lit("symbol").alias("kind"), F.element_at(F.split(m, r"\s+", -1), -1).alias("raw_value"), F.split(m, r"\s+", -1)[0].alias("symbol_kind")))
    some = lambda ok, value: F.when(ok, F.array(value)).otherwise(F.array().cast("array<string>"))
    entries = F.concat(
        symbols, entry("import", _all(line, IMPORT, 2)), entry("export", some(line.rlike(r"\bexport\b"), F.trim(line))),
        entry("literal", _all(line, LITERAL)), entry("test", some(F.col("path").rlike(TEST_PATH) | line.rlike(TEST_LINE), F.col("path"))),
    )
    named = lines.select("id", "language", (F.col("k") + 1).alias("line"), F.explode(entries).alias("x")).select("id", "x.kind", "x.raw_value", "line", "x.symbol_kind", "language")
    return own.unionByName(named).where(F.char_length("raw_value") <= MOST).withColumn("value", F.lower("raw_value"))


def imports(path: Column, body: Column) -> Column:
    """Relative imports as paths without their extension, in order of appearance."""
    specs = F.concat(_all(body, IMPORT, 2), _all(body, FROM))
    folder = F.regexp_replace(path, r"[^/]*\z", "")
    up = lambda s: F.filter(paths.folded(F.concat(folder, s)), lambda x: x != "..")
    return F.filter(F.transform(F.filter(specs, lambda s: s.startswith(".")), lambda s: F.regexp_replace(F.array_join(up(s), "/"), EXTENSION, "")), lambda x: x != "")


def normalize(files: DataFrame) -> DataFrame:
    """Code documents of ``files`` (repo, path, body): id, title, folders, language and links (id, rel), without links to themselves."""
    own, bare = F.concat_ws(":", F.lit("code"), "repo", "path"), F.concat_ws(":", F.lit("code"), "repo", F.regexp_replace("path", EXTENSION, ""))
    tickets = F.transform(text.ticket_keys(F.col("body")), lambda k: F.struct(F.concat(F.lit("jira:issue:"), k).alias("id"), F.lit("references").alias("rel")))
    imported = F.transform(imports(F.col("path"), F.col("body")), lambda p: F.struct(F.concat_ws(":", F.lit("code"), F.col("repo"), p).alias("id"), F.lit("imports").alias("rel")))
    folders = F.split("path", "/", -1)
    return files.select(
        own.alias("id"), F.col("path").alias("title"), F.concat(F.array("repo"), F.slice(folders, F.lit(1), F.size(folders) - 1)).alias("hierarchy"),
        paths.language(F.col("path")).alias("language"), F.filter(F.concat(tickets, imported), lambda x: (x["id"] != own) & (x["id"] != bare)).alias("links"), "body",
    )


def lookup(queries: DataFrame, index: DataFrame, files: DataFrame, limit: int = 8) -> DataFrame:
    """query_id, id, path, line, kind, text: the first citations of each query's value with lines around them, in order while
    they fit the budget. One that does not fit is left out, and later ones may still fit.

    ``queries``: query_id, query, and as filters kind, repo and path if it has them (null: any). ``files`` are those that may be seen.
    """
    hits = index.join(queries.select(F.lower("query").alias("value"), *[F.col(c).alias(f"asked_{c}") for c in queries.columns if c != "query"]), "value").withColumnRenamed("asked_query_id", "query_id")
    hits = hits.join(files.select("id", "path", *(["repo"] if "repo" in files.columns else [])), "id")
    for c in ("kind", "repo", "path"):
        if c in queries.columns:
            hits = hits.where(F.col(f"asked_{c}").isNull() | (F.col(f"asked_{c}") == F.col(c)))
    order = Window.partitionBy("query_id").orderBy("path", "line", "kind", "id")
    hits = hits.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit)  # bodies meet what is left
    cited = hits.join(files.select("id", F.split("body", "\n", -1).alias("lines")), "id")
    first = F.greatest(F.col("line") - CONTEXT, F.lit(1))
    cited = cited.withColumn("text", F.array_join(F.slice("lines", first, F.col("line") + CONTEXT - first + 1), "\n")).drop("lines")
    rows = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rn", "id", "path", "line", "kind", "text"))).alias("all"))
    fit = F.aggregate(
        "all", F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("kept")),
        lambda a, x: F.when(a["n"] + F.char_length(x["text"]) <= BUDGET, F.struct((a["n"] + F.char_length(x["text"])).alias("n"), F.concat(a["kept"], F.array(x["rn"])).alias("kept"))).otherwise(a),
    )
    rows = rows.withColumn("kept", fit["kept"])
    return rows.select("query_id", F.explode(F.filter("all", lambda x: F.array_contains(F.col("kept"), x["rn"]))).alias("x")).select("query_id", "x.id", "x.path", "x.line", "x.kind", "x.text")


def worth(defining, exact, factor) -> Column:
    """What a match counts for: its class, whether it is exact, and the factor of its kind."""
    return F.when(defining, 7000).otherwise(4000) + F.when(exact, 500).otherwise(50) + 100 * factor


def more_terms(n: Column) -> Column:
    """What more distinct terms add, up to 400."""
    return (1 - 1 / n) * 400


def score(matches: DataFrame) -> DataFrame:
    """query_id, id, score from query_id, id, term, definition (whether the term is defined there), exact and factor: the best
    match, and more for more distinct terms."""
    best = worth(F.col("definition"), F.col("exact"), F.col("factor"))
    return matches.groupBy("query_id", "id").agg((F.max(best) + more_terms(F.countDistinct("term"))).alias("score"))


# What the kind of a symbol adds, by the word that declares it.
FACTORS = {"class": 10.0, "struct": 9.5, "interface": 8.0, "type": 8.0, "function": 7.0, "def": 7.0, "func": 7.0, "const": 5.0, "let": 4.0, "var": 4.0}


def token_index(files: DataFrame, index: DataFrame) -> DataFrame:
    """token, id, path, match_class, factor and line: every token under which a file (id, path, body) is found, with the rule that made it.

    exact is an identifier of the body, path_suffix and path_segment are parts of the path, subtoken a part of either. A token
    of a name that ``index`` (of ``code_index``) says is declared in the file has the factor of the declaration, others 1.
    Laid out by token, by value.
    """
    suffixes, segments, parts = text.path_parts(F.col("path"))
    rule = lambda tokens, name: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(name).alias("match_class")))
    one = F.lit(1.0).alias("factor"), F.lit(1).alias("line")
    of_path = files.select("id", "path", *one, F.explode(F.concat(rule(suffixes, "path_suffix"), rule(segments, "path_segment"), rule(parts, "subtoken"))).alias("x"))
    named = lambda name: F.concat(rule(F.filter(F.array(F.lower(name)), lambda t: F.char_length(t) >= 2), "exact"), rule(text.subtokens(name), "subtoken"))
    said = files.select("id", "path", F.explode(text.identifiers(F.col("body"))).alias("name")).select("id", "path", *one, F.explode(named(F.col("name"))).alias("x"))
    factor = F.lit(1.0)
    for kind, value in FACTORS.items():
        factor = F.when(F.col("symbol_kind") == kind, value).otherwise(factor)
    declared = index.where("kind = 'symbol'").join(files.select("id", "path"), "id").select("id", "path", factor.alias("factor"), "line", F.explode(named(F.col("raw_value"))).alias("x"))
    rows = of_path.unionByName(said).unionByName(declared).select("x.token", "id", "path", "x.match_class", "factor", "line")
    best = rows.groupBy("token", "id", "path", "match_class").agg(F.max(F.struct("factor", (-F.col("line")).alias("line"))).alias("b"))
    best = best.select("token", "id", "path", "match_class", "b.factor", (-F.col("b.line")).alias("line"))
    return written(best.repartitionByRange("token", "id").sortWithinPartitions("token", "id"), "code-tokens")


def ranked(queries: DataFrame, tokens: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """query_id, id, path, line and score of the files that hold a token of a query (query_id, query), by the rules that made them.

    The best match counts (by class, exactness and the factor of what is declared), never their sum; more distinct tokens add up to
    400. ``line`` is that of the best match. ``files`` (id): those that may be seen.

    The asked tokens of a file are exchanged once; what a file adds to each query is found where they are, for a block of queries at a
    time, and leaves the task as one row of the file, so a token that every file holds makes no pairs in an exchange.
    """
    asked = written(queries.select("query_id", F.explode(text.query_tokens(F.col("query"))).alias("token")).distinct(), "code-queries")
    hits = tokens.join(asked.select("token").distinct(), "token", "left_semi")
    if files is not None:
        hits = hits.join(files.select("id"), "id", "left_semi")
    exact = F.col("match_class") == "exact"
    best = worth(exact | (F.col("match_class") == "path_suffix"), exact, F.col("factor"))
    held = written(hits.groupBy("id", "path").agg(F.collect_list(F.struct("token", best.cast("double").alias("best"), F.col("line").cast("int").alias("line"))).alias("hits")), "code-hits")
    out = []
    for rows in pieces(asked.groupBy("query_id").agg(F.collect_list("token").alias("w")), ["query_id"]):
        number: dict = {}
        lists: list = []
        for k, r in enumerate(rows):
            for w in r["w"]:
                if number.setdefault(w, len(lists)) == len(lists):
                    lists.append([])
                lists[number[w]].append(k)
        found = held.mapInArrow(_scorer(number, Lists.of(lists), max(1, len(rows))), "id string, path string, x array<struct<q:int,line:int,score:double>>")
        keys = held.sparkSession.createDataFrame([(k, r["query_id"]) for k, r in enumerate(rows)], f"q int, query_id {asked.schema['query_id'].dataType.simpleString()}")
        out.append(found.select("id", "path", F.inline("x")).join(F.broadcast(keys), "q").select("query_id", "id", "path", "line", "score"))
    return reduce(DataFrame.unionByName, out)


def _scorer(number: dict, wants: Lists, queries: int):
    """Rows of files with line and score for each of a block's queries, from rows of files with their asked tokens."""

    def scored(b):
        of = b.column(2)
        token = np.array([number.get(t, -1) for t in of.flatten().field("token").to_pylist()], np.int64)
        best, line = (of.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("best", "line"))
        file = np.repeat(np.arange(b.num_rows), np.diff(of.offsets.to_numpy()))
        order = np.lexsort((-line, best, token, file))
        order = order[token[order] >= 0]
        last = np.r_[(np.diff(token[order]) != 0) | (np.diff(file[order]) != 0), np.ones(min(1, len(order)), bool)]
        order = order[last]  # a token counts once in a file, by its best match
        order = order[np.lexsort((-line[order], best[order]))]
        q, at = wants.expand(token[order])
        cell = file[order][at] * queries + q
        top = np.full(b.num_rows * queries, -1)
        np.maximum.at(top, cell, at)
        terms = np.bincount(cell, minlength=len(top))
        cells = np.flatnonzero(terms)
        won = order[top[cells]]
        score = best[won] + (1 - 1 / terms[cells]) * 400
        x = pa.StructArray.from_arrays([pa.array((cells % queries).astype(np.int32)), pa.array(line[won].astype(np.int32)), pa.array(score)], ["q", "line", "score"])
        ends = np.searchsorted(cells, np.arange(b.num_rows + 1) * queries).astype(np.int32)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), x)], ["id", "path", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PAIRS // queries)
        for b in batches:
            for i in range(0, b.num_rows, step):
                yield scored(b.slice(i, step))

    return run
