"""Issues as catalog documents: facets and comments in the body, typed links before those guessed from prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text

ISSUE = (
    "key string, url string, fields struct<summary:string,status:string,issuetype:string,project:string,reporter:string,created:string,updated:string,description:string,"
    "comments:array<struct<author:string,body:string,visibility:struct<type:string,value:string>>>,assignee:string,labels:array<string>,priority:string,resolution:string,"
    "components:array<string>,fix_versions:array<string>,parent:string,issue_links:array<struct<type:string,key:string>>>"
)
#: label -> field; lists are joined. Facets that are not there leave no line.
FACETS = [
    ("Status", "status"), ("Type", "issuetype"), ("Priority", "priority"), ("Resolution", "resolution"), ("Assignee", "assignee"), ("Reporter", "reporter"),
    ("Labels", "labels"), ("Components", "components"), ("Fix versions", "fix_versions"), ("Parent", "parent"),
]
LISTS = ("labels", "components", "fix_versions")


def facet(label: str, field: str) -> Column:
    f = F.col(f"fields.{field}")
    value = F.array_join(f, ", ") if field in LISTS else f
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"**{label}:** "), value))


def normalize(issues: DataFrame) -> DataFrame:
    """id, title, url, body, links (id, rel) and restricted (comments that were left out). A comment with a visibility of any kind is left out, and counted."""
    none = F.array().cast("array<struct<author:string,body:string,visibility:struct<type:string,value:string>>>")
    comments = F.coalesce("fields.comments", none)
    shown, hidden = F.filter(comments, lambda c: c["visibility"].isNull()), F.filter(comments, lambda c: c["visibility"].isNotNull())
    said = F.transform(shown, lambda c: F.concat(F.lit("## Comment — "), F.coalesce(c["author"], F.lit("unknown")), F.lit("\n\n"), F.coalesce(c["body"], F.lit(""))))
    omitted = F.when(F.size(hidden) > 0, F.concat(F.lit("**Restricted comments omitted:** "), F.size(hidden).cast("string")))
    head = F.array_compact(F.array(*[facet(*x) for x in FACETS], omitted))
    parts = F.concat(F.array(F.array_join(head, "\n"), F.coalesce("fields.description", F.lit(""))), said)
    own = F.concat(F.lit("jira:issue:"), "key")
    prose = F.concat_ws("\n", F.col("fields.summary"), F.col("fields.description"), F.array_join(F.transform(shown, lambda c: c["body"]), "\n"))
    typed = F.transform(F.coalesce("fields.issue_links", F.array().cast("array<struct<type:string,key:string>>")), lambda x: F.struct(F.concat(F.lit("jira:issue:"), x["key"]).alias("id"), x["type"].alias("rel")))
    parent = F.when(F.col("fields.parent").isNotNull(), F.array(F.struct(F.concat(F.lit("jira:issue:"), "fields.parent").alias("id"), F.lit("parent").alias("rel")))).otherwise(F.array().cast("array<struct<id:string,rel:string>>"))
    known = F.filter(F.array_distinct(F.concat(typed, parent)), lambda x: x["id"] != F.col("own"))
    out = issues.select(
        own.alias("own"), F.concat(F.col("key"), F.lit(": "), F.coalesce("fields.summary", F.lit(""))).alias("title"), "url", F.array_join(F.filter(parts, lambda x: x != ""), "\n\n").alias("body"),
        F.size(hidden).alias("restricted"), F.concat(typed, parent).alias("all"), text.links(prose, own).alias("guessed"),
    )
    known = F.filter(F.array_distinct("all"), lambda x: x["id"] != F.col("own"))
    ids = F.transform(known, lambda x: x["id"])
    guessed = F.transform(F.array_except("guessed", ids), lambda x: F.struct(x.alias("id"), F.lit("references").alias("rel")))
    return out.select(F.col("own").alias("id"), "title", "url", "body", F.concat(known, guessed).alias("links"), "restricted")
