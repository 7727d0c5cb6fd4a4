"""Requirement bodies as tables: a row for each body, and a row for each node of its tree.

Bodies are JSON texts (body_id, body). Children are kept as JSON, so a node of
any depth has one flat schema, and a whole tree unfolds inside its own row:
no level of it is exchanged.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.sources.store import collected, written

PASS = "struct<unknowns:double,complexity:double,magnitude:double,decision:string,at:string,note:string>"
GROUNDING = "struct<source:string,docId:string,title:string,url:string,quote:string,retrievedAt:string,traceId:string,hedged:boolean>"
CRITERION = "struct<id:string,stakeholder:string,given:string,when:string,then:array<string>,observable:boolean>"
NODE = (
    f"struct<id:string,parentId:string,nodeKey:string,statement:string,score:{PASS},scoreHistory:array<{PASS}>,decision:string,isLeaf:boolean,"
    f"children:array<string>,acceptanceCriteria:array<{CRITERION}>,grounding:array<{GROUNDING}>,resolvedFrom:string,residualRef:string>"
)
CLARIFICATION = (
    "struct<id:string,nodeId:string,question:string,options:array<struct<id:string,text:string,implication:string>>,answer:struct<chosenOptionId:string,freetext:string>,"
    f"answeredBy:struct<kind:string,name:string>,answeredAt:string,resultingDetail:string,resolvedFrom:string,grounding:array<{GROUNDING}>>"
)
RESIDUAL = "struct<id:string,kind:string,nodeId:string,statement:string,mitigation:string,acceptedBy:struct<kind:string,name:string>,acceptedAt:string>"
BODY = (
    "struct<schemaVersion:string,metadata:struct<workItem:string,title:string,deliveryType:struct<kind:string,tech:string>,createdAt:string,updatedAt:string,"
    "executionProfile:struct<mode:string>,generator:struct<agent:string,model:string,version:string,provenance:string>,corpusMode:string>,"
    f"tree:string,clarifications:array<{CLARIFICATION}>,residuals:array<{RESIDUAL}>,traceability:map<string,string>,coverage:map<string,double>,"
    "signoff:struct<approvers:array<struct<name:string,role:string,kind:string,at:string>>,result:string>,"
    "analysis:struct<ranAt:string,checksRun:double,findings:array<struct<id:string,severity:string,path:string,message:string>>>>"
)
LEVELS = 8  # levels that one projection unfolds; deeper trees take another

# Bands, thresholds and lexicons of the method.
BANDS = [1, 2, 3, 5, 8, 13, 21]
ATOMIC, BREAK_DOWN, CLARIFY_FLOOR, MAX_DEPTH = 2, 5, 5, 6
DECISIONS = ["leaf", "decompose", "clarify"]
HEDGES = [
    "i think", "roughly", "haven't measured", "havent measured", "check with", "not sure", "tbc", "probably", "should be", "approximately", "afaik",
    "from memory", "i believe", "was aiming for",
]
DEFERRALS = ["tbd", "todo", "decide later", "to be confirmed", "to be decided", "fixme", "???"]
OBSERVABLE = [
    "reject", "accept", "return", "log", "emit", "alert", "record", "increment", "status", "code", "within", "count", "error", "response", "field",
    "header", "metric", "snapshot",
]
#: White space of the method's own language.
WIDE = "\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
SPACES = f"[\\s{WIDE}]+"
WORDY = f"[^\\s{WIDE}]"
#: White space that is not one plain space already.
UNEVEN = f"[\\t\\n\\x0b\\f\\r{WIDE}][\\s{WIDE}]*| [\\s{WIDE}]+"


class Trees(NamedTuple):
    bodies: DataFrame  # body_id, b (null where the text is not an object)
    nodes: DataFrame  # body_id, place (child numbers from the root on: sorts in pre-order), depth, parent (its id), n


def fold(text: Column) -> Column:
    return F.regexp_replace(text, UNEVEN, " ")


def quoted(text: Column, quote: Column) -> Column:
    """Whether the folded text holds the folded and trimmed quote; the text itself is searched, as it is far longer than a quote."""
    words = F.replace(F.trim(fold(quote)), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.rlike(text, F.concat(F.lit("\\Q"), F.replace(words, F.lit(" "), F.lit(f"\\E{SPACES}\\Q")), F.lit("\\E")))


def holds(text: Column, lexicon: list[str]) -> Column:
    """Whether the text holds an entry of the lexicon, in any case and broken by any white space: one search for all entries."""
    entries = [SPACES.join(re.escape(w) for w in x.split(" ")) for x in lexicon]
    return F.coalesce(F.lower(text).rlike("|".join(entries)), F.lit(False))


def marker(text: Column, lexicon: list[str]) -> Column:
    """The first entry of the lexicon that the text holds."""
    low = F.lower(fold(text))
    return F.coalesce(*[F.when(low.contains(x), F.lit(x)) for x in lexicon])


def observable(text: Column) -> Column:
    return F.coalesce(text.rlike("[0-9]"), F.lit(False)) | holds(text, OBSERVABLE)


def is_band(x: Column) -> Column:
    return F.coalesce(x.isin([float(b) for b in BANDS]), F.lit(False))


def magnitude(p: Column) -> Column:
    return F.greatest(p["unknowns"], p["complexity"])


def zone(m: Column) -> Column:
    return F.when(m <= ATOMIC, "atomic").when(m < BREAK_DOWN, "review").otherwise("must_break_down")


def decision_space(p: Column) -> Column:
    """The decisions that the bands of a pass admit."""
    m = magnitude(p)
    return F.filter(
        F.array(F.when(m < BREAK_DOWN, "leaf"), F.when(m > ATOMIC, "decompose"), F.when((m >= BREAK_DOWN) & (p["unknowns"] >= CLARIFY_FLOOR), "clarify")),
        lambda x: x.isNotNull(),
    )


def recommended(p: Column, before: Column) -> Column:
    """The action to take: clarify where unknowns did not fall since the last pass and clarifying is admissible, else by zone."""
    stuck = before.isNotNull() & (p["unknowns"] >= before) & (p["unknowns"] >= CLARIFY_FLOOR)
    return F.when(stuck & F.array_contains(decision_space(p), "clarify"), "clarify").when(magnitude(p) >= BREAK_DOWN, "decompose").otherwise("leaf")


def instant(text: Column) -> Column:
    return F.try_to_timestamp(text)


def _unfold(rows: DataFrame) -> DataFrame:
    """Nodes of LEVELS levels from ``rows``: body_id, place, depth, parent, json."""
    d = rows.withColumn("l0", F.array(F.struct("place", "depth", "parent", F.from_json("json", NODE).alias("n"))))
    for k in range(1, LEVELS):
        below = lambda x: F.transform(
            F.coalesce(x["n"]["children"], F.array().cast("array<string>")),
            lambda c, i: F.struct(F.concat(x["place"], F.array(i)).alias("place"), (x["depth"] + 1).alias("depth"), x["n"]["id"].alias("parent"), F.from_json(c, NODE).alias("n")),
        )
        d = d.withColumn(f"l{k}", F.flatten(F.transform(f"l{k - 1}", below)))
    return d.select("body_id", F.explode(F.concat(*[f"l{k}" for k in range(LEVELS)])).alias("x")).select("body_id", "x.*")


def read(bodies: DataFrame) -> Trees:
    """``bodies``: body_id, body."""
    b = bodies.select("body_id", F.from_json("body", BODY).alias("b"))
    rows = b.select("body_id", F.array().cast("array<int>").alias("place"), F.lit(1).alias("depth"), F.lit(None).cast("string").alias("parent"), F.col("b.tree").alias("json")).where("json IS NOT NULL")
    nodes, last = _unfold(rows), 0
    while True:
        last += LEVELS
        deeper = nodes.where((F.col("depth") == last) & (F.size("n.children") > 0))
        if not collected(deeper.select("body_id").limit(1)):
            return Trees(b, nodes)
        nodes = written(nodes, "tree")
        more = nodes.where(F.col("depth") == last).select("body_id", "place", "depth", F.col("n.id").alias("parent"), F.posexplode("n.children").alias("i", "json"))
        more = more.select("body_id", F.concat("place", F.array("i")).alias("place"), (F.col("depth") + 1).alias("depth"), "parent", "json")
        nodes = nodes.unionByName(_unfold(more))


def criteria(t: Trees) -> DataFrame:
    """body_id, place, node (its id), i, ac."""
    return t.nodes.select("body_id", "place", F.col("n.id").alias("node"), F.posexplode("n.acceptanceCriteria").alias("i", "ac"))


def citations(t: Trees) -> DataFrame:
    """body_id, path, node (its id) and g, of nodes and clarifications."""
    own = t.nodes.select("body_id", F.col("n.id").alias("node"), F.posexplode("n.grounding").alias("i", "g")).select("body_id", F.concat("node", F.lit(".grounding."), "i").alias("path"), "node", "g")
    c = t.bodies.select("body_id", F.posexplode("b.clarifications").alias("ci", "c")).select("body_id", "ci", F.col("c.nodeId").alias("node"), F.posexplode("c.grounding").alias("i", "g"))
    return own.unionByName(c.select("body_id", F.concat(F.lit("clarifications."), "ci", F.lit(".grounding."), "i").alias("path"), "node", "g"))


def traceability(t: Trees) -> DataFrame:
    """body_id, ac, node: criteria by the node that states them; of several, the last one in walking order."""
    return criteria(t).groupBy("body_id", F.col("ac.id").alias("ac")).agg(F.max_by("node", F.struct("place", "i")).alias("node"))


def coverage(t: Trees) -> DataFrame:
    """body_id and cover: the counts that a body's coverage must show."""
    n = t.nodes.groupBy("body_id").agg(F.count_if(F.col("n.decision") == "leaf").alias("leaves"), F.sum(F.greatest(F.coalesce(F.size("n.acceptanceCriteria"), F.lit(0)), F.lit(0))).alias("acs"), F.count(F.lit(1)).alias("total"))
    count = lambda f: F.size(F.filter(F.coalesce("b.clarifications", F.array().cast(f"array<{CLARIFICATION}>")), f))
    c = t.bodies.select(
        "body_id",
        count(lambda c: F.coalesce(c["answeredBy"]["kind"] == "knowledge_base", F.lit(False)) & (F.coalesce(F.size(c["grounding"]), F.lit(0)) > 0)).alias("grounded"),
        count(lambda c: F.coalesce(c["answeredBy"]["kind"] == "human", c["answeredBy"].isNull())).alias("escalated"),
        F.greatest(F.coalesce(F.size("b.residuals"), F.lit(0)), F.lit(0)).alias("carried"),
    )
    d = lambda name: F.col(name).cast("double")
    parts = [("leaves", "leaves"), ("acs", "acs"), ("unknownsTotal", "total"), ("grounded", "grounded"), ("escalated", "escalated"), ("carried", "carried")]
    return n.join(c, "body_id").select("body_id", F.map_from_arrays(F.array(*[F.lit(k) for k, _ in parts]), F.array(*[d(v) for _, v in parts])).alias("cover"))
