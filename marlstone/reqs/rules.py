"""The rules of the requirement-tree analyser, each a table of findings: body_id, path, message.

A rule is a plan over the bodies and nodes of all trees at once. What asks for
one body's rows together (unique names, histories, ids that exist) is keyed by
the body.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.reqs import tree as T
from marlstone.reqs.tree import Trees
from marlstone.sources.store import written

RULES: dict[str, tuple[str, Callable]] = {}
ROOT = "REQ-ROOT"
ROLES, RESULTS = ["PO", "TechLead", "QA"], ["partial", "failed"]


def rule(name: str, severity: str = "error"):
    def add(f):
        RULES[name] = (severity, f)
        return f

    return add


def say(*parts) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("none")) if isinstance(p, Column) else F.lit(p) for p in parts])


def found(df: DataFrame, path: Column, message: Column) -> DataFrame:
    return df.select("body_id", path.alias("path"), message.alias("message"))


def at(*parts) -> Column:
    """A path below a node."""
    return F.concat(F.col("n.id"), *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(T.WORDY), F.lit(True))


def not_(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


class _Node:
    def __getitem__(self, field: str) -> Column:
        return F.col(f"n.{field}")


n = _Node()


def several(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def passes(t: Trees) -> DataFrame:
    """body_id, id, p and where: the score and all passes of every node."""
    one = lambda p, where: F.struct(p.alias("p"), where.alias("where"))
    d = _listed(t.nodes.select("body_id", n["id"].alias("id"), _together(F.array(one(n["score"], at(".score"))), F.transform(n["scoreHistory"], lambda p, i: one(p, at(".scoreHistory.", i)))).alias("x")))
    return d.select("body_id", "id", "x.*")


def _together(*lists: Column) -> Column:
    """The members of lists, none of one that is absent."""
    return F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))


def _listed(d: DataFrame) -> DataFrame:
    """A row for each member of ``x``, so that all that stands in a row is read at once."""
    return d.withColumn("x", F.explode("x"))


def steps(t: Trees) -> DataFrame:
    """body_id, id, decision, i, before, p: each pass with the one before it."""
    h = F.col("n.scoreHistory")
    d = t.nodes.where(F.size(h) > 1).select("body_id", n["id"].alias("id"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.struct(i.alias("i"), F.get(h, i - 1).alias("before"), F.get(h, i).alias("p")))).alias("k", "x"))
    return d.select("body_id", "id", "x.*")


def clarifications(t: Trees) -> DataFrame:
    return t.bodies.select("body_id", F.posexplode("b.clarifications").alias("i", "c"))


def residuals(t: Trees) -> DataFrame:
    return t.bodies.select("body_id", F.posexplode("b.residuals").alias("i", "r"))


def approvers(t: Trees) -> DataFrame:
    return t.bodies.select("body_id", F.posexplode("b.signoff.approvers").alias("i", "a"))


# schema
def _pass_issues(p: Column, where: Column):
    return [
        (F.concat(where, F.lit(".unknowns")), p["unknowns"].isNull()), (F.concat(where, F.lit(".complexity")), p["complexity"].isNull()),
        (F.concat(where, F.lit(".magnitude")), ~T.is_band(p["magnitude"])), (F.concat(where, F.lit(".decision")), not_(p["decision"].isin(T.DECISIONS))),
        (F.concat(where, F.lit(".at")), p["at"].isNull()),
    ]


def _issues(df: DataFrame, checks: list) -> DataFrame:
    """A finding for each (path, condition) that holds."""
    bad = F.filter(F.array(*[F.when(c, F.lit(p) if isinstance(p, str) else p) for p, c in checks]), lambda x: x.isNotNull())
    return found(df.withColumn("path", F.explode(bad)), F.col("path"), say("missing or not of the form that the schema asks for: ", F.col("path")))


def empty(c: Column) -> Column:
    return F.coalesce(F.length(c) == 0, F.lit(True))


SOURCES = ["context", "architecture", "project_docs", "knowledge_base", "human"]


@rule("SCHEMA-001")
def body_parses(t: Trees) -> DataFrame:
    b, m = F.col("b"), F.col("b.metadata")
    of = lambda c, *values: not_(c.isin(*values))
    top = _issues(t.bodies.where("b IS NOT NULL AND (b.tree IS NOT NULL OR b.schemaVersion IS NOT NULL OR b.metadata IS NOT NULL)"), [
        ("schemaVersion", of(b["schemaVersion"], "1.0")), ("tree", b["tree"].isNull()), ("metadata.workItem", empty(m["workItem"])), ("metadata.title", empty(m["title"])),
        ("metadata.deliveryType.kind", of(m["deliveryType"]["kind"], "ui", "backend", "migration", "mixed")), ("metadata.deliveryType.tech", of(m["deliveryType"]["tech"], "new", "legacy")),
        ("metadata.createdAt", m["createdAt"].isNull()), ("metadata.updatedAt", m["updatedAt"].isNull()),
        ("metadata.executionProfile.mode", m["executionProfile"].isNotNull() & of(m["executionProfile"]["mode"], "full", "fast")),
        ("metadata.generator.agent", m["generator"]["agent"].isNull()), ("metadata.generator.version", m["generator"]["version"].isNull()),
        ("metadata.generator.provenance", of(m["generator"]["provenance"], "live", "replay")), ("metadata.corpusMode", of(m["corpusMode"], "fixtures", "live")),
        ("signoff.result", b["signoff"].isNotNull() & b["signoff"]["result"].isNull()),
    ])
    whole = t.bodies.where("b IS NULL OR (b.tree IS NULL AND b.schemaVersion IS NULL AND b.metadata IS NULL)")
    nodes = _issues(t.nodes, [
        (at(".id"), not_(n["id"].rlike(r"^REQ-ROOT(\.[0-9]+)*\z"))), (at(".nodeKey"), not_(n["nodeKey"].rlike(r"^[a-z0-9]+(?:[-.][a-z0-9]+)*\z"))), (at(".statement"), empty(n["statement"])),
        *_pass_issues(n["score"], at(".score")), (at(".scoreHistory"), F.coalesce(F.size(n["scoreHistory"]) < 1, F.lit(True))), (at(".decision"), of(n["decision"], *T.DECISIONS)),
        (at(".isLeaf"), n["isLeaf"].isNull()), (at(".resolvedFrom"), n["resolvedFrom"].isNotNull() & ~n["resolvedFrom"].isin(SOURCES)),
    ])
    past = t.nodes.select("body_id", n["id"].alias("id"), F.posexplode("n.scoreHistory").alias("i", "p"))
    past = _issues(past, _pass_issues(F.col("p"), F.concat("id", F.lit(".scoreHistory."), "i")))
    ac, where = F.col("ac"), F.concat("node", F.lit(".acceptanceCriteria."), "i")
    acs = _issues(T.criteria(t), [
        (F.concat(where, F.lit(".id")), not_(ac["id"].rlike(r"^AC-[0-9]+\z"))), *[(F.concat(where, F.lit(f".{f}")), empty(ac[f])) for f in ("stakeholder", "given", "when")],
        (F.concat(where, F.lit(".then")), F.coalesce((F.size(ac["then"]) < 1) | F.exists(ac["then"], empty), F.lit(True))),
    ])
    g = F.col("g")
    cited = _issues(T.citations(t), [(F.concat("path", F.lit(f".{f}")), empty(g[f]) if f in ("docId", "quote") else g[f].isNull()) for f in ("source", "docId", "title", "quote", "retrievedAt")])
    c, where = F.col("c"), F.concat(F.lit("clarifications."), "i")
    asked = _issues(clarifications(t), [
        (F.concat(where, F.lit(".id")), not_(c["id"].rlike(r"^CL-[0-9]+\z"))), (F.concat(where, F.lit(".nodeId")), c["nodeId"].isNull()), (F.concat(where, F.lit(".question")), empty(c["question"])),
        (F.concat(where, F.lit(".options")), F.coalesce(F.exists(c["options"], lambda o: not_(o["id"].rlike(r"^OPT-[0-9]+\z")) | empty(o["text"]) | empty(o["implication"])), F.lit(False))),
        (F.concat(where, F.lit(".answeredBy")), c["answeredBy"].isNotNull() & (of(c["answeredBy"]["kind"], "human", "knowledge_base") | empty(c["answeredBy"]["name"]))),
        (F.concat(where, F.lit(".resolvedFrom")), c["resolvedFrom"].isNotNull() & ~c["resolvedFrom"].isin(SOURCES)),
    ])
    r, where = F.col("r"), F.concat(F.lit("residuals."), "i")
    carried = _issues(residuals(t), [
        (F.concat(where, F.lit(".id")), not_(r["id"].rlike(r"^RU-[0-9]+\z"))), (F.concat(where, F.lit(".kind")), of(r["kind"], "ResidualUncertainty", "ResidualRisk", "accepted_complexity")),
        (F.concat(where, F.lit(".nodeId")), r["nodeId"].isNull()), (F.concat(where, F.lit(".statement")), empty(r["statement"])),
        (F.concat(where, F.lit(".acceptedBy")), r["acceptedBy"]["kind"].isNull() | empty(r["acceptedBy"]["name"])), (F.concat(where, F.lit(".acceptedAt")), r["acceptedAt"].isNull()),
    ])
    a, where = F.col("a"), F.concat(F.lit("signoff.approvers."), "i")
    signed = _issues(approvers(t), [(F.concat(where, F.lit(f".{f}")), empty(a[f]) if f == "name" else a[f].isNull()) for f in ("name", "role", "kind", "at")])
    return several(top, found(whole, F.lit("(root)"), F.lit("not a JSON object of a requirement body")), nodes, past, acs, cited, asked, carried, signed)


@rule("SCHEMA-002")
def id_extends_parent(t: Trees) -> DataFrame:
    tail = F.when(n["id"].startswith(F.concat(n["parentId"], F.lit("."))), F.substring(n["id"], F.length(n["parentId"]) + 2, F.length(n["id"])))
    bad = t.nodes.where((F.size("place") > 0) & n["parentId"].isNotNull() & not_(tail.rlike(r"^[1-9][0-9]*\z")))
    return found(bad, at(".id"), say("id ", n["id"], " is not its parent's id ", n["parentId"], " with a dot and a positive number"))


@rule("SCHEMA-003")
def parent_is_real(t: Trees) -> DataFrame:
    root = F.size("place") == 0
    bad = t.nodes.where(F.when(root, n["parentId"].isNotNull()).otherwise(~n["parentId"].eqNullSafe(F.col("parent"))))
    return found(bad, at(".parentId"), F.when(root, say("the root names a parent, ", n["parentId"])).otherwise(say("parent ", n["parentId"], " is named, ", F.col("parent"), " is meant")))


@rule("SCHEMA-004")
def keys_by_kind(t: Trees) -> DataFrame:
    leaf = t.nodes.where((n["decision"] == "leaf") & n["children"].isNotNull())
    branch = t.nodes.where((n["decision"] != "leaf") & n["acceptanceCriteria"].isNotNull())
    return several(
        found(leaf, at(".children"), say("a leaf has a children key, with ", F.size(n["children"]), " entries")),
        found(branch, at(".acceptanceCriteria"), say("a ", n["decision"], " node has a key for criteria, with ", F.size(n["acceptanceCriteria"]), " entries")),
    )


@rule("SCHEMA-005")
def known_decisions(t: Trees) -> DataFrame:
    of = lambda c: say(c, " is not one of ", ", ".join(T.DECISIONS))
    own = t.nodes.where(not_(n["decision"].isin(T.DECISIONS)))
    p = passes(t).where(not_(F.col("p.decision").isin(T.DECISIONS)))
    return several(found(own, at(".decision"), of(n["decision"])), found(p, F.concat("where", F.lit(".decision")), of(F.col("p.decision"))))


@rule("SCHEMA-006")
def root_id(t: Trees) -> DataFrame:
    return found(t.nodes.where((F.size("place") == 0) & ~n["id"].eqNullSafe(F.lit(ROOT))), at(".id"), say("the root is ", n["id"], ", not ", ROOT))


def _repeated(d: DataFrame, key: Column) -> DataFrame:
    """Rows whose key stands earlier in walking order, with ``first``, the row that has it."""
    w = Window.partitionBy("body_id", key).orderBy("place")
    d = d.select("body_id", "place", F.struct(n["id"].alias("id"), n["nodeKey"].alias("nodeKey")).alias("n"))
    return d.withColumns({"first": F.first("n").over(w), "nth": F.row_number().over(w)}).where("nth > 1")


@rule("SCHEMA-007")
def ids_unique(t: Trees) -> DataFrame:
    return found(_repeated(t.nodes, n["id"]), at(".id"), say("id ", n["id"], " of node ", n["nodeKey"], " is also that of ", F.col("first.nodeKey")))


# tree
@rule("TREE-001")
def decision_admissible(t: Trees) -> DataFrame:
    p = n["score"]
    bad = t.nodes.where(T.is_band(p["unknowns"]) & T.is_band(p["complexity"]) & not_(F.array_contains(T.decision_space(p), n["decision"])))
    return found(bad, at(".decision"), say(n["decision"], " at magnitude ", T.magnitude(p).cast("int"), ", zone ", T.zone(T.magnitude(p)), "; admissible: ", F.array_join(T.decision_space(p), ", ")))


@rule("TREE-002")
def decompose_has_children(t: Trees) -> DataFrame:
    count = F.greatest(F.coalesce(F.size(n["children"]), F.lit(0)), F.lit(0))
    return found(t.nodes.where((n["decision"] == "decompose") & (count < 2)), at(".children"), say("decomposed into ", count, ", at least 2 are asked for"))


@rule("TREE-003")
def depth_bounded(t: Trees) -> DataFrame:
    return found(t.nodes.where(F.col("depth") > T.MAX_DEPTH), at(), say("depth ", F.col("depth"), ", at most ", str(T.MAX_DEPTH)))


@rule("TREE-004")
def deepest_branch_is_answered(t: Trees) -> DataFrame:
    open_ = t.nodes.where((F.col("depth") == T.MAX_DEPTH) & not_(n["decision"] == "leaf") & n["residualRef"].isNull())
    asked = clarifications(t).select("body_id", F.col("c.nodeId").alias("asked")).distinct()
    bad = open_.join(asked, (open_["body_id"] == asked["body_id"]) & (F.col("n.id") == F.col("asked")), "left_anti")
    return found(bad, at(), say("a branch at depth ", str(T.MAX_DEPTH), " has neither a clarification nor a residual"))


@rule("TREE-005")
def keys_unique(t: Trees) -> DataFrame:
    return found(_repeated(t.nodes, n["nodeKey"]), at(".nodeKey"), say("key ", n["nodeKey"], " is also that of node ", F.col("first.id")))


@rule("TREE-006", "warning")
def leaves_vary_in_depth(t: Trees) -> DataFrame:
    leaf = n["decision"] == "leaf"
    g = t.nodes.groupBy("body_id").agg(F.count_if(leaf).alias("leaves"), F.countDistinct(F.when(leaf, F.col("depth"))).alias("depths"), F.min(F.when(leaf, F.col("depth"))).alias("depth"), F.min_by(n["id"], "depth").alias("root"))
    return found(g.where("leaves > 1 AND depths = 1"), F.col("root"), say("all ", F.col("leaves"), " leaves are at depth ", F.col("depth")))


@rule("TREE-007")
def has_a_leaf(t: Trees) -> DataFrame:
    g = t.nodes.groupBy("body_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(n["decision"] == "leaf").alias("leaves"))
    return found(g.where("leaves = 0"), F.lit("tree"), say("none of ", F.col("nodes"), " nodes is a leaf"))


# metadata
@rule("META-001")
def updated_after_created(t: Trees) -> DataFrame:
    u, c = F.col("b.metadata.updatedAt"), F.col("b.metadata.createdAt")
    why = F.when(u.isNull(), "updatedAt is absent").when(T.instant(u).isNull(), say("updatedAt ", u, " is no time")).when(T.instant(u) < T.instant(c), say("updated at ", u, ", before it was created at ", c))
    return found(t.bodies.where(F.col("b.metadata").isNotNull()).withColumn("why", why).where("why IS NOT NULL"), F.lit("metadata.updatedAt"), F.col("why"))


def _hedge(d: DataFrame, path: Column) -> DataFrame:
    want = T.holds(F.col("g.quote"), T.HEDGES)
    return found(d.where(F.coalesce(F.col("g.hedged"), F.lit(False)) != want), path, say("generated value is ", want))


@rule("META-002")
def generated_fields(t: Trees) -> DataFrame:
    p = n["score"]
    size = t.nodes.where(~p["magnitude"].eqNullSafe(T.magnitude(p)))
    leaf = t.nodes.where(~n["isLeaf"].eqNullSafe(n["decision"] == "leaf"))
    ac = T.criteria(t).withColumn("want", F.forall("ac.then", T.observable)).where(F.coalesce(F.col("ac.observable"), F.lit(False)) != F.col("want"))
    said = t.bodies.select("body_id", F.explode("b.traceability").alias("ac", "said"))
    trace = said.join(T.traceability(t), ["body_id", "ac"], "full").where(~F.col("said").eqNullSafe(F.col("node")))
    cover = t.bodies.select("body_id", F.explode("b.coverage").alias("field", "said")).join(T.coverage(t), "body_id")
    want = F.element_at("cover", F.col("field"))
    cover = cover.where(~F.col("said").eqNullSafe(want))
    return several(
        found(size, at(".score.magnitude"), say("generated value is ", T.magnitude(p).cast("int"))),
        found(leaf, at(".isLeaf"), say("generated value is ", n["decision"] == "leaf")),
        _hedge(T.citations(t), F.concat("path", F.lit(".hedged"))),
        found(ac, F.concat("node", F.lit(".acceptanceCriteria."), "i", F.lit(".observable")), say("generated value is ", F.col("want"))),
        found(trace, F.concat(F.lit("traceability."), "ac"), say("generated value is ", F.col("node"))),
        found(cover, F.concat(F.lit("coverage."), "field"), say("generated value is ", want.cast("int"))),
    )


@rule("META-003")
def stamps_parse(t: Trees) -> DataFrame:
    pair = lambda path, c: F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), c.alias("at"))
    top = t.bodies.where("b.metadata IS NOT NULL").select("body_id", F.explode(F.array(pair("metadata.createdAt", F.col("b.metadata.createdAt")), pair("metadata.updatedAt", F.col("b.metadata.updatedAt")))).alias("x")).select("body_id", "x.*")
    own = passes(t).select("body_id", F.concat("where", F.lit(".at")).alias("path"), F.col("p.at").alias("at"))
    cited = T.citations(t).select("body_id", F.concat("path", F.lit(".retrievedAt")).alias("path"), F.col("g.retrievedAt").alias("at"))
    answered = clarifications(t).where("c.answeredAt IS NOT NULL").select("body_id", F.concat(F.lit("clarifications."), "i", F.lit(".answeredAt")).alias("path"), F.col("c.answeredAt").alias("at"))
    accepted = residuals(t).select("body_id", F.concat(F.lit("residuals."), "i", F.lit(".acceptedAt")).alias("path"), F.col("r.acceptedAt").alias("at"))
    signed = approvers(t).select("body_id", F.concat(F.lit("signoff.approvers."), "i", F.lit(".at")).alias("path"), F.col("a.at").alias("at"))
    all_ = several(top, own, cited, answered, accepted, signed)
    return found(all_.where(T.instant(F.col("at")).isNull()), F.col("path"), say(F.col("at"), " is no time"))


# scores
@rule("SCORE-001")
def magnitude_is_max(t: Trees) -> DataFrame:
    p = F.col("p")
    return found(passes(t).where(~p["magnitude"].eqNullSafe(T.magnitude(p))), F.concat("where", F.lit(".magnitude")), say("magnitude ", p["magnitude"].cast("int"), ", the larger band is ", T.magnitude(p).cast("int")))


@rule("SCORE-002")
def bands(t: Trees) -> DataFrame:
    bad = lambda f: found(passes(t).where(~T.is_band(F.col("p")[f])), F.concat("where", F.lit(f".{f}")), say(f"{f} ", F.col("p")[f], " is no band"))
    return several(bad("unknowns"), bad("complexity"))


@rule("SCORE-003")
def score_is_last_pass(t: Trees) -> DataFrame:
    h = n["scoreHistory"]
    none = F.coalesce(F.size(h) < 1, F.lit(True))
    bad = t.nodes.where(none | ~n["score"].eqNullSafe(F.get(h, F.size(h) - 1)))
    return found(bad, F.when(none, at(".scoreHistory")).otherwise(at(".score")), F.when(none, "no pass is recorded").otherwise("the score is not the last pass"))


@rule("SCORE-005")
def history_in_order(t: Trees) -> DataFrame:
    s = steps(t).where(T.instant(F.col("p.at")) < T.instant(F.col("before.at")))
    return found(s, F.concat("id", F.lit(".scoreHistory."), "i", F.lit(".at")), say("at ", F.col("p.at"), ", before the pass before it, at ", F.col("before.at")))


@rule("SCORE-006")
def clarifying_lowers_unknowns(t: Trees) -> DataFrame:
    asked = F.filter(n["scoreHistory"], lambda p: p["decision"] == "clarify")
    last = F.get(asked, F.size(asked) - 1)["unknowns"]
    return found(t.nodes.where((n["decision"] == "leaf") & (n["score"]["unknowns"] >= last)), at(".score.unknowns"), say("unknowns ", n["score"]["unknowns"].cast("int"), ", not below those of the last clarify pass, ", last.cast("int")))


@rule("UNCERT-001")
def review_leaf_has_residual(t: Trees) -> DataFrame:
    leaves = t.nodes.where((T.zone(T.magnitude(n["score"])) == "review") & (n["decision"] == "leaf"))
    known = residuals(t).select(F.col("body_id").alias("of"), F.col("r.id").alias("ref")).distinct()
    bad = leaves.join(known, (F.col("body_id") == F.col("of")) & (n["residualRef"] == F.col("ref")), "left_anti")
    return found(bad, at(".residualRef"), say("a leaf in review names no residual of the body, but ", n["residualRef"]))


@rule("UNCERT-002")
def residual_by_a_human(t: Trees) -> DataFrame:
    r, where = F.col("r"), F.concat(F.lit("residuals."), "i", F.lit(".acceptedBy"))
    kind = residuals(t).where(not_(r["acceptedBy"]["kind"] == "human"))
    name = residuals(t).where(blank(r["acceptedBy"]["name"]))
    return several(found(kind, F.concat(where, F.lit(".kind")), say(r["id"], " is accepted by kind ", r["acceptedBy"]["kind"])), found(name, F.concat(where, F.lit(".name")), say(r["id"], " is accepted by nobody named")))


@rule("UNCERT-005")
def no_blind_decompose(t: Trees) -> DataFrame:
    p, before = F.col("p"), F.col("before")
    s = steps(t).where((p["decision"] == "decompose") & (p["unknowns"] >= before["unknowns"]) & (p["unknowns"] >= T.CLARIFY_FLOOR))
    return found(s, F.concat("id", F.lit(".scoreHistory."), "i", F.lit(".decision")), say("decomposed with unknowns ", p["unknowns"].cast("int"), ", not below ", before["unknowns"].cast("int")))


# criteria
@rule("AC-001")
def leaf_has_criteria(t: Trees) -> DataFrame:
    return found(t.nodes.where((n["decision"] == "leaf") & F.coalesce(F.size(n["acceptanceCriteria"]) < 1, F.lit(True))), at(".acceptanceCriteria"), F.lit("a leaf without criteria"))


def _ac(*parts) -> Column:
    return F.concat("node", F.lit(".acceptanceCriteria."), "i", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


@rule("AC-002")
def clauses_not_blank(t: Trees) -> DataFrame:
    c = T.criteria(t)
    own = [found(c.where(blank(F.col(f"ac.{f}"))), _ac(f".{f}"), say(F.col("ac.id"), f" has a blank {f}")) for f in ("given", "when")]
    then = c.select("body_id", "node", "i", "ac", F.posexplode("ac.then").alias("k", "then")).where(blank(F.col("then")))
    return several(*own, found(then, _ac(".then.", F.col("k")), say(F.col("ac.id"), " has a blank outcome")))


@rule("AC-003")
def has_outcome(t: Trees) -> DataFrame:
    return found(T.criteria(t).where(F.coalesce(F.size("ac.then") < 1, F.lit(True))), _ac(".then"), say(F.col("ac.id"), " has no outcome"))


@rule("AC-004")
def criterion_ids(t: Trees) -> DataFrame:
    c = T.criteria(t).select("body_id", "place", "node", "i", F.struct("ac.id").alias("ac"))
    w = Window.partitionBy("body_id", "ac.id").orderBy("place", "i")
    twice = c.withColumns({"first": F.first("node").over(w), "nth": F.row_number().over(w)}).where("nth > 1")
    form = c.where(not_(F.col("ac.id").rlike(r"^AC-[0-9]+\z")))
    return several(found(form, _ac(".id"), say(F.col("ac.id"), " is not of the form AC-n")), found(twice, _ac(".id"), say(F.col("ac.id"), " stands already on node ", F.col("first"))))


@rule("AC-005", "warning")
def outcome_observable(t: Trees) -> DataFrame:
    then = T.criteria(t).select("body_id", "node", "i", "ac", F.posexplode("ac.then").alias("k", "then")).where(F.col("then").isNotNull() & ~T.observable(F.col("then")))
    return found(then, _ac(".then.", F.col("k")), say(F.col("ac.id"), " names nothing that a test could read"))


@rule("AC-006")
def stakeholder_named(t: Trees) -> DataFrame:
    return found(T.criteria(t).where(blank(F.col("ac.stakeholder"))), _ac(".stakeholder"), say(F.col("ac.id"), " names no stakeholder"))


# prose
def prose(t: Trees) -> DataFrame:
    """body_id, path, text: everything an author wrote; quotes are not among it. Bodies and nodes are read once each."""
    passed = _together(F.array(_said(at(".statement"), n["statement"]), _said(at(".score.note"), n["score"]["note"])), F.transform(n["scoreHistory"], lambda p, i: _said(at(".scoreHistory.", i, ".note"), p["note"])))
    stated = lambda ac, i: _together(
        F.array(*[_said(at(".acceptanceCriteria.", i, f".{f}"), ac[f]) for f in ("given", "when")]),
        F.transform(ac["then"], lambda x, k: _said(at(".acceptanceCriteria.", i, ".then.", k), x)),
    )
    nodes = t.nodes.select("body_id", _together(passed, F.flatten(F.transform(n["acceptanceCriteria"], stated))).alias("x"))
    return _texts(nodes).unionByName(_texts(t.bodies.select("body_id", _together(F.array(_said(F.lit("metadata.title"), F.col("b.metadata.title"))), _asked(True), _carried(True)).alias("x"))))


def _said(path: Column, text: Column) -> Column:
    return F.struct(path.alias("path"), text.alias("text"))


def _texts(d: DataFrame) -> DataFrame:
    return _listed(d).select("body_id", "x.*").where("text IS NOT NULL")


def _asked(whole: bool) -> Column:
    """What is recorded as decided in clarifications, or all that is written there."""
    under = lambda i, *more: F.concat(F.lit("clarifications."), i.cast("string"), *[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in more])
    option = lambda i: lambda o, k: F.array(*[_said(under(i, ".options.", k, f".{f}"), o[f]) for f in ("text", "implication")])
    detail = lambda c, i: F.array(_said(under(i, ".resultingDetail"), c["resultingDetail"]))
    every = lambda c, i: _together(detail(c, i), F.array(_said(under(i, ".question"), c["question"])), F.flatten(F.transform(c["options"], option(i))))
    return F.flatten(F.transform(F.col("b.clarifications"), every if whole else detail))


def _carried(whole: bool) -> Column:
    """What is recorded as decided in residuals, or all that is written there."""
    fields = ("mitigation", "statement") if whole else ("mitigation",)
    return F.flatten(F.transform(F.col("b.residuals"), lambda r, i: F.array(*[_said(F.concat(F.lit("residuals."), i.cast("string"), F.lit(f".{f}")), r[f]) for f in fields])))


def decided(t: Trees) -> DataFrame:
    """body_id, path, text: what was recorded as decided."""
    return _texts(t.bodies.select("body_id", _together(_asked(False), _carried(False)).alias("x")))


def _defers(d: DataFrame) -> DataFrame:
    return found(d.where(T.holds(F.col("text"), T.DEFERRALS)), F.col("path"), say("defers, by the words ", T.marker(F.col("text"), T.DEFERRALS)))


@rule("DEFER-001")
def no_deferral(t: Trees) -> DataFrame:
    return _defers(prose(t))


@rule("DEFER-002")
def no_deferral_in_decisions(t: Trees) -> DataFrame:
    return _defers(decided(t))


# provenance
@rule("CLARIFY-001")
def clarify_is_recorded(t: Trees) -> DataFrame:
    first = F.array_position(F.transform(n["scoreHistory"], lambda p: F.coalesce(p["decision"], F.lit(""))), "clarify")
    asked = t.nodes.withColumn("first", first).where("first > 0")
    known = clarifications(t).select(F.col("body_id").alias("of"), F.col("c.nodeId").alias("about")).distinct()
    bad = asked.join(known, (F.col("body_id") == F.col("of")) & (n["id"] == F.col("about")), "left_anti")
    return found(bad, at(".scoreHistory.", (F.col("first") - 1).cast("string"), ".decision"), F.lit("a clarify pass without a clarification"))


@rule("CLARIFY-002")
def answered(t: Trees) -> DataFrame:
    a = F.col("c.answer")
    bad = clarifications(t).where(a.isNull() | (blank(a["chosenOptionId"]) & blank(a["freetext"])))
    return found(bad, F.concat(F.lit("clarifications."), "i", F.lit(".answer")), say(F.col("c.id"), " has no answer"))


@rule("CLARIFY-003")
def corpus_answer_is_cited(t: Trees) -> DataFrame:
    bad = clarifications(t).where((F.col("c.answeredBy.kind") == "knowledge_base") & F.coalesce(F.size("c.grounding") < 1, F.lit(True)))
    return found(bad, F.concat(F.lit("clarifications."), "i", F.lit(".grounding")), say(F.col("c.id"), " is answered from the corpus without a citation"))


@rule("CLARIFY-004")
def option_has_implication(t: Trees) -> DataFrame:
    o = clarifications(t).select("body_id", "i", F.posexplode("c.options").alias("k", "o")).where(blank(F.col("o.implication")))
    return found(o, F.concat(F.lit("clarifications."), "i", F.lit(".options."), "k", F.lit(".implication")), say(F.col("o.id"), " says nothing of what it implies"))


@rule("CLARIFY-005")
def quote_is_verbatim(t: Trees, docs: DataFrame | None = None) -> DataFrame:
    """``docs``: doc_id, text. Skipped where there are none."""
    c = T.citations(t)
    if docs is None:
        return found(c.where(F.lit(False)), F.col("path"), F.lit(""))
    cited = c.join(docs.select(F.col("doc_id").alias("cited"), "text"), F.col("g.docId") == F.col("cited"), "left")
    absent = F.col("text").isNull()
    bad = cited.where(absent | ~T.quoted(F.col("text"), F.col("g.quote")))
    return found(bad, F.concat("path", F.when(absent, ".docId").otherwise(".quote")), F.when(absent, say("document ", F.col("g.docId"), " is not there")).otherwise(say("not verbatim in ", F.col("g.docId"))))


@rule("CLARIFY-006", "warning")
def hedged_quote_is_carried(t: Trees) -> DataFrame:
    c = T.citations(t).where(T.holds(F.col("g.quote"), T.HEDGES))
    known = residuals(t).select(F.col("body_id").alias("of"), F.col("r.nodeId").alias("about")).distinct()
    bad = c.join(known, (F.col("body_id") == F.col("of")) & (F.col("node") == F.col("about")), "left_anti")
    return found(bad, F.concat("path", F.lit(".quote")), say("a quote that hedges, and no residual of node ", F.col("node")))


def _trace(t: Trees) -> DataFrame:
    return t.bodies.select("body_id", F.explode("b.traceability").alias("id", "to"))


@rule("TRACE-001")
def criterion_is_traced(t: Trees) -> DataFrame:
    c = T.criteria(t).select("body_id", F.col("ac.id").alias("id"), "node").join(_trace(t), ["body_id", "id"], "left")
    return found(c.where(~F.col("to").eqNullSafe(F.col("node"))), F.concat(F.lit("traceability."), "id"), say(F.col("id"), " of node ", F.col("node"), " is traced to ", F.col("to")))


@rule("TRACE-002")
def traced_node_exists(t: Trees) -> DataFrame:
    ids = t.nodes.select("body_id", n["id"].alias("to")).distinct()
    return found(_trace(t).join(ids, ["body_id", "to"], "left_anti"), F.concat(F.lit("traceability."), "id"), say(F.col("id"), " is traced to ", F.col("to"), ", which the tree has not"))


@rule("TRACE-007")
def reserved(t: Trees) -> DataFrame:
    return found(t.bodies.where(F.lit(False)), F.lit(""), F.lit(""))


# sign-off
@rule("GATE-001")
def result_admissible(t: Trees) -> DataFrame:
    s = F.col("b.signoff")
    return found(t.bodies.where(s.isNotNull() & not_(s["result"].isin(RESULTS))), F.lit("signoff.result"), say("signed off as ", s["result"]))


@rule("GATE-002")
def signed_after_errors(t: Trees) -> DataFrame:
    errors = F.filter("b.analysis.findings", lambda f: f["severity"] == "error")
    return found(t.bodies.where(F.col("b.signoff").isNotNull() & (F.size(errors) > 0)), F.lit("signoff"), say("signed off with ", F.size(errors), " recorded errors"))


@rule("GATE-003")
def roles_present(t: Trees) -> DataFrame:
    held = F.transform("b.signoff.approvers", lambda a: a["role"])
    missing = F.array_except(F.array(*[F.lit(r) for r in ROLES]), F.coalesce(held, F.array().cast("array<string>")))
    return found(t.bodies.where(F.col("b.signoff").isNotNull() & (F.size(missing) > 0)), F.lit("signoff.approvers"), say("not signed by ", F.array_join(missing, ", ")))


@rule("GATE-006")
def approvers_human(t: Trees) -> DataFrame:
    return found(approvers(t).where(not_(F.col("a.kind") == "human")), F.concat(F.lit("signoff.approvers."), "i", F.lit(".kind")), say(F.col("a.name"), " signed as kind ", F.col("a.kind")))


def run(name: str, t: Trees, docs: DataFrame | None = None) -> DataFrame:
    """body_id, rule, severity, path and message of one rule's findings."""
    severity, f = RULES[name]
    out = f(t, docs) if name == "CLARIFY-005" else f(t)
    return out.select("body_id", F.lit(name).alias("rule"), F.lit(severity).alias("severity"), "path", "message")


def analyse(bodies: DataFrame, docs: DataFrame | None = None, lint: bool = False) -> DataFrame:
    """All findings. A body that does not parse has only those of SCHEMA-001; ``lint`` makes the gates' findings warnings."""
    t = T.read(bodies)
    t = Trees(written(t.bodies, "bodies"), written(t.nodes, "nodes"))  # read once, for all rules
    parse = written(run("SCHEMA-001", t), "unparsed")
    rest = several(*[run(r, t, docs) for r in RULES if r != "SCHEMA-001"])
    out = parse.unionByName(rest.join(parse.select("body_id").distinct(), "body_id", "left_anti"))
    return out.withColumn("severity", F.when(F.col("rule").startswith("GATE-"), "warning").otherwise(F.col("severity"))) if lint else out


def verdicts(bodies: DataFrame, docs: DataFrame | None = None, lint: bool = False) -> DataFrame:
    """body_id, errors, warnings, checks_run and ok."""
    f = analyse(bodies, docs, lint).groupBy("body_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.max(F.col("rule") == "SCHEMA-001").alias("broken"))
    every = len(RULES) - (docs is None)
    return bodies.select("body_id").join(f, "body_id", "left").select(
        "body_id", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"),
        F.when(F.col("broken"), 1).otherwise(every).alias("checks_run"), (F.coalesce("errors", F.lit(0)) == 0).alias("ok"))


def assembled_fields(t: Trees) -> DataFrame:
    """body_id, id, magnitude, zone, is_leaf and recommended: what is generated for each node."""
    h, p = n["scoreHistory"], n["score"]
    before = F.get(h, F.size(h) - 2)["unknowns"]
    return t.nodes.select("body_id", n["id"].alias("id"), T.magnitude(p).cast("int").alias("magnitude"), T.zone(T.magnitude(p)).alias("zone"), (n["decision"] == "leaf").alias("is_leaf"), T.recommended(p, before).alias("recommended"))
