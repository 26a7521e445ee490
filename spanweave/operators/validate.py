"""Closed-world checks over nodes and links; each finding is a row."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions.text import fold, normalise
from spanweave.plans.ontology import Ontology
from spanweave.session import materialize


def undeclared_fields(nodes: DataFrame, declared: DataFrame) -> DataFrame:
    """(id, field) of fields that the node's type does not declare (type, field)."""
    each = nodes.select("id", "type", F.explode(F.map_keys("fields")).alias("field"))
    return each.join(F.broadcast(declared), ["type", "field"], "left_anti").select("id", "field")  # a schema table


def unknown_types(nodes: DataFrame, onto: Ontology) -> DataFrame:
    return nodes.where(~F.col("type").isin(*sorted(onto.classes))).select("id", "type")


def signature_findings(links: DataFrame, nodes: DataFrame, onto: Ontology) -> DataFrame:
    """(id, finding): unknown predicate, or an end outside domain or range with all classes below them."""
    spark = links.sparkSession
    kinds = nodes.select(F.col("id"), "type")
    ends = links.join(kinds.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src", "left").join(kinds.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst", "left")
    allowed = [(p, side, t) for side, axioms in (("src", onto.domains), ("dst", onto.ranges)) for p, c in axioms for t in onto.subclasses_of(c)]
    known = sorted({p for p, _ in onto.domains | onto.ranges})
    table = F.broadcast(spark.createDataFrame(allowed, "predicate string, side string, kind string"))
    unknown = links.where(~F.col("predicate").isin(*known)).select("id", F.lit("unknown predicate").alias("finding"))
    out = unknown
    for side, word in (("src", "domain"), ("dst", "range")):
        ours = [p for p, s, _ in allowed if s == side]
        bad = ends.where(F.col("predicate").isin(*ours)).join(table.where(F.col("side") == side).select("predicate", F.col("kind").alias(f"{side}_type")), ["predicate", f"{side}_type"], "left_anti")
        out = out.unionByName(bad.select("id", F.lit(word).alias("finding")))
    return out


def cardinality_findings(nodes: DataFrame, links: DataFrame, kind: str, predicate: str, at_least: int = 0, at_most: int | None = None) -> DataFrame:
    """(id, n) of nodes of a type with too few or too many links of a predicate."""
    counted = links.where(F.col("predicate") == predicate).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    each = nodes.where(F.col("type") == kind).select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    return each.where((F.col("n") < at_least) | (F.col("n") > at_most if at_most is not None else F.lit(False)))


def cycles(links: DataFrame, predicate: str, at_once: int = 200_000) -> DataFrame:
    """Nodes that lie on a cycle of the predicate's links: those of strong components, and self links.

    Links from nodes without predecessors, or to nodes without successors, are peeled until none is left.
    What stays is parted: each node takes the greatest node that leads to it, to the fixpoint; the nodes
    that reach back to that one through nodes of the same label are its strong component and go; the rest
    is peeled again. Once at most ``at_once`` links are left, the driver finds their strong components;
    the result is the same. All loops end by themselves.
    """
    now = materialize(links.where(F.col("predicate") == predicate).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "cycle")
    found = materialize(now.where("a = b").select(F.col("a").alias("node")).distinct(), "on-cycle")
    now, n = now.where("a <> b"), None
    while True:
        while (left := now.count()) != n and left > at_once:
            kept = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b")
            kept = kept.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
            now, n = materialize(kept, "peeled"), left
        if left <= at_once:
            rows = _strong([(r["a"], r["b"]) for r in now.collect()])  # at_once links
            return found.union(links.sparkSession.createDataFrame([(x,) for x in rows], found.schema)).distinct()
        label = _fixpoint(now)
        inside = label.select(F.col("node").alias("a"), F.col("top").alias("top")).join(now, "a").join(label.select(F.col("node").alias("b"), F.col("top").alias("same")), "b").where("top = same").select("a", "b")
        inside = materialize(inside, "same-label")
        component = front = materialize(label.where("node = top").select("node"), "component")
        while not front.isEmpty():
            more = inside.join(front.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node")).distinct().join(component, "node", "left_anti")
            front = materialize(more, "component-new")
            component = component.union(front)
        component = materialize(component, "component")
        on = inside.join(component.select(F.col("node").alias("a")), "a", "left_semi").join(component.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node"))
        found = materialize(found.union(on.distinct()), "on-cycle")
        without = now.join(component.select(F.col("node").alias("a")), "a", "left_anti").join(component.select(F.col("node").alias("b")), "b", "left_anti")
        now, n = materialize(without.select("a", "b"), "cycle"), None


def _strong(edges: list[tuple]) -> list:
    """The nodes of strong components of more than one node, by two passes of depth-first search."""
    ahead, behind = defaultdict(list), defaultdict(list)
    for a, b in edges:
        ahead[a].append(b)
        behind[b].append(a)
    done, seen = [], set()
    for start in list(ahead):
        stack = [(start, iter(ahead[start]))] if start not in seen else []
        seen.add(start)
        while stack:
            node, rest = stack[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                done.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(ahead.get(step, ()))))
    out, seen = [], set()
    for start in reversed(done):
        group, todo = [], [start] if start not in seen else []
        seen.add(start)
        while todo:
            node = todo.pop()
            group.append(node)
            new = [x for x in behind.get(node, ()) if x not in seen]
            seen.update(new)
            todo += set(new)
        out += group if len(group) > 1 else []
    return out


def _fixpoint(now: DataFrame) -> DataFrame:
    """(node, top): the greatest node that leads to each, itself included."""
    label = materialize(now.select(F.col("a").alias("node")).union(now.select("b")).distinct().withColumn("top", F.col("node")), "label")
    while True:
        come = now.join(label.select(F.col("node").alias("a"), "top"), "a").groupBy(F.col("b").alias("node")).agg(F.max("top").alias("new"))
        new = materialize(label.join(come, "node", "left").select("node", F.greatest("top", F.coalesce("new", "top")).alias("top"), (F.col("new") > F.col("top")).alias("moved")), "label")
        label = new.select("node", "top")
        if new.where("moved").isEmpty():
            return label


def critique(nodes: DataFrame, onto: Ontology, name_field: str = "name", least_quote: int = 12, grounded: tuple[str, ...] = (), negations: tuple[str, ...] = ()) -> DataFrame:
    """(id, finding, detail): untyped, unnamed, thin, ungrounded, negation.

    nodes: id, type, fields, quote (a node's quotes, joined by blanks). untyped: the ontology lacks the
    type; else unnamed: nothing fills the naming field, or it reads as the type. thin: the normalised
    quote has fewer than ``least_quote`` characters. ungrounded: the value of a field of ``grounded`` is
    not in the quote, both folded; detail is the field. negation: the quote has a marker of ``negations``,
    words of the caller's language; detail is the marker.
    """
    quote = F.lower(fold(F.coalesce("quote", F.lit(""))))
    known = F.coalesce(F.col("type").isin(*sorted(onto.classes)), F.lit(False))
    name = F.coalesce(F.try_element_at("fields", F.lit(name_field)), F.lit(""))
    one = lambda test, finding, detail="": F.when(test, F.struct(F.lit(finding).alias("finding"), F.lit(detail).alias("detail")))
    value = lambda f: F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit(""))
    found = F.array(
        one(~known, "untyped"),
        one(known & ((normalise(name) == "") | (name == F.col("type"))), "unnamed"),
        one(F.length(normalise(F.coalesce("quote", F.lit("")))) < least_quote, "thin"),
        *[one((value(f) != "") & ~quote.contains(F.lower(fold(value(f)))), "ungrounded", f) for f in grounded],
        *[one(quote.contains(m.lower()), "negation", m) for m in negations],
    )
    return nodes.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("id", "f.finding", "f.detail")


def repairable(findings: DataFrame) -> DataFrame:
    """Findings that reading the source again could mend."""
    return findings.where(F.col("finding").isin("unnamed", "thin", "ungrounded"))


@dataclass(frozen=True)
class Shape:
    """What holds for every node of a class, or else is a finding of a severity (violation or warning).

    ``path``: a link's predicate, or a field's name with ``field``. Counts, the class at the far end, the
    least length of a field's value, and ``closed``: no fields but the declared.
    """

    target: str
    path: str = ""
    field: bool = False
    at_least: int = 0
    at_most: int | None = None
    cls: str = ""
    min_length: int = 0
    closed: bool = False
    severity: str = "violation"


def shape_findings(nodes: DataFrame, links: DataFrame, shapes: list[Shape], onto: Ontology, context: DataFrame | None = None) -> DataFrame:
    """(id, finding, path, severity): minCount, maxCount, class, minLength, closed.

    ``context``: nodes (id, type) that are stored already; links may end there, but they are not judged.
    """
    ends = nodes.select("id", "type")
    ends = ends.unionByName(context.select("id", "type")).dropDuplicates(["id"]) if context is not None else ends
    out = [nodes.select("id", F.lit("").alias("finding"), F.lit("").alias("path"), F.lit("").alias("severity")).where("false")]
    for s in shapes:
        mine = nodes.where(F.col("type").isin(*sorted(onto.subclasses_of(s.target))))
        found = lambda d, what: out.append(d.select("id", F.lit(what).alias("finding"), F.lit(s.path).alias("path"), F.lit(s.severity).alias("severity")))  # noqa: E731, B023
        if s.closed:
            rows = [(c, f) for c in onto.subclasses_of(s.target) for f in onto.declared_fields(c)]
            declared = mine.sparkSession.createDataFrame(rows, "type string, field string")
            found(undeclared_fields(mine, declared).select("id").distinct(), "closed")
        if s.field:
            value = F.coalesce(F.try_element_at("fields", F.lit(s.path)), F.lit(""))
            if s.at_least:
                found(mine.where(value == ""), "minCount")
            if s.min_length:
                found(mine.where((value != "") & (F.length(value) < s.min_length)), "minLength")
        elif s.path:
            over = links.where(F.col("predicate").isin(*onto.widen([s.path])))
            if s.at_least or s.at_most is not None:
                n = mine.select("id").join(over.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
                found(n.where(F.col("n") < s.at_least), "minCount")
                if s.at_most is not None:
                    found(n.where(F.col("n") > s.at_most), "maxCount")
            if s.cls:
                far = over.join(mine.select(F.col("id").alias("src")), "src", "left_semi").join(ends.select(F.col("id").alias("dst"), "type"), "dst", "left")
                found(far.where(~F.coalesce(F.col("type").isin(*sorted(onto.subclasses_of(s.cls))), F.lit(False))).select(F.col("src").alias("id")).distinct(), "class")
    return reduce(DataFrame.unionByName, out)


def shacl_validate(nodes: DataFrame, links: DataFrame, shapes: list[Shape], onto: Ontology, context: DataFrame | None = None) -> dict[str, DataFrame]:
    """findings, and the nodes and links that stay: a violation takes its node and all links that touch it."""
    findings = materialize(shape_findings(nodes, links, shapes, onto, context), "shapes")
    refused = findings.where("severity = 'violation'").select("id").distinct()
    kept = nodes.join(refused, "id", "left_anti")
    stay = links.join(refused.select(F.col("id").alias("src")), "src", "left_anti").join(refused.select(F.col("id").alias("dst")), "dst", "left_anti")
    return {"findings": findings, "nodes": kept, "links": stay.select(links.columns)}
