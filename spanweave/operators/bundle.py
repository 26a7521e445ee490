"""Evidence packages: the nodes that roots reach, the links among them, every objection, and why each is there."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.operators.graph import adjacency, among, reach, touching
from spanweave.session import materialize


@dataclass(frozen=True)
class Bundle:
    """nodes: node, depth (null: taken in as an objection), reason, walk (links on the way). links: id,
    predicate, src, dst, supports, opposes, derived. ``partial``: a budget cut the walk."""

    roots: DataFrame
    nodes: DataFrame
    links: DataFrame
    partial: bool = False
    method: str = ""
    snapshot: str = ""
    notes: tuple[str, ...] = field(default=())

    @property
    def grounded(self) -> bool:
        """Whether the package holds any relation."""
        return not self.links.isEmpty()


def expand(links: DataFrame, roots: DataFrame, depth: int = 2, limit: int = 200, follow: list[str] | None = None, supports: tuple[str, ...] = (), opposes: tuple[str, ...] = (), reasons: DataFrame | None = None, onto=None, derived: DataFrame | None = None, method: str = "expand", snapshot: str = "") -> Bundle:
    """The package around ``roots`` (node).

    Links of ``follow`` (none: all) are walked both ways; with an ontology, names take in all that lies
    under them. Every link among the nodes held is in the package, walked or not. Links that oppose and
    touch the package are taken in with their ends, whatever the budget. ``reasons``: node, reason.
    ``derived``: links with the same columns that nobody claimed; they are walked like the others, marked.
    """
    widen = onto.widen if onto is not None else lambda names: list(names)
    follow, supports, opposes = widen(follow or []), widen(list(supports)), widen(list(opposes))
    plain = links.select("id", "predicate", "src", "dst").withColumn("derived", F.lit(False))
    if derived is not None:
        plain = plain.unionByName(derived.select("id", "predicate", "src", "dst").withColumn("derived", F.lit(True)))
    if follow:
        plain = plain.where(F.col("predicate").isin(*follow))
    plain = materialize(plain, "package-links")  # written once, as links; their two readings are twice as large
    found, partial = reach(adjacency(plain), roots, depth, limit, written=True)
    walk = F.slice("links", 2, F.greatest(F.size("links") - 1, F.lit(0)))
    held = materialize(found.select("node", "depth", walk.alias("walk")), "held")
    is_one = lambda names: F.col("predicate").isin(*names) if names else F.lit(False)
    inside = among(plain, held)
    nodes, kept = held.withColumn("forced", F.lit(None).cast("string")), inside
    if opposes:
        against = materialize(touching(plain.where(is_one(opposes)), held), "objections")
        ends = against.select(F.col("src").alias("node"), "predicate").union(against.select("dst", "predicate"))
        new = ends.join(held.select("node"), "node", "left_anti").groupBy("node").agg(F.min("predicate").alias("p"))
        extra = new.select("node", F.lit(None).cast("int").alias("depth"), F.array().cast("array<string>").alias("walk"), F.concat(F.lit("opposing "), "p").alias("forced"))
        nodes, kept = nodes.unionByName(extra), inside.unionByName(against).dropDuplicates(["id"])
    given = reasons.groupBy("node").agg(F.first("reason").alias("given")) if reasons is not None else None
    nodes = nodes.join(given, "node", "left") if given is not None else nodes.withColumn("given", F.lit(None).cast("string"))
    nodes = nodes.select("node", "depth", F.coalesce("forced", "given").alias("reason"), "walk")
    kept = kept.withColumns({"supports": is_one(supports), "opposes": is_one(opposes)})
    return Bundle(roots.select("node").distinct(), nodes, kept, partial, method, snapshot)


def annotate(made: Bundle, said: DataFrame, notes: tuple[str, ...] = ()) -> Bundle:
    """The package with what a later step said of nodes (node, said) after the reason that is there."""
    each = said.where("said <> ''").groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("said")), "; ").alias("said"))
    joined = made.nodes.join(each, "node", "left")
    reason = F.nullif(F.concat_ws("; ", "reason", "said"), F.lit(""))
    return replace(made, nodes=joined.select("node", "depth", reason.alias("reason"), "walk"), notes=(*made.notes, *filter(None, notes)))


def mark(made: Bundle, typings: DataFrame) -> Bundle:
    """The package with the classes that the ontology makes its nodes (id, type), as inferred."""
    names = typings.select(F.col("id").alias("node"), "type").groupBy("node").agg(F.array_sort(F.collect_set("type")).alias("names"))
    return annotate(made, names.select("node", F.concat(F.lit("inferred to be "), F.array_join("names", ", ")).alias("said")))


def expand_entailed(links: DataFrame, roots: DataFrame, entailed: dict, **options) -> Bundle:
    """``expand`` over told links and those of ``reason.entail``, marked."""
    return mark(expand(links, roots, derived=entailed["links"], method="expand_entailed", **options), entailed["typings"])


def omitted_sides(made: Bundle, cited: DataFrame) -> list[str]:
    """The sides (opposing, supporting) of a package of both that no cited node (node) is an end of."""
    ends = made.links.select("id", "supports", "opposes", F.explode(F.array("src", "dst")).alias("node"))
    reached = ends.join(cited.select("node").distinct(), "node", "left_semi")
    there, seen = (d.agg(F.max("supports").alias("supporting"), F.max("opposes").alias("opposing")).first() for d in (made.links, reached))
    if not (there["supporting"] and there["opposing"]):
        return []
    return [s for s in ("opposing", "supporting") if not seen[s]]


def review(made: Bundle, refs: DataFrame, citations: DataFrame) -> dict:
    """Whether an answer holds: ``unknown`` citations, ``omitted`` sides, ``partial``. refs: node, ref; citations: ref."""
    asked = citations.select("ref").distinct()
    known = refs.join(made.nodes.select("node"), "node", "left_semi")
    unknown = asked.join(known.select("ref"), "ref", "left_anti")
    return {"unknown": unknown, "omitted": omitted_sides(made, known.join(asked, "ref").select("node")), "partial": made.partial}
