"""More registered steps: those over evidence packages, rankings, shapes, registries and renderings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from spanweave.operators import bundle, evidence, graph, rank, validate
from spanweave.operators.locate import ref
from spanweave.pipeline import ExpandOptions, Nothing, State, implied, register
from spanweave.plans.ontology import inspect
from spanweave.sources import store as stores


def _named(state: State, kind: str):
    """Nodes of a class and all below it."""
    onto = state["schema"]
    return state["store"].nodes().where(F.col("type").isin(*sorted(onto.subclasses_of(kind)) if onto else [kind]))


def _conditions(state: State, names: tuple[str, ...], fields: tuple[str, ...]):
    """(id, conditions): a node's own fields of these names, then those of what such links lead to."""
    nodes = state["store"].nodes().select("id", "fields")
    follow = state["schema"].widen(list(names)) if state["schema"] is not None and names else list(names)
    links = implied(state)
    links = links.where(F.col("predicate").isin(*follow)) if follow else links
    theirs = links.join(nodes.select(F.col("id").alias("dst"), "fields"), "dst").select(F.col("src").alias("id"), F.explode("fields").alias("k", "v"), F.lit(1).alias("far"), F.col("dst").alias("by"))
    mine = nodes.select("id", F.explode(F.map_filter("fields", lambda k, _: k.isin(*fields)) if fields else F.map_filter("fields", lambda k, _: F.lit(False))).alias("k", "v"), F.lit(0).alias("far"), F.lit("").alias("by"))
    first = mine.unionByName(theirs).where("v <> ''").groupBy("id", "k").agg(F.min_by("v", F.struct("far", "by")).alias("v"))
    return first.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("conditions"))


@dataclass(frozen=True)
class CompareOptions:
    type: str = "StudyResult"
    conditions: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    comparable: tuple[str, ...] = ()
    value_field: str = "value"
    unit_field: str = "unit"
    units: dict | None = None


@register("compare", ("bundle", "store"), ("comparisons", "bundle"), CompareOptions)
def compare(state: State, o: CompareOptions) -> State:
    """The package's results against the first of them; ``units``: "from:to" to a factor."""
    held = _named(state, o.type).join(state["bundle"].nodes.select(F.col("node").alias("id")), "id", "left_semi")
    value = lambda f: F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit(""))
    rows = held.join(_conditions(state, o.conditions, o.fields), "id", "left").select("id", F.coalesce("conditions", F.create_map().cast("map<string,string>")).alias("conditions"), value(o.value_field).alias("value"), value(o.unit_field).alias("unit"))
    factors = [(*k.split(":"), v) for k, v in (o.units or {}).items()]
    asserted = None
    if o.comparable:
        ends = implied(state).where(F.col("predicate").isin(*o.conditions)) if o.conditions else implied(state)
        asserted = evidence.asserted_comparable(ends.select(F.col("src").alias("id"), F.col("dst").alias("condition")), implied(state), list(o.comparable))
    found = evidence.compare(rows, rows.orderBy("id").limit(1), factors, asserted)
    said = found.select(F.col("id").alias("node"), F.concat("verdict", F.lit(" against the baseline: "), "reason").alias("said"))
    return {"comparisons": found, "bundle": bundle.annotate(state["bundle"], said)}


@dataclass(frozen=True)
class ReconcileOptions:
    supports: tuple[str, ...] = ("supports",)
    opposes: tuple[str, ...] = ("disputes",)
    conditions: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()


@register("reconcile", ("bundle", "store"), ("conflicts", "bundle"), ReconcileOptions)
def reconcile(state: State, o: ReconcileOptions) -> State:
    links = state["bundle"].links
    nodes = state["store"].nodes().select("id", F.element_at("spans", 1)["source_id"].alias("source_id"), F.element_at("spans", 1)["text"].alias("quote"))
    facts = nodes.join(_conditions(state, o.conditions, o.fields), "id", "left")
    side = lambda names: links.where(F.col("predicate").isin(*names)).select(F.col("dst").alias("about"), F.col("src").alias("id")).join(facts, "id", "left").withColumn("conditions", F.coalesce("conditions", F.create_map().cast("map<string,string>")))
    found = evidence.reconcile(side(o.supports), side(o.opposes))
    told = lambda one, other: found.select(F.col(one).alias("node"), F.concat("verdict", F.lit(" with the position "), other, F.lit(" takes: "), "reason").alias("said"))
    return {"conflicts": found, "bundle": bundle.annotate(state["bundle"], told("supporting", "opposing").union(told("opposing", "supporting")))}


@dataclass(frozen=True)
class AlignOptions:
    plan: str = "PlannedStep"
    run: str = "ActualStep"
    order_field: str = "order"
    name_field: str = "name"
    asserted: tuple[str, ...] = ()
    threshold: float = 0.5


@register("align", ("store",), ("alignment",), AlignOptions)
def align(state: State, o: AlignOptions) -> State:
    steps = lambda kind: _named(state, kind).select("id", F.lit(0).alias("plan"), F.expr(f"try_cast(fields['{o.order_field}'] as long)").alias("nth"), F.try_element_at("fields", F.lit(o.name_field)).alias("label"))
    planned, actual = steps(o.plan), steps(o.run)
    told = None
    if o.asserted:
        pairs = implied(state).where(F.col("predicate").isin(*o.asserted))
        told = pairs.join(actual.select(F.col("id").alias("src"), F.col("nth").alias("actual")), "src").join(planned.select(F.col("id").alias("dst"), F.col("nth").alias("planned"), "plan"), "dst").select("plan", "planned", "actual")
    return {"alignment": evidence.align(planned.drop("id"), actual.drop("id"), o.threshold, told)}


@dataclass(frozen=True)
class FederateOptions:
    registries: dict | None = None
    versions: tuple[str, ...] = ()


@register("federate", (), ("synced", "held", "origins"), FederateOptions)
def federate(state: State, o: FederateOptions) -> State:
    opened = {k: stores.open_store(state["spark"], v) if isinstance(v, str) else v for k, v in (o.registries or {}).items()}
    made = stores.federate(state["spark"], opened, o.versions)
    return {"synced": made["assertions"], "held": made["held"], "origins": made["origins"]}


@register("count_independence", ("bundle", "store", "origins"), ("independence",))
def count_independence(state: State, o: Nothing) -> State:
    held = state["store"].nodes().join(state["bundle"].nodes.select(F.col("node").alias("id")), "id", "left_semi")
    claims = held.select(F.col("id").alias("node"), F.element_at("spans", 1)["source_id"].alias("source_id")).join(state["origins"].select(F.col("target_id").alias("node"), F.explode("registries").alias("registry")), "node", "left")
    return {"independence": evidence.independence(claims, state.get("identities"))}


@dataclass(frozen=True)
class PathOptions:
    depth: int = 3
    candidates: int = 60
    keep: int = 8
    decay: float = 0.8
    weights: dict | None = None
    opposes: tuple[str, ...] = ("disputes",)


@register("select_paths", ("store", "hits"), ("paths",), PathOptions)
def select_paths(state: State, o: PathOptions) -> State:
    """The best chains between any two hits; hits are a ranking's few."""
    hits = state["hits"].select("node").distinct()
    ends = hits.select(F.col("node").alias("src")).join(F.broadcast(hits.select(F.col("node").alias("dst"))), F.col("src") < F.col("dst"))  # a ranking's limit
    found = graph.walks(graph.adjacency(implied(state)), ends, o.depth, o.candidates)
    return {"paths": graph.path_flow(found, o.weights or {}, o.decay, o.keep, o.opposes)}


@dataclass(frozen=True)
class SubgraphOptions:
    cost: float = 0.3
    limit: int = 40


@register("select_subgraph", ("store", "hits"), ("selection", "bundle"), SubgraphOptions)
def select_subgraph(state: State, o: SubgraphOptions) -> State:
    chosen = graph.select_subgraph(implied(state), state["hits"], o.cost, o.limit)
    why = chosen.select("node", F.format_string("selected, prize %.3f", "prize").alias("reason"))
    return {"selection": chosen, "bundle": bundle.expand(implied(state), chosen, 1, reasons=why, onto=state["schema"], method="select_subgraph")}


@register("graph_expand_entailed", ("store", "hits", "derived"), ("bundle",), ExpandOptions)
def graph_expand_entailed(state: State, o: ExpandOptions) -> State:
    made = {"links": state["derived"], "typings": state["typings"]}
    links = state["store"].links().select("id", "predicate", "src", "dst")
    return {"bundle": bundle.expand_entailed(links, state["hits"], made, depth=o.depth, limit=o.limit, follow=list(o.follow), supports=o.supports, opposes=o.opposes, onto=state["schema"])}


@register("check_answer", ("bundle", "citations", "store"), ("review",))
def check_answer(state: State, o: Nothing) -> State:
    nodes = state["store"].nodes()
    refs = nodes.select(F.col("id").alias("node"), ref(F.element_at("spans", 1)["source_id"], F.col("id")).alias("ref"))
    return {"review": bundle.review(state["bundle"], refs, state["citations"])}


@dataclass(frozen=True)
class ShapeOptions:
    shapes: tuple = ()


@register("shacl_validate", ("nodes", "links", "schema"), ("nodes", "links", "findings"), ShapeOptions)
def shacl_validate(state: State, o: ShapeOptions) -> State:
    stored = state["store"].nodes().select("id", "type") if "store" in state else None
    made = validate.shacl_validate(state["nodes"], state["links"], [validate.Shape(**s) for s in o.shapes], state["schema"], stored)
    return {"nodes": made["nodes"], "links": made["links"], "findings": made["findings"]}


@dataclass(frozen=True)
class GateOptions:
    budget: int = 2000
    strict: bool = True
    profile: str = ""


@register("formal_check", ("schema",), ("problems", "unchecked"), GateOptions)
def formal_check(state: State, o: GateOptions) -> State:
    problems, unchecked = inspect(state["schema"], o.budget, o.profile)
    if o.strict and (problems or unchecked):
        raise ValueError(f"the ontology does not pass the formal gate: {problems[:5]} {unchecked}")
    return {"problems": problems, "unchecked": unchecked}


@dataclass(frozen=True)
class InduceOptions:
    similarity: float = 0.6


@register("induce", ("statements", "schema"), ("candidates",), InduceOptions)
def induce(state: State, o: InduceOptions) -> State:
    """Pools of the types that the ontology lacks; ``pool`` in the state holds earlier rounds."""
    rows = state["statements"].where(~F.col("type").isin(*sorted(state["schema"].classes)))
    found = evidence.pooled_labels(rows.select(F.col("id").alias("seq"), F.col("type").alias("label"), "source_id"), o.similarity)
    none = state["spark"].createDataFrame([], "term string, families array<string>, rounds int, definition string")
    return {"candidates": evidence.merged_rounds(found, state.get("pool", none))}


@dataclass(frozen=True)
class PromoteOptions:
    min_support: int = 3
    min_rounds: int = 2
    reuse: float = 0.75
    require_definition: bool = True


@register("promote", ("candidates", "schema"), ("promoted", "refused"), PromoteOptions)
def promote(state: State, o: PromoteOptions) -> State:
    made = evidence.promote(state["candidates"], sorted(state["schema"].classes), o.min_support, o.min_rounds, o.reuse, o.require_definition)
    return {"promoted": made.where("refused IS NULL"), "refused": made.where("refused IS NOT NULL")}


@dataclass(frozen=True)
class CommunityOptions:
    min_size: int = 1
    terms: int = 8


@register("communities", ("store", "index"), ("communities",), CommunityOptions)
def communities(state: State, o: CommunityOptions) -> State:
    """node, community of the graph; with a summary a community in ``topics``."""
    return {"communities": graph.communities(implied(state), o.min_size)}


@register("topics", ("store", "index", "communities"), ("topics",), CommunityOptions)
def topics(state: State, o: CommunityOptions) -> State:
    """community, members, kinds, coverage, terms."""
    groups, nodes = state["communities"], state["store"].nodes()
    total = nodes.count()
    kinds = groups.join(nodes.select(F.col("id").alias("node"), "type"), "node").groupBy("community").agg(F.count("*").alias("members"), F.array_sort(F.collect_set("type")).alias("kinds"))
    top = rank.topic_terms(state["index"], groups.select("node", F.col("community").alias("topic")), o.terms).groupBy(F.col("topic").alias("community")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    return {"topics": kinds.join(top, "community", "left").withColumn("coverage", F.round(F.col("members") / max(total, 1), 4))}


@register("mark_units", ("bundle", "units"), ("bundle",))
def mark_units(state: State, o: Nothing) -> State:
    said = state["units"].select(F.col("id").alias("node"), F.concat_ws(", ", F.concat(F.lit("read as "), "profile"), "reason").alias("said"))
    return {"bundle": bundle.annotate(state["bundle"], said)}


@dataclass(frozen=True)
class MarkdownOptions:
    out: str = ""


@register("render_markdown", ("store",), ("pages",), MarkdownOptions)
def render_markdown(state: State, o: MarkdownOptions) -> State:
    pages = stores.to_markdown(state["store"].sources(), state["store"].segments())
    if o.out:
        pages.write.mode("overwrite").parquet(o.out)
    return {"pages": pages}


@register("ingest_markdown", ("pages",), ("sources", "segments"))
def ingest_markdown(state: State, o: Nothing) -> State:
    sources, segments = stores.from_markdown(state["pages"])
    if "store" in state:
        state["store"].add_sources(sources, segments)
    return {"sources": sources, "segments": segments}
