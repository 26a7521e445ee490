"""Chains of named steps over a state, from a configuration file; ``python -m spanweave`` runs them.

A step is a function of the state and its options that returns what it adds. It is registered under a name
with the keys that it reads and adds; its options are a dataclass, checked when the file is read. A chain
in which a step reads what only a later one adds is refused before anything runs.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, fields, is_dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions.text import keep_cited
from spanweave.operators import bundle, evidence, graph, locate, mapping, rank, validate
from spanweave.plans import conjunctive, plan, reason
from spanweave.plans.ontology import Ontology
from spanweave.session import build_session
from spanweave.sources import ontology, readers
from spanweave.sources.store import Store, open_store

State = dict
SEEDED = ("spark", "inputs", "schema", "version", "at", "store")


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable
    requires: tuple[str, ...]
    produces: tuple[str, ...]
    options: type

    def configure(self, given: dict | None):
        known = {f.name for f in fields(self.options)}
        if unknown := sorted(set(given or {}) - known):
            raise ValueError(f"step '{self.name}' has no options {unknown}; it has {sorted(known)}")
        return self.options(**{k: tuple(v) if isinstance(v, list) else v for k, v in (given or {}).items()})


@dataclass(frozen=True)
class Nothing:
    """No options."""


STEPS: dict[str, Step] = {}


def register(name: str, requires: tuple[str, ...] = (), produces: tuple[str, ...] = (), options: type = Nothing, replace: bool = False):
    """Registers a step; a name stands for one function unless ``replace`` says otherwise."""
    if not is_dataclass(options):
        raise TypeError("options are a dataclass")

    def add(f):
        if name in STEPS and not replace:
            raise ValueError(f"step '{name}' is registered already")
        STEPS[name] = Step(name, f, tuple(requires), tuple(produces), options)
        return f

    return add


def get(name: str) -> Step:
    _load()
    if name not in STEPS:
        raise ValueError(f"unknown step '{name}'; there are {', '.join(sorted(STEPS))}")
    return STEPS[name]


def _load() -> None:
    """The package's other steps register themselves when they are first asked for."""
    for module in ("spanweave.steps", "spanweave.models"):
        importlib.import_module(module)


def counts(state: State) -> dict[str, int]:
    """What a run left that can be counted: numbers as they are, collections and tables by their size."""
    out = {}
    for key, value in state.items():
        if isinstance(value, (bool, str, bytes)) or key in ("spark", "schema", "store"):
            continue
        if isinstance(value, int):
            out[key] = value
        elif isinstance(value, DataFrame):
            out[key] = value.count()
        elif hasattr(value, "__len__"):
            out[key] = len(value)
    return out


class Pipeline:
    def __init__(self, steps: list[tuple[Step, object]], schema: Ontology | None = None, version: str = "", store: str = "", name: str = ""):
        self.steps, self.schema, self.version, self.store, self.name = steps, schema, version, store, name
        available = set(SEEDED)
        for k, (step, _) in enumerate(steps):
            for key in step.requires:
                later = next((s.name for s, _ in steps[k + 1 :] if key in s.produces), None)
                if key not in available and later:
                    raise ValueError(f"{name}: step '{step.name}' reads '{key}', which only '{later}' adds, further down")
            available |= set(step.produces)

    @classmethod
    def from_config(cls, path: str, chain: str = "steps") -> "Pipeline":
        """Reads a YAML or JSON file: imports, schema, store, and the steps of a chain."""
        with open(path) as f:
            text = f.read()
        if path.endswith(".json"):
            config = json.loads(text)
        else:
            import yaml  # only where a YAML file is read

            config = yaml.safe_load(text) or {}
        if not config.get(chain):
            raise ValueError(f"{path}: no '{chain}' chain")
        for module in config.get("imports") or ():
            importlib.import_module(module)
        steps = []
        for entry in config[chain]:
            if isinstance(entry, dict) and len(entry) != 1:
                raise ValueError(f"{path}: a step is one name with its options, not {sorted(entry)}")
            name, options = (entry, None) if isinstance(entry, str) else next(iter(entry.items()))
            try:
                steps.append(((step := get(name)), step.configure(options)))
            except (TypeError, ValueError) as e:
                raise ValueError(f"{path}: {e}") from e
        here = os.path.dirname(os.path.abspath(path))
        schema, version = None, ""
        if config.get("schema"):
            names = [config["schema"]] if isinstance(config["schema"], str) else config["schema"]
            schema, version, _ = ontology.load(*[os.path.join(here, n) for n in names])
        return cls(steps, schema, version, config.get("store") or "", os.path.basename(path))

    def run(self, spark: SparkSession, inputs=(), on_step: Callable | None = None, **context) -> State:
        """Runs all steps; what the caller passes wins. With a store, the run is recorded there."""
        state: State = {"spark": spark, "inputs": tuple(inputs), "schema": self.schema, "version": self.version, "at": datetime.now(UTC).isoformat(timespec="seconds")}
        if self.store:
            state["store"] = open_store(spark, self.store)
        state |= context
        began = time.monotonic()
        for k, (step, options) in enumerate(self.steps):
            made = step.run(state, options)
            state = state | made
            if on_step:
                on_step(step.name, k, made, state)
        if isinstance(state.get("store"), Store):
            state["store"].add_run(state["at"], self.name, counts(state), round(time.monotonic() - began, 3), self.version)
        return state


def implied(state: State) -> DataFrame:
    """The store's links and those that an entail step derived."""
    links = state["store"].links().select("id", "predicate", "src", "dst")
    return links.unionByName(state["derived"].select("id", "predicate", "src", "dst")) if "derived" in state else links


@dataclass(frozen=True)
class TextOptions:
    split: str = "window"
    window: int = 2000


@register("ingest_text", ("inputs",), ("sources", "segments"), TextOptions)
def ingest_text(state: State, o: TextOptions) -> State:
    files = [readers.ingest_text(state["spark"], p, split=o.split, window=o.window).withColumn("origin", F.lit(p)) for p in state["inputs"]]
    both = mapping.union(files)
    sources = both.groupBy(F.col("source_id").alias("id")).agg(F.first("origin").alias("origin")).withColumn("meta", F.create_map().cast("map<string,string>"))
    segments = both.select("source_id", "number", "text")
    if "store" in state:
        state["store"].add_sources(sources, segments)
    return {"sources": sources, "segments": segments}


@dataclass(frozen=True)
class TableOptions:
    delimiter: str = ","
    encoding: str = "UTF-8"


@register("ingest_table", ("inputs",), ("rows",), TableOptions)
def ingest_table(state: State, o: TableOptions) -> State:
    return {"rows": mapping.union([readers.ingest_table(state["spark"], p, o.delimiter, o.encoding) for p in state["inputs"]])}


@dataclass(frozen=True)
class MapOptions:
    nodes: dict | None = None
    links: tuple = ()


@register("map_rows", ("rows",), ("nodes", "links", "unmapped"), MapOptions)
def map_rows(state: State, o: MapOptions) -> State:
    """``nodes``: name to type, key, fields; ``links``: predicate, src, dst by those names."""
    made = {k: mapping.NodeMap(m["type"], m["key"], m.get("fields", {})) for k, m in (o.nodes or {}).items()}
    rows = state["rows"]
    nodes = mapping.union([mapping.map_nodes(rows, m).dropDuplicates(["id"]) for m in made.values()])
    links = [mapping.map_links(rows, mapping.LinkMap(x["predicate"], made[x["src"]], made[x["dst"]])) for x in o.links]
    empty = state["spark"].createDataFrame([], "id string, predicate string, src string, dst string")
    lost = sum(mapping.unmapped(rows, m).count() for m in made.values())
    return {"nodes": nodes, "links": mapping.union(links) if links else empty, "unmapped": lost}


@register("relocate", ("segments", "statements"), ("nodes", "unplaced"))
def relocate(state: State, o) -> State:
    nodes, lost = locate.relocate(state["statements"], state["segments"], state["version"])
    return {"nodes": nodes, "unplaced": lost}


@register("relate", ("segments", "nodes", "relations"), ("links", "unrelated", "relation_violations"))
def relate(state: State, o) -> State:
    made = locate.relate(state["relations"], state["nodes"], state["segments"], state["schema"], state["version"])
    return {"links": made["links"], "unrelated": made["unrelated"], "relation_violations": made["violations"]}


@register("validate", ("nodes", "schema"), ("nodes", "violations"))
def validate_step(state: State, o) -> State:
    nodes, onto = state["nodes"], state["schema"]
    declared = state["spark"].createDataFrame(sorted((c, f) for c in onto.classes for f in onto.declared_fields(c)), "type string, field string")
    wrong = validate.unknown_types(nodes, onto).select("id").union(validate.undeclared_fields(nodes, declared).select("id")).distinct()
    return {"nodes": nodes.join(wrong, "id", "left_anti"), "violations": wrong}


@dataclass(frozen=True)
class AssertOptions:
    agent: str = ""
    kind: str = "run"


@register("assert", ("store", "nodes"), ("asserted",), AssertOptions)
def assert_step(state: State, o: AssertOptions) -> State:
    n = state["store"].assert_(state["at"], state["nodes"], state.get("links"), kind=o.kind, label=o.agent)
    if state["schema"] is not None:
        state["store"].add_schema(state["version"], state["schema"])
    return {"asserted": n}


@register("index_nodes", ("store",), ("index", "lengths"))
def index_nodes(state: State, o) -> State:
    text = state["store"].nodes().select("id", F.concat_ws("\n", F.map_values("fields"), F.transform("spans", lambda s: s["text"])).alias("text"))
    return {"index": rank.postings(text), "lengths": rank.lengths(text)}


@dataclass(frozen=True)
class RetrieveOptions:
    limit: int = 8


@register("retrieve", ("index", "lengths", "question"), ("hits",), RetrieveOptions)
def retrieve(state: State, o: RetrieveOptions) -> State:
    return {"hits": rank.retrieve(state["index"], state["lengths"], state["question"].lower().split(), o.limit)}


@dataclass(frozen=True)
class ExpandOptions:
    depth: int = 2
    limit: int = 200
    follow: tuple[str, ...] = ()
    supports: tuple[str, ...] = ()
    opposes: tuple[str, ...] = ()


@register("graph_expand", ("store", "hits"), ("bundle",), ExpandOptions)
def graph_expand(state: State, o: ExpandOptions) -> State:
    hits = state["hits"]
    why = hits.select("node", F.format_string("ranked %.3f", F.col("score").cast("double")).alias("reason"))
    return {"bundle": bundle.expand(implied(state), hits, o.depth, o.limit, list(o.follow), o.supports, o.opposes, why, state["schema"], method="graph_expand", snapshot=state["version"])}


@register("entail", ("store", "schema"), ("derived", "typings", "identities", "clashes"))
def entail(state: State, o) -> State:
    made = reason.entail(state["store"].nodes(), state["store"].links(), state["schema"])
    return {"derived": made["links"], "typings": made["typings"], "identities": made["identities"], "clashes": made["clashes"]}


@dataclass(frozen=True)
class DiffuseOptions:
    damping: float = 0.85
    rounds: int = 30
    limit: int = 12
    weights: dict | None = None


@register("diffuse", ("store", "hits"), ("ranked",), DiffuseOptions)
def diffuse(state: State, o: DiffuseOptions) -> State:
    return {"ranked": graph.diffuse(implied(state), state["hits"], o.weights or {}, o.damping, o.rounds, o.limit)}


@dataclass(frozen=True)
class LineageOptions:
    follow: tuple[str, ...] = ()
    depth: int = 6


@register("lineage", ("store", "cause"), ("affected",), LineageOptions)
def lineage(state: State, o: LineageOptions) -> State:
    follow = state["schema"].widen(list(o.follow)) if state["schema"] else list(o.follow)
    return {"affected": graph.lineage(implied(state), state["cause"], follow, o.depth)}


@dataclass(frozen=True)
class PlanOptions:
    plan: tuple = ()
    strict: bool = False
    limit: int = 200
    opposes: tuple[str, ...] = ()


@register("execute_plan", ("store", "schema"), ("trace", "answer_count"), PlanOptions)
def execute_plan(state: State, o: PlanOptions) -> State:
    steps = [plan.Step(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items()}) for s in o.plan]
    done = plan.run(steps, state["store"].nodes(), state["store"].links(), state["schema"], state.get("hits"), o.strict, o.limit, opposing=o.opposes)
    return {"trace": done, "answer_count": done.count or 0}


@dataclass(frozen=True)
class QueryOptions:
    text: str = ""


@register("query", ("store", "schema"), ("answers", "inconsistent"), QueryOptions)
def query(state: State, o: QueryOptions) -> State:
    nodes, links = state["store"].nodes(), state["store"].links()
    found = conjunctive.answer(o.text, nodes, links, state["schema"])
    broken = conjunctive.violations(nodes, links, state["schema"]) if state["schema"].disjoint else None
    return {"answers": found, "inconsistent": broken.count() if broken is not None else 0}


@register("classify", ("schema",), ("hierarchy", "unsatisfiable"))
def classify(state: State, o) -> State:
    above, empty = state["schema"].classify()
    return {"hierarchy": above, "unsatisfiable": sorted(empty)}


@dataclass(frozen=True)
class CritiqueOptions:
    name_field: str = "name"
    min_quote: int = 12
    grounded_fields: tuple[str, ...] = ()
    negations: tuple[str, ...] = ()


@register("critique", ("nodes", "schema"), ("findings",), CritiqueOptions)
def critique(state: State, o: CritiqueOptions) -> State:
    nodes = state["nodes"].withColumn("quote", F.array_join(F.transform("spans", lambda s: s["text"]), " "))
    return {"findings": validate.critique(nodes, state["schema"], o.name_field, o.min_quote, o.grounded_fields, o.negations)}


@dataclass(frozen=True)
class UnitOptions:
    kinds: tuple[str, ...] = ()
    quantifiers: tuple[str, ...] = ()
    modalities: tuple[str, ...] = ()
    polarities: tuple[str, ...] = ()
    readings: dict | None = None
    negative: tuple[str, ...] = ()
    type: str = "SemanticUnit"


@register("compile_units", ("store", "schema"), ("units", "judged"), UnitOptions)
def compile_units(state: State, o: UnitOptions) -> State:
    names = ("kind", "quantifier", "polarity", "modality", "subject_term", "object_term")
    rows = state["store"].by_type(o.type).select("id", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names])
    units = evidence.translated(evidence.unit_forms(rows, o.kinds, o.quantifiers, o.modalities, o.polarities), o.readings or {}, o.negative)
    return {"units": units, "judged": evidence.judged(units, state["schema"])}


@register("keep_cited", ("answer", "known"), ("answer",))
def keep_cited_step(state: State, o) -> State:
    row = state["spark"].createDataFrame([(state["answer"], list(state["known"]))], "text string, known array<string>")
    return {"answer": row.select(keep_cited(F.col("text"), F.col("known"))).first()[0]}


def main(argv: list[str] | None = None) -> int:
    """``run CONFIG INPUT...``, ``ask CONFIG QUESTION`` and ``steps``."""
    parser = argparse.ArgumentParser(prog="spanweave")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("steps", help="names of all steps, what they read and add")
    for name, rest in (("run", "inputs"), ("ask", "question")):
        c = commands.add_parser(name)
        c.add_argument("config")
        c.add_argument(rest, nargs="*")
    args = parser.parse_args(argv)
    if args.command == "steps":
        _load()
        for name, s in sorted(STEPS.items()):
            print(f"{name}: {', '.join(s.requires) or '-'} -> {', '.join(s.produces) or '-'}")
        return 0
    spark = SparkSession.getActiveSession() or build_session("spanweave")
    if args.command == "run":
        state = Pipeline.from_config(args.config).run(spark, args.inputs)
    else:
        state = Pipeline.from_config(args.config, "ask").run(spark, question=" ".join(args.question))
    print("\t".join(f"{k} {v}" for k, v in counts(state).items()))
    return 0
