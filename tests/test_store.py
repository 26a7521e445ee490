"""Placing quotes, the store, ontology files and chains of steps."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from spanweave import pipeline
from spanweave.operators import locate
from spanweave.plans.ontology import Ontology
from spanweave.sources import ontology, store

TEXT = [("s", 1, "The  “first” trial – with\nmany words – ended well."), ("s", 2, "A second trial ended badly, as everyone had feared it would."), ("s", 3, "The same line."), ("s", 4, "The same line.")]


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame(TEXT, "source_id string, number int, text string")


def test_quotes_are_placed(spark, segments):
    asked = [
        ("exact", 1, "second trial ended"), ("edges", 1, " second trial "), ("folded", None, '"first" trial - with many'), ("hint", 4, "The same line."), ("first", None, "The same line."),
        ("fuzzy", None, "second trial ended badly, as everyone had fearde it"), ("none", None, "nothing of the kind was ever said there"), ("blank", None, "  "),
    ]
    rows = spark.createDataFrame([(i, "s", h, q) for i, h, q in asked] + [("lost", "other", 1, "second")], "id string, source_id string, segment int, quote string")
    got = {r.id: r for r in locate.locate(rows, segments).collect()}
    assert got.keys() == {"exact", "edges", "folded", "hint", "first", "fuzzy"}
    assert all(TEXT[r.span.segment - 1][2][r.span.start : r.span.end] == r.span.text for r in got.values())
    assert {i: (r.method, r.span.segment) for i, r in got.items()} == {"exact": ("exact", 2), "edges": ("exact", 2), "folded": ("normalised", 1), "hint": ("exact", 4), "first": ("exact", 3), "fuzzy": ("fuzzy", 2)}
    assert got["edges"].span.text == "second trial" and got["folded"].span.text == "“first” trial – with\nmany" and got["folded"].confidence == 0.9
    assert got["fuzzy"].needs_review and got["fuzzy"].confidence >= 0.85 and got["fuzzy"].span.text.endswith("feared it")


def test_closest_equals_brute_force():
    rng = random.Random(2)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(max(row[k] + 1 if x == y else 0, row[k + 1], new[-1]))
            row = new
        return row[-1]

    for _ in range(60):
        text = "".join(rng.choice("abcd ") for _ in range(40))
        quote = "".join(c if rng.random() < 0.85 else rng.choice("abcd") for c in text[10:22])
        want = max(200 * lcs(quote, w) / (len(quote) + len(w)) for s in range(-11, 40) if (w := text[max(0, s) : s + 12]))
        got = locate.closest(quote, text, 50.0)
        assert got and got[0] == pytest.approx(want)
    assert difflib.SequenceMatcher(None, "abc", "abc").ratio() == 1.0


def test_statements_become_nodes_and_relations_links(spark, segments):
    shape = "id string, source_id string, segment int, type string, fields map<string,string>, quote string"
    said = spark.createDataFrame([("1", "s", 1, "P", {"name": "x"}, "many words"), ("2", "s", 1, "P", {"name": "x"}, "many words"), ("3", "s", 2, "Q", {}, "second trial"), ("4", "s", 2, "Q", {}, "no such words at all here")], shape)
    nodes, lost = locate.relocate(said, segments, "v1")
    rows = {r.type: r for r in nodes.collect()}
    assert len(rows) == nodes.count() == 2 and [r.id for r in lost.collect()] == ["4"]
    onto = Ontology(classes=frozenset({"P", "Q"}), domains=frozenset({("r", "P")}), ranges=frozenset({("r", "Q")}))
    name = lambda t: f"s#{rows[t].id[:6]}"
    claims = [("a", "r", "s", 1, name("P"), name("Q"), "ended well"), ("b", "r", "s", 1, name("Q"), name("P"), "ended well"), ("c", "r", "s", 1, "s#nobody", name("Q"), "ended well")]
    made = locate.relate(spark.createDataFrame(claims, "id string, predicate string, source_id string, segment int, src_ref string, dst_ref string, quote string"), nodes, segments, onto)
    assert [(r.src, r.dst) for r in made["links"].collect()] == [(rows["P"].id, rows["Q"].id)]
    assert {r.finding for r in made["violations"].collect()} == {"domain", "range"} and [r.id for r in made["unrelated"].collect()] == ["c"]


@pytest.mark.parametrize("kind", ["parquet", "jsonl", "memory"])
def test_store_projects_what_was_asserted(spark, segments, tmp_path, kind):
    held = store.open_store(spark, f"{kind}:file://{tmp_path}/graph")
    held.add_sources(spark.createDataFrame([("s", "here", {"k": "v"})], "id string, origin string, meta map<string,string>"), segments)
    span = [("s", 2, 2, 8, "second")]
    node = lambda fields: spark.createDataFrame([("n1", "P", fields, span)], f"id string, type string, fields map<string,string>, spans array<{store.SPAN}>")
    link = spark.createDataFrame([("l1", "r", "n1", "n1")], "id string, predicate string, src string, dst string")
    assert held.assert_("2024-01-01", node({"name": "old"}), link, label="ann") == 2
    assert held.assert_("2024-01-02", node({"name": "new"}), kind="model") == 1
    assert [(r.id, r.fields["name"], r.spans[0].text) for r in held.nodes().collect()] == [("n1", "new", "second")]
    assert [r.id for r in held.links().collect()] == ["l1"] and held.assertions("n1").count() == 2
    assert {r.agent.id for r in held.assertions().collect()} == {"ann", "model:2024-01-02"}
    first = held.assertions("n1").where("at = '2024-01-02'").first()
    held.assert_("2024-01-03", node({"name": "gone"}), supersedes=first.id)
    assert held.get_nodes(["zz", "n1"]).first().fields["name"] == "gone" and held.by_type("P").count() == 1 and held.by_type("Q").count() == 0
    with pytest.raises(ValueError, match="unknown source"):
        held.assert_("2024-01-04", spark.createDataFrame([("n2", "P", [("nowhere", 1, 0, 1, "x")])], f"id string, type string, spans array<{store.SPAN}>"))
    assert held.select("SELECT count(*) AS n FROM nodes").first().n == 1
    onto = Ontology(subclasses=frozenset({("A", "B")}), chains=frozenset({(("p", ("q", True)), "r")}), symmetric=frozenset({"p"})) if kind == "none" else Ontology(subclasses=frozenset({("A", "B")}))
    held.add_schema("v1", onto)
    held.add_schema("v1", Ontology())
    assert held.get_schema("v1").subclasses == onto.subclasses and held.get_schema("v2") is None
    held.add_run("2024-01-05", "p", {"nodes": 1}, 0.5)
    assert [(r.pipeline, r.counts["nodes"]) for r in held.runs().collect()] == [("p", 1)]


def test_renderings_are_read_back_or_refused(spark, segments):
    held = store.MemoryStore(spark)
    held.add_sources(spark.createDataFrame([("s", "here", {})], "id string, origin string, meta map<string,string>"), segments)
    pages = store.to_markdown(held.sources(), held.segments())
    sources, back = store.from_markdown(pages)
    assert sorted(map(tuple, back.collect())) == sorted(TEXT) and sources.first().text_hash == held.sources().first().text_hash
    with pytest.raises(Exception, match="was changed"):
        store.from_markdown(pages.withColumn("markdown", F.replace("markdown", F.lit("badly"), F.lit("well"))))[1].collect()


TURTLE = """@prefix : <http://x.org/v#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
# what there is
:A a owl:Class ; rdfs:subClassOf :B , [ a owl:Restriction ; owl:onProperty :r ; owl:someValuesFrom :C ] .
:C owl:disjointWith :B ; rdfs:label "a; \\"name\\""@en .
:r a owl:ObjectProperty , owl:TransitiveProperty ; rdfs:domain :A ; rdfs:range :C ; owl:inverseOf :s ; owl:propertyChainAxiom ( :p [ owl:inverseOf :q ] ) .
:p rdfs:subPropertyOf :r . :D owl:equivalentClass [ owl:intersectionOf ( :A :C ) ] ; rdfs:subClassOf [ owl:onProperty :p ; owl:maxCardinality 1 ] ; owl:hasKey ( :p ) .
"""


def test_ontology_files(tmp_path):
    (tmp_path / "a.ttl").write_text(TURTLE)
    (tmp_path / "b.json").write_text(json.dumps({"classes": ["E"], "subclasses": [["E", "A"]]}))
    onto, version, ignored = ontology.load(str(tmp_path / "a.ttl"), str(tmp_path / "b.json"))
    assert onto.subclasses == {("A", "B"), ("E", "A")} and onto.some == {("A", "r", "C")} and onto.disjoint == {("C", "B")} and onto.transitive == {"r"}
    assert onto.inverses == {("r", "s")} and onto.chains == {(("p", ("q", True)), "r")} and onto.domains == {("r", "A")} and onto.subproperties == {("p", "r")}
    assert onto.rules == {(("and", "A", "C"), "D"), ("D", ("and", "A", "C")), ("D", ("max", 1, "p", "Thing"))}
    assert len(version) == 12 and ignored == ["D hasKey b10"] or len(ignored) == 1
    with pytest.raises(ValueError):
        ontology.triples_of("x:y a x:Z .")
    assert ontology.expand_curie("x:y", {"x": "http://x.org/"}) == "http://x.org/y" and ontology.expand_curie("y", {}) == "y"


def test_graph_as_triples(spark):
    nodes = spark.createDataFrame([("n 1", "T", {"k": 'a "b"\nc\\'})], "id string, type string, fields map<string,string>")
    links = spark.createDataFrame([("l", "p", "n 1", "m")], "id string, predicate string, src string, dst string")
    lines = [r.line for r in ontology.graph_triples(nodes, links).collect()]
    found = ontology.triples_of("\n".join(lines))
    assert len(lines) == len(found) == 6 and ("urn:graph:n%201", "urn:graph:p", "urn:graph:m") in found
    assert any(x.endswith('"a \\"b\\"\\nc\\\\" .') for x in lines)


def test_chains_of_steps(spark, tmp_path, capsys):
    (tmp_path / "rows.csv").write_text("who,place\nann,rome\nbob,rome\n,oslo\n")
    (tmp_path / "v.json").write_text(json.dumps({"classes": ["Person", "Town"], "domains": [["lives_in", "Person"]], "ranges": [["lives_in", "Town"]], "fields": [["Person", "name"], ["Town", "name"]]}))
    config = {
        "schema": "v.json", "store": f"parquet:file://{tmp_path}/graph",
        "steps": ["ingest_table", {"map_rows": {"nodes": {"p": {"type": "Person", "key": "who", "fields": {"name": "who"}}, "t": {"type": "Town", "key": "place", "fields": {"name": "place"}}}, "links": [{"predicate": "lives_in", "src": "p", "dst": "t"}]}}, "validate", {"assert": {"agent": "me"}}],
        "ask": ["index_nodes", {"retrieve": {"limit": 2}}, {"graph_expand": {"depth": 1}}, {"execute_plan": {"plan": [{"op": "resolve", "type": "Person"}, {"op": "traverse", "predicate": "lives_in"}, {"op": "aggregate"}], "strict": True}}],
    }
    path = tmp_path / "c.json"
    path.write_text(json.dumps(config))
    state = pipeline.Pipeline.from_config(str(path)).run(spark, [f"file://{tmp_path}/rows.csv"])
    assert (state["asserted"], state["unmapped"]) == (6, 1)
    asked = pipeline.Pipeline.from_config(str(path), "ask").run(spark, question="rome")
    assert asked["answer_count"] == 1 and asked["hits"].count() == 1 and asked["bundle"].nodes.count() == 3
    assert state["store"].runs().count() == 2
    for wrong, said in (({"steps": [{"retrieve": {"limits": 2}}]}, "no options"), ({"steps": ["nope"]}, "unknown step"), ({"steps": ["retrieve", "index_nodes"]}, "further down")):
        path.write_text(json.dumps(wrong))
        with pytest.raises(ValueError, match=said):
            pipeline.Pipeline.from_config(str(path))
    with pytest.raises(ValueError, match="registered already"):
        pipeline.register("retrieve")(lambda s, o: {})
    assert pipeline.main(["steps"]) == 0 and "execute_plan" in capsys.readouterr().out


def test_federation_keeps_what_holds(spark, segments):
    span = lambda start, text: [("s", 2, start, start + len(text), text)]
    shape = f"id string, type string, spans array<{store.SPAN}>, schema_version string"
    stores = {}
    for name, rows in {"one": [("n", "P", span(2, "second"), "v1"), ("m", "P", span(2, "second"), "v9")], "two": [("n", "P", span(2, "second"), "v1"), ("k", "P", span(3, "second"), "v1")]}.items():
        stores[name] = held = store.MemoryStore(spark)
        held.add_sources(spark.createDataFrame([("s", name, {})], "id string, origin string, meta map<string,string>"), segments)
        held.assert_("2024-01-01", spark.createDataFrame(rows, shape), label=name)
    stores["two"].append("assertions", stores["one"].read("assertions").selectExpr("seq + 100 AS seq", "'lost' AS id", "agent", "at", "kind", "'lost' AS target_id", "supersedes", "confidence", "named_struct('type', 'P', 'fields', node.fields, 'spans', array(named_struct('source_id', 'gone', 'segment', 1, 'start', 0, 'end', 1, 'text', 'x')), 'schema_version', 'v1') AS node", "link").limit(1))
    got = store.federate(spark, stores, ("v1",))
    assert {(r.registry, r.target_id): r.reason.split(" ")[0] for r in got["held"].collect()} == {("one", "m"): "written", ("two", "k"): "evidence", ("two", "lost"): "the"}
    assert {r.target_id: r.registries for r in got["origins"].collect()} == {"n": ["one", "two"]}
    assert got["assertions"].count() == 2 and [r.origin for r in got["sources"].collect()] == ["one"]


def _model(prompts):
    return ['so: {"statements": [{"type": "P", "fields": {"name": "x"}, "quote": "' + p.split("\n")[-1][:6] + '"}]} end' if "Types" in p else "0.25" if "number" in p else "overview" if "overview or fact" in p else "A word." for p in prompts]


def test_models_take_part_at_seams(spark, segments):
    from spanweave import models

    onto = Ontology(classes=frozenset({"P"}))
    one = segments.where("number = 2")
    state = {"spark": spark, "segments": one, "model": _model, "schema": onto, "question": "what?", "version": ""}
    made = pipeline.get("extract_llm").run(state, models.PromptOptions())
    nodes, lost = locate.relocate(made["statements"], one)
    assert [(r.type, r.spans[0].text) for r in nodes.collect()] == [("P", "A seco")] and lost.count() == 0
    assert pipeline.get("route").run(state, models.PromptOptions())["overview"]
    hits = spark.createDataFrame([(nodes.first().id, 1.0)], "node string, score double")
    assert pipeline.get("salience_llm").run(state | {"hits": hits, "nodes": nodes}, models.PromptOptions())["hits"].first().score == 0.25
    found = spark.createDataFrame([("t", "label", ""), ("u", "other", "told")], "term string, label string, definition string")
    assert [r.definition for r in pipeline.get("define_llm").run(state | {"candidates": found}, models.PromptOptions())["candidates"].orderBy("term").collect()] == ["A word.", "told"]
    bad = spark.createDataFrame([("no object",), (None,)], "r string").select(models.parsed(F.col("r"), "statements", "array<string>").alias("x"))
    assert [r.x for r in bad.collect()] == [[], []]


def test_rows_are_evidence(spark):
    from spanweave.operators.mapping import LinkMap, NodeMap, map_links, map_nodes
    from spanweave.sources.readers import cell_span, render

    rows = spark.createDataFrame([(1, "ann", "rome"), (2, "ann", "oslo"), (3, None, "oslo"), (4, "ann", "rome")], "n int, who string, place string")
    columns = ["who", "place"]
    text = {r.n: r.t for r in rows.select("n", render(columns).alias("t")).collect()}
    span = lambda c: cell_span(columns, c, F.lit("src"), F.col("n"))
    who, place = NodeMap("P", "who"), NodeMap("T", "place")
    nodes = map_nodes(rows, place, "n", span("place")).collect()
    links = map_links(rows, LinkMap("in", who, place), span(None)).collect()
    assert {(r.key, r.spans[0].segment) for r in nodes} == {("rome", 1), ("oslo", 2)} and sorted(len(r.spans) for r in links) == [1, 2]
    assert all(text[s.segment][s.start : s.end] == s.text for r in nodes + links for s in r.spans)


def test_projection_is_refreshed_by_batch(spark):
    from spanweave.operators import log
    from spanweave.streaming.log import refresh

    rng = random.Random(3)
    rows = [(k, f"a{k}", f"2024-01-{rng.randint(10, 28)}", f"t{rng.randint(0, 12)}", f"a{rng.randint(0, k)}" if k and rng.random() < 0.3 else None) for k in range(60)]
    make = lambda part: spark.createDataFrame(part, "seq long, id string, at string, target_id string, supersedes string")
    state = log.current(make(rows[:20]))
    for lo in (20, 40):
        state = spark.createDataFrame(refresh(state, make(rows[: lo + 20]), make(rows[lo : lo + 20])).collect(), state.schema)
        assert sorted(map(str, state.collect())) == sorted(map(str, log.current(make(rows[: lo + 20])).select(state.columns).collect()))


def test_steps_over_packages(spark, segments):
    held = store.MemoryStore(spark)
    held.add_sources(spark.createDataFrame([("s", "here", {})], "id string, origin string, meta map<string,string>"), segments)
    span = lambda text: [("s", 2, TEXT[1][2].index(text), TEXT[1][2].index(text) + len(text), text)]
    rows = [("c", "Claim", {"name": "it works"}, span("second")), ("p", "Result", {"name": "yes", "value": "1", "unit": "cm"}, span("trial")), ("q", "Result", {"name": "no", "value": "2", "unit": "in"}, span("badly")), ("k", "Context", {"temperature": "hot"}, span("feared")), ("l", "Context", {"temperature": "cold"}, span("ended"))]
    nodes = spark.createDataFrame(rows, f"id string, type string, fields map<string,string>, spans array<{store.SPAN}>")
    ls = spark.createDataFrame([("1", "supports", "p", "c"), ("2", "disputes", "q", "c"), ("3", "under", "p", "k"), ("4", "under", "q", "l")], "id string, predicate string, src string, dst string")
    held.assert_("2024-01-01", nodes, ls, label="me")
    onto = Ontology(classes=frozenset({"Claim", "Result", "Context"}), domains=frozenset({("supports", "Result"), ("disputes", "Result"), ("under", "Result")}))
    state = {"spark": spark, "store": held, "schema": onto, "version": "v", "at": "now", "hits": spark.createDataFrame([("c", 1.0), ("p", 0.9)], "node string, score double"), "question": "works"}
    go = lambda name, **o: state.update(pipeline.get(name).run(state, pipeline.get(name).configure(o)))
    for name, options in [
        ("index_nodes", {}), ("graph_expand", {"depth": 2, "opposes": ["disputes"], "supports": ["supports"]}), ("reconcile", {"conditions": ["under"]}), ("compare", {"type": "Result", "conditions": ["under"], "units": {"in:cm": 2.54}}),
        ("select_paths", {}), ("select_subgraph", {}), ("communities", {}), ("topics", {}), ("formal_check", {}), ("entail", {}), ("graph_expand_entailed", {"depth": 1}), ("render_markdown", {}), ("federate", {"registries": {"a": held}}), ("count_independence", {}),
    ]:
        go(name, **options)
    assert [(r.supporting, r.opposing, r.verdict, r.differing) for r in state["conflicts"].collect()] == [("p", "q", "conditions", "temperature")]
    assert [(r.id, r.verdict, r.converted) for r in state["comparisons"].collect()] == [("q", "partial", pytest.approx(5.08))]
    assert state["paths"].count() >= 1 and {r.node for r in state["selection"].collect()} == {"c", "p"} and state["problems"] == []
    assert state["topics"].agg(F.sum("members")).first()[0] == 5 and state["pages"].count() == 1
    assert tuple(state["independence"].first()) [:4] == (1, 1, 0, 4) and state["synced"].count() == 9
    state["citations"] = spark.createDataFrame([("s#q",), ("x",)], "ref string")
    state["bundle"] = pipeline.get("graph_expand").run(state, pipeline.get("graph_expand").configure({"opposes": ["disputes"], "supports": ["supports"]}))["bundle"]
    go("check_answer")
    assert [r.ref for r in state["review"]["unknown"].collect()] == ["x"] and state["review"]["omitted"] == ["supporting"]
