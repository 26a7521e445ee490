"""Behaviour of the graph, query and evidence operators on hand-made graphs."""

import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from spanweave.functions.text import fold, keep_cited, normalise, tokens
from spanweave.operators import bundle, evidence, graph, log, rank, validate
from spanweave.operators.mapping import NodeMap, map_nodes, unmapped
from spanweave.plans import conjunctive, plan, reason
from spanweave.plans.ontology import Ontology, inspect
from spanweave.queries import QUERIES
from spanweave.sources.readers import cell_offsets, cut, ingest_table, ingest_text, read_log, render, triples, write_log
from spanweave.streaming.log import follow_log, projected

LINK = "src string, predicate string, dst string"


def links(spark, rows):
    return spark.createDataFrame(rows, LINK).selectExpr("concat_ws('-', src, predicate, dst) AS id", "*")


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


SMALL = [("A", "r", "B"), ("B", "r", "C"), ("B", "q", "D"), ("E", "r", "E")]


def test_current_drops_superseded_whatever_their_time(spark):
    rows = [(1, "a1", "2024-01-01", "x", None), (2, "a2", "2023-01-01", "x", None), (3, "a3", "2020-01-01", "y", None), (4, "a4", "2019-01-01", "y", "a3"), (5, "a5", "2024-01-01", "x", None)]
    df = spark.createDataFrame(rows, "seq long, id string, at string, target_id string, supersedes string")
    assert {(r.target_id, r.id, r.position) for r in log.current(df).collect()} == {("x", "a5", 1), ("y", "a4", 4)}
    assert [r.seq for r in log.history(df, "y").collect()] == [3, 4]


def test_select_refuses_writes(spark):
    for sql in ("DROP TABLE x", "SELECT 1; SELECT 2"):
        with pytest.raises(ValueError):
            log.select(spark, sql)
    assert log.select(spark, "SELECT 1 AS one;").first().one == 1


def test_mapping_skips_empty_keys_and_first_row_wins(spark):
    df = spark.createDataFrame([(1, "s1", "n"), (2, "s1", "m"), (3, " ", "z"), (4, None, "z"), (5, "s2", " ")], "o int, study string, name string")
    m = NodeMap("Study", "study", {"name": "name"})
    assert {(r.key, tuple(r.fields.items())) for r in map_nodes(df, m, "o").collect()} == {("s1", (("name", "n"),)), ("s2", ())}
    assert unmapped(df, m).count() == 2


def test_reach_both_ways_and_limit(spark):
    adj, seed = graph.adjacency(links(spark, SMALL)), nodes_of(spark, ["D"])
    found, partial = graph.reach(adj, seed, 2)
    assert {(r.node, r.depth) for r in found.collect()} == {("D", 0), ("B", 1), ("A", 2), ("C", 2)} and not partial
    found, partial = graph.reach(adj, seed, 2, limit=3)
    assert {(r.node, r.parent, r.link) for r in found.collect()} == {("D", None, None), ("B", "D", "B-q-D"), ("A", "B", "A-r-B")} and partial
    assert {r.node for r in graph.reach(adj, nodes_of(spark, ["B"]), 2, backward=False)[0].collect()} == {"B", "C", "D"}
    assert {r.node for r in graph.reach(graph.adjacency(links(spark, SMALL), ["r"]), nodes_of(spark, ["A"]), 3)[0].collect()} == {"A", "B", "C"}


def test_degree_counts_self_links_twice(spark):
    assert {(r.node, r.degree) for r in graph.degree(links(spark, SMALL)).collect()} == {("A", 1), ("B", 3), ("C", 1), ("D", 1), ("E", 2)}


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    rows = [(f"n{rng.randrange(60):02d}", "r", f"n{rng.randrange(60):02d}") for _ in range(45)]
    label = {n: n for a, _, b in rows for n in (a, b)}
    for _ in range(60):
        for a, _, b in rows:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.component for r in graph.components(links(spark, rows)).collect()} == label


def test_walks_are_simple_and_flow_keeps_counter_paths(spark):
    rows = [("a", "supports", "b"), ("b", "supports", "d"), ("a", "disputes", "d"), ("a", "supports", "c"), ("c", "supports", "d")]
    ends = spark.createDataFrame([("a", "d")], "src string, dst string")
    found = graph.walks(graph.adjacency(links(spark, rows)), ends, 3)
    assert sorted(tuple(r.nodes) for r in found.collect()) == [("a", "b", "d"), ("a", "c", "d"), ("a", "d")]
    kept = graph.path_flow(found, {"disputes": 0.01}, decay=0.5, keep=1).collect()
    assert {(r.score, len(r.nodes)) for r in kept} == {(0.25, 3), (0.005, 2)}


def test_diffusion_equals_power_iteration(spark):
    got = {r.node: r.score for r in graph.diffuse(links(spark, SMALL[:3]), nodes_of(spark, ["A"]), top=None).collect()}
    near = {"A": ["B"], "B": ["A", "C", "D"], "C": ["B"], "D": ["B"]}
    rank_ = {n: float(n == "A") for n in near}
    for _ in range(30):
        rank_ = {n: 0.15 * (n == "A") + 0.85 * sum(rank_[m] / len(near[m]) for m in near[n]) for n in near}
    assert got == {n: pytest.approx(v, abs=1e-6) for n, v in rank_.items()}
    stuck = graph.diffuse(links(spark, [("a", "none", "b"), ("c", "r", "d")]), nodes_of(spark, ["a"]), {"none": 0.0}, top=None)
    assert {r.node: r.score for r in stuck.collect()} == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0}
    weighed = spark.createDataFrame([("A", 3.0), ("C", 1.0)], "node string, score double")
    first = {r.node: r.score for r in graph.diffuse(links(spark, SMALL[:3]), weighed, damping=0.0, rounds=1, top=None).collect()}
    assert (first["A"], first["C"]) == (0.75, 0.25)


def test_two_cliques_part_at_the_bridge():
    pairs = [*itertools.combinations("abc", 2), *itertools.combinations("def", 2), ("c", "d")]
    got = graph.partition(pairs)
    assert len({got[n] for n in "abc"}) == len({got[n] for n in "def"}) == 1 and got["a"] != got["d"]


def test_topic_terms_shuffle_texts_not_words(spark):
    docs = spark.createDataFrame([(1, "a b b"), (1, "b c"), (2, "c c a"), (3, None)], "id long, text string")
    groups = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "node long, topic string")
    made = rank.topic_terms(rank.postings(docs), groups, 2)
    assert sorted((r.topic, r.term, r.n, r["rank"]) for r in made.collect()) == [("x", "b", 3, 1), ("x", "c", 3, 2), ("y", "a", 1, 2), ("y", "c", 2, 1)]
    assert "hashpartitioning(term" not in rank.postings(docs)._jdf.queryExecution().executedPlan().toString()


def test_packages_write_links_once_and_chains_join_once(spark, monkeypatch):
    told = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c")], "s string, p string, o string")
    facts = reason.with_ids(told)
    onto = Ontology(chains=frozenset({(("p", "q"), "r")}))
    assert len(reason._rules(facts, facts, onto, None, False)) == 1
    labels, write = [], graph.materialize
    for m in (graph, bundle):
        monkeypatch.setattr(m, "materialize", lambda df, label="cut", rows=None: labels.append(label) or write(df, label, rows))
    made = bundle.expand(links(spark, SMALL), nodes_of(spark, ["A"]), depth=1)
    assert {r.id for r in made.links.collect()} == {"A-r-B"} and "adjacency" not in labels


def leafy(rng):
    """Links with hubs and leaves, pairs by themselves, self links and repeated ones."""
    rows = [(f"h{rng.randrange(6)}", "r", f"h{rng.randrange(6)}") for _ in range(6)] + [(f"x{k}", "q", f"h{rng.randrange(9)}") for k in range(30)]
    return rows + [("p", "r", "o"), ("s", "r", "t"), ("s", "q", "t"), ("z", "r", "z"), ("y", "r", "y"), ("y", "r", "a0")] + rows[:3]


def test_leaves_diffuse_as_by_plain_rounds(spark):
    rng = random.Random(8)
    for seeds, rounds, weights in (({"x1": 1.0}, 12, {}), ({"h0": 2.0, "x2": 1.0, "p": 1.0}, 7, {"q": 3.0}), ({"x3": 1.0, "s": 1.0}, 0, {}), ({"h1": 1.0, "o": 1.0}, 6, {"q": 0.0})):
        rows = leafy(rng)
        pull = {}
        for a, p, b in rows:
            for e in ((a, b), (b, a)):
                pull[e] = pull.get(e, 0.0) + weights.get(p, 1.0)
        out = {}
        for (x, _), w in pull.items():
            out[x] = out.get(x, 0.0) + w
        home = {n: seeds.get(n, 0.0) for n in out}
        home = {n: s / sum(home.values()) for n, s in home.items()}
        rank = home
        for _ in range(rounds):
            lost = sum(s for n, s in rank.items() if not out[n])
            got = {n: (0.15 + 0.85 * lost) * h for n, h in home.items()}
            for (x, y), w in pull.items():
                got[y] += 0.85 * rank[x] * w / out[x] if w else 0.0
            rank = got
        given = spark.createDataFrame(list(seeds.items()), "node string, score double")
        made = graph.diffuse(links(spark, rows), given, weights, rounds=rounds, top=None).collect()
        assert {r.node: pytest.approx(r.score, abs=2e-6) for r in made} == rank and len(made) == len(rank)


def test_rounds_leave_leaves_out(spark, monkeypatch):
    from spanweave.operators import components

    rows, seen, whole = leafy(random.Random(9)), [], components._contract
    monkeypatch.setattr(components, "_contract", lambda ends, rows=None: seen.append(ends.count()) or whole(ends, rows))
    got = {r.node: r.component for r in graph.components(links(spark, rows)).collect()}
    group = {n: {n} for a, _, b in rows for n in (a, b)}
    for a, _, b in rows:
        both = group[a] | group[b]
        group.update({n: both for n in both})
    assert got == {n: min(g) for n, g in group.items()}
    assert seen[0] <= 12  # links among hubs and self links, of 45


def merged_by_all_gains(pairs):
    """Brute force: every gain again before each merge."""
    m, member, share = len(pairs), {n: {n} for p in pairs for n in p}, {}
    ends = {n: sum((a == n) + (b == n) for a, b in pairs) for n in member}
    for p in pairs:
        if p[0] != p[1]:
            share[tuple(sorted(p))] = share.get(tuple(sorted(p)), 0) + 1
    while share:
        gain, a, b = min((ends[a] * ends[b] / (2 * m * m) - s / m, a, b) for (a, b), s in share.items())
        if gain >= 0:
            break
        member[a] |= member.pop(b)
        ends[a] += ends.pop(b)
        moved = {}
        for (x, y), s in share.items():
            k = tuple(sorted((a if x == b else x, a if y == b else y)))
            if k[0] != k[1]:
                moved[k] = moved.get(k, 0) + s
        share = moved
    return {frozenset(g) for g in member.values()}


def test_communities_merge_as_by_all_gains_and_end_on_hubs():
    rng = random.Random(3)
    for t in range(200):
        names = [f"{rng.randrange(1000):03}" for _ in range(rng.randint(2, 20))]
        pairs = [(rng.choice(names[: 3 if t % 2 else None]), rng.choice(names)) for _ in range(rng.randint(1, 50))]
        got = graph.partition(pairs)
        assert {frozenset(n for n in got if got[n] == c) for c in got.values()} == merged_by_all_gains(pairs)
    star = [(f"{rng.getrandbits(64):016x}", f"hub{rng.randrange(25)}") for _ in range(20_000)]
    began = time.process_time()
    assert len(set(graph.partition(star).values())) == 25
    assert time.process_time() - began < 60  # all gains before each merge took hours


def test_growth_takes_what_pays(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "x"), ("x", "y")]
    assert graph.grow({"a": 1.0, "b": 0.9, "c": 0.1}, pairs, 0.25) == (["a", "b"], 1.9, 0.25)
    assert graph.grow({"a": 1.0, "y": 0.9}, pairs, 0.25, whole={"x": ("y",)})[0] == ["a", "x", "y"]
    assert graph.grow({"a": 1.0, "b": 0.9, "c": 0.8}, pairs, 0.25, limit=2)[0] == ["a", "b"]
    ls = links(spark, [(a, "r", b) for a, b in pairs])
    hits = spark.createDataFrame([("a", 2.0), ("b", 1.8), ("y", 1.0)], "node string, score double")
    assert {r.node: r.prize for r in graph.select_subgraph(ls, hits).collect()} == {"a": 1.0, "b": 0.9}
    parts = spark.createDataFrame([("x", "y")], "node string, part string")
    assert {r.node for r in graph.select_subgraph(ls, hits, whole=parts).collect()} == {"a", "b", "x", "y"}


def test_shapes_refuse_and_warn(spark):
    onto = Ontology(classes=frozenset({"P", "Q", "R"}), subclasses=frozenset({("R", "Q")}), fields=frozenset({("P", "name")}))
    nodes = spark.createDataFrame([("a", "P", {"name": "ann"}), ("b", "P", {"name": "x", "odd": "1"}), ("c", "R", {}), ("d", "P", {})], "id string, type string, fields map<string,string>")
    ls = links(spark, [("a", "r", "c"), ("a", "r", "old"), ("b", "r", "d"), ("d", "s", "a")])
    shapes = [validate.Shape("P", "r", at_least=1, at_most=2, cls="Q"), validate.Shape("P", "name", field=True, at_least=1, severity="warning"), validate.Shape("P", "name", field=True, min_length=2, severity="warning"), validate.Shape("P", closed=True)]
    out = validate.shacl_validate(nodes, ls, shapes, onto, spark.createDataFrame([("old", "Q")], "id string, type string"))
    assert {(r.id, r.finding, r.severity) for r in out["findings"].collect()} == {("b", "class", "violation"), ("b", "closed", "violation"), ("b", "minLength", "warning"), ("d", "minCount", "violation"), ("d", "minCount", "warning")}
    assert {r.id for r in out["nodes"].collect()} == {"a", "c"} and {r.dst for r in out["links"].collect()} == {"c", "old"}


def test_formal_gate():
    wrong = Ontology(
        classes=frozenset("ABCDE"), subclasses=frozenset({("A", "B"), ("B", "A"), ("C", "Z"), ("D", "A"), ("D", "E")}), disjoint=frozenset({("A", "E")}),
        domains=frozenset({("p", "A"), ("q", "A")}), ranges=frozenset({("p", "E"), ("q", "C")}), inverses=frozenset({("p", "q")}), chains=frozenset({(("p", "p"), "p")}),
    )
    found, left = inspect(wrong, profile="QL")
    assert left == [] and {(k, t) for k, t, _ in found} >= {("cycle", "A"), ("cycle", "B"), ("unknown", "C"), ("disjoint", "D"), ("inverse", "p"), ("outside-profile", "QL")}
    assert inspect(Ontology(classes=frozenset("AB"), subclasses=frozenset({("A", "B")}))) == ([], []) and inspect(wrong, budget=2)[1]


def test_expand_pulls_in_objections(spark):
    rows = [("a", "r", "b"), ("z", "disputes", "b"), ("b", "r", "c"), ("b", "backs", "a")]
    reasons = spark.createDataFrame([("a", "ranked 1.000")], "node string, reason string")
    made = bundle.expand(links(spark, rows), nodes_of(spark, ["a"]), 1, opposes=("disputes",), supports=("backs",), reasons=reasons)
    assert {(r.node, r.depth, r.reason) for r in made.nodes.collect()} == {("a", 0, "ranked 1.000"), ("b", 1, None), ("z", None, "opposing disputes")}
    assert {(r.src, r.opposes, r.supports) for r in made.links.collect()} == {("a", False, False), ("z", True, False), ("b", False, True)}
    assert made.grounded and not made.partial
    assert bundle.omitted_sides(made, nodes_of(spark, ["z"])) == ["supporting"] and bundle.omitted_sides(made, nodes_of(spark, ["b"])) == []
    refs = spark.createDataFrame([("a", "s#a"), ("z", "s#z"), ("c", "s#c")], "node string, ref string")
    found = bundle.review(made, refs, spark.createDataFrame([("s#a",), ("s#c",)], "ref string"))
    assert [r.ref for r in found["unknown"].collect()] == ["s#c"] and found["omitted"] == ["opposing"]
    marked = bundle.mark(made, spark.createDataFrame([("a", "K"), ("a", "J")], "id string, type string"))
    assert next(r.reason for r in marked.nodes.collect() if r.node == "a") == "ranked 1.000; inferred to be J, K"


QL = Ontology(subclasses=frozenset({("Positive", "Result")}), some=frozenset({("Result", "produced_by", "Study")}), domains=frozenset({("rests_on", "Statement")}), subproperties=frozenset({("supports", "bears_on")}), inverses=frozenset({("part_of", "has_part")}), disjoint=frozenset({("Result", "Statement")}))


def test_certain_answers(spark):
    nodes = spark.createDataFrame([("p", "Positive"), ("s", "Study"), ("x", "Thing")], "id string, type string")
    ls = links(spark, [("x", "rests_on", "p"), ("p", "supports", "x"), ("s", "has_part", "p"), ("p", "rests_on", "x")])
    ask = lambda q: {tuple(r) for r in conjunctive.answer(q, nodes, ls, QL).collect()}
    assert ask("q(?x) :- Result(?x), produced_by(?x, ?y)") == {("p",)}
    assert ask("q(?x) :- Statement(?x)") == {("x",), ("p",)}
    assert ask("q(?x, ?y) :- part_of(?x, ?y)") == {("p", "s")}
    assert ask("q(?x) :- bears_on(p, ?x)") == {("x",)}
    assert {tuple(r) for r in conjunctive.violations(nodes, ls, QL).collect()} == {("Result", "Statement", "p")}
    for bad in ("q(?x)", "q(?x) :- A(?y)", "q(?x) :- r(?x, ?y, ?z)"):
        with pytest.raises(ValueError):
            conjunctive.parse(bad)


def test_closure_derivations_and_retraction(spark):
    onto = Ontology(transitive=frozenset({"part_of"}), inverses=frozenset({("part_of", "has_part")}), symmetric=frozenset({"next_to"}), irreflexive=frozenset({"part_of"}), functional=frozenset({"made_by"}))
    told = spark.createDataFrame([("a", "part_of", "b"), ("b", "part_of", "c"), ("c", "next_to", "d"), ("a", "made_by", "m"), ("a", "made_by", "n")], "s string, p string, o string")
    facts, derivations, finished = reason.close(told, onto)
    got = {(r.s, r.p, r.o) for r in facts.where("derived").collect()}
    assert got == {("a", "part_of", "c"), ("b", "has_part", "a"), ("c", "has_part", "b"), ("c", "has_part", "a"), ("d", "next_to", "c"), ("m", "same_as", "n"), ("n", "same_as", "m")} and finished
    gone = facts.where("s = 'b' AND p = 'part_of'")
    left = reason.supported(facts, derivations, gone)
    assert {(r.s, r.p, r.o) for r in facts.join(left, "id").collect()} == {("a", "part_of", "b"), ("c", "next_to", "d"), ("b", "has_part", "a"), ("d", "next_to", "c"), ("a", "made_by", "m"), ("a", "made_by", "n"), ("m", "same_as", "n"), ("n", "same_as", "m")}
    loop = spark.createDataFrame([("a", "part_of", "a")], "s string, p string, o string")
    assert reason.clashes(loop, onto).first().rule == "prp-irp"
    assert not reason.close(told, onto, rounds=1)[2]


def test_el_classification_and_profiles():
    onto = Ontology(classes=frozenset("ABCD"), subclasses=frozenset({("A", "B"), ("B", "C"), ("D", "A"), ("D", "E")}), disjoint=frozenset({("C", "E")}), some=frozenset({("F", "r", "D")}))
    sups, bottom = onto.classify()
    assert sups["A"] == {"A", "B", "C"} and bottom == {"D", "F"}
    assert onto.outside("RDFS") == ["disjoint", "some"] and onto.outside("EL") == [] and onto.outside("RL") == ["some"]
    assert onto.are_disjoint("A", "E")


def test_validation(spark):
    onto = Ontology(classes=frozenset({"P", "Q"}), domains=frozenset({("r", "P")}), ranges=frozenset({("r", "Q")}))
    nodes = spark.createDataFrame([("1", "P", {"name": "x", "odd": "y"}), ("2", "Z", {"name": ""})], "id string, type string, fields map<string,string>")
    assert [tuple(r) for r in validate.undeclared_fields(nodes, spark.createDataFrame([("P", "name"), ("Z", "name")], "type string, field string")).collect()] == [("1", "odd")]
    assert [r.id for r in validate.unknown_types(nodes, onto).collect()] == ["2"]
    ls = links(spark, [("1", "r", "2"), ("2", "r", "1"), ("1", "nope", "2")])
    assert sorted(r.finding for r in validate.signature_findings(ls, nodes, onto).collect()) == ["domain", "range", "range", "unknown predicate"]
    said = nodes.selectExpr("*", "'it does not  work: X' AS quote")
    found = {(r.id, r.finding, r.detail) for r in validate.critique(said, onto, grounded=("name", "odd"), negations=("not", "never"), least_quote=30).collect()}
    assert found == {("1", "thin", ""), ("1", "ungrounded", "odd"), ("1", "negation", "not"), ("2", "untyped", ""), ("2", "thin", ""), ("2", "negation", "not")}
    ring = links(spark, [("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "r", "d"), ("e", "r", "a")])
    rings = links(spark, [("a", "r", "b"), ("b", "r", "a"), ("b", "r", "x"), ("x", "r", "c"), ("c", "r", "d"), ("d", "r", "c"), ("q", "r", "q")])
    for at_once in (0, 1000):
        assert {r.node for r in validate.cycles(ring, "r", at_once).collect()} == {"a", "b", "c"}
        assert {r.node for r in validate.cycles(rings, "r", at_once).collect()} == {"a", "b", "c", "d", "q"}
    chain = links(spark, [(f"n{k:03}", "r", f"n{k + 1:03}") for k in range(200)])
    assert validate.cycles(chain, "r").collect() == []


def test_align_matches_greedily(spark):
    schema = "plan int, nth int, label string"
    planned = spark.createDataFrame([(1, 1, "mix the salt"), (1, 2, "heat the oven"), (1, 3, "weigh flour")], schema)
    actual = spark.createDataFrame([(1, 1, "heat the oven"), (1, 2, "mix the sea salt"), (1, 3, "sing")], schema)
    got = {(r.planned, r.actual, r.verdict, r.reordered) for r in evidence.align(planned, actual).collect()}
    assert got == {("mix the salt", "mix the sea salt", "renamed", False), ("heat the oven", "heat the oven", "same", True), ("weigh flour", None, "missing", False), (None, "sing", "extra", False)}


def in_turn(planned, actual, believed, least):
    """Brute force: each planned step takes the asserted or the closest step left."""
    words = lambda t: frozenset(t.lower().split())
    near = lambda a, b: len(words(a) & words(b)) / len(words(a) | words(b))
    left, out = list(actual), []
    for i, a in planned:
        pick = next((s for s in left if believed.get(s[0]) == i), None)
        if pick is None:
            best = max(left, key=lambda s: (near(a, s[1]), -s[0]), default=None)
            pick = best if best and near(a, best[1]) >= least else None
        if pick:
            left.remove(pick)
        out.append((i, pick and pick[0]))
    return out + [(None, s[0]) for s in left]


def test_align_takes_planned_steps_in_turn(spark):
    rng = random.Random(5)
    make = lambda: " ".join(rng.sample("mix salt heat oven weigh flour stir rest".split(), rng.randint(1, 3)))
    plans = {p: ([(k, make()) for k in range(30)], [(k, make()) for k in range(25)]) for p in range(3)} | {9: ([(k, "stir it") for k in range(70)], [(k, "Stir it") for k in range(75)])}
    schema = "plan int, nth int, label string"
    side = lambda j: spark.createDataFrame([(p, k, t) for p, both in plans.items() for k, t in both[j]], schema)
    asserted = spark.createDataFrame([(1, 3, 7), (1, 20, 2)], "plan int, planned int, actual int")
    got = evidence.align(side(0), side(1), 0.5, asserted).collect()
    for p, (a, b) in plans.items():
        want = in_turn(a, b, {7: 3, 2: 20} if p == 1 else {}, 0.5)
        assert sorted(map(str, want)) == sorted(str((r.planned_nth, r.actual_nth)) for r in got if r.plan == p)
    first = evidence.align(spark.createDataFrame([(1, 1, "a b c"), (1, 2, "a b c d")], schema), spark.createDataFrame([(1, 1, "a b c d")], schema)).collect()
    assert {(r.planned, r.verdict) for r in first} == {("a b c", "renamed"), ("a b c d", "missing")}


def test_align_takes_many_plans_a_call(spark):
    """Plans, a null one and one that is not a number among them, go through a task in sequence, also over batches."""
    plans = [float(p) for p in range(60)] + [None, float("nan")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        side = lambda k: spark.createDataFrame([(p, n, f"step {n} of it") for p in plans for n in range(1 + k, 5 + k)], "plan double, nth int, label string")
        made = evidence.align(side(0), side(1), 0.9)
        got = sorted((str(r.plan), str(r.planned_nth), str(r.actual_nth), r.verdict, r.reordered) for r in made.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [("1", "None", "missing", False), ("None", "5", "extra", False), *((str(n), str(n), "same", False) for n in (2, 3, 4))]
    assert got == sorted((str(p), *w) for p in plans for w in want)
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()


def test_reconcile_and_compare_give_verdicts(spark):
    shape = "about string, id string, conditions map<string,string>, source_id string, quote string"
    mine = spark.createDataFrame([("c", "p", {"t": "1"}, "s1", "q1")], shape)
    theirs = spark.createDataFrame([("c", "o1", {"t": "2"}, "s1", "q2"), ("c", "o2", {"t": "2"}, "s2", "q1 "), ("c", "o3", {"t": "1"}, "s1", "q3"), ("c", "o4", {}, "s3", "q4"), ("c", "o5", {}, None, None), ("x", "o6", {}, "s", "q")], shape)
    assert {r.opposing: r.verdict for r in evidence.reconcile(mine, theirs).collect()} == {"o1": "conditions", "o2": "extraction", "o3": "ambiguous", "o4": "disagreement", "o5": "ambiguous"}
    shape = "id string, conditions map<string,string>, value string, unit string"
    base = spark.createDataFrame([("b", {"t": "1"}, "2", "cm")], shape)
    rest = spark.createDataFrame([("b", {"t": "1"}, "2", "cm"), ("same", {"t": "1"}, "1,5", "in"), ("apart", {"t": "2"}, "1", "cm"), ("less", {}, "1", "cm"), ("other", {"t": "1"}, "1", "?"), ("told", {"t": "3"}, "1", "cm")], shape)
    asserted = evidence.asserted_comparable(spark.createDataFrame([("b", "cb"), ("told", "ct")], "id string, condition string"), links(spark, [("ct", "matches", "cb")]), ["matches"])
    got = {r.id: (r.verdict, r.matched, r.differed, r.missing, r.converted) for r in evidence.compare(rest, base, [("in", "cm", 2.54)], asserted).collect()}
    assert got == {"same": ("comparable", "t", "", "", pytest.approx(3.81)), "apart": ("partial", "", "t", "", None), "less": ("insufficient", "", "", "t", None), "other": ("insufficient", "t", "", "", None), "told": ("comparable", "", "t", "", None)}


def test_independence_and_pooling(spark):
    claims = spark.createDataFrame([("s", "r", "a"), ("t", "r", "b"), ("t", "q", "c")], "source_id string, registry string, node string")
    pairs = spark.createDataFrame([("a", "z"), ("z", "b"), ("c", "b"), ("b", "b")], "a string, b string")
    assert tuple(evidence.independence(claims, pairs).first()) == (2, 2, 1, 2, 1)
    labels = spark.createDataFrame([(1, "blood pressure test", "s1"), (2, "pressure blood test", "s2"), (3, "Blood Pressure", "s3"), (4, "other", "s1")], "seq long, label string, source_id string")
    pools = evidence.pooled_labels(labels)
    assert {(r.term, r.label, r.support) for r in pools.collect()} == {("blood pressure test", "Blood Pressure", 3), ("other", "other", 1)}
    held = spark.createDataFrame([("blood pressure test", ["s9"], 1, "how hard blood pushes")], "term string, families array<string>, rounds int, definition string")
    merged = evidence.merged_rounds(pools, held)
    assert {(r.term, r.support, r.rounds) for r in merged.collect()} == {("blood pressure test", 4, 2), ("other", 1, 1)}
    assert {r.term: r.refused for r in evidence.promote(merged, ["Other"]).collect()} == {"blood pressure test": None, "other": "support 1 in independent families, below 3"}


def test_units_are_judged(spark):
    shape = "id string, kind string, quantifier string, polarity string, modality string, subject_term string, object_term string"
    rows = [("1", "universal", "all", "affirmative", "", "Bird", "Flyer"), ("2", "universal", "all", "affirmative", "", "Penguin", "Flyer"), ("3", "universal", "no", "affirmative", "", "Penguin", "Flyer"), ("4", "rhetorical", "all", "affirmative", "", "a", "b"), ("5", "universal", "", "affirmative", "", "a", "b"), ("6", "universal", "all", "", "", "a", "b"), ("7", "universal", "all", "affirmative", "maybe", "a", "b")]
    made = evidence.translated(evidence.unit_forms(spark.createDataFrame(rows, shape), ("universal",)), {"all": "all", "no": "none"})
    assert {r.id: (r.profile, r.form) for r in made.collect()} == {"1": ("exact", "subclass"), "2": ("exact", "subclass"), "3": ("exact", "disjoint"), "4": ("unsupported", None), "5": ("lossy", None), "6": ("unsupported", None), "7": ("lossy", None)}
    onto = Ontology(classes=frozenset({"Bird", "Penguin", "Flyer"}), subclasses=frozenset({("Penguin", "Bird")}))
    assert {r.id: (r.status, r.against) for r in evidence.judged(made, onto).collect()} == {"1": ("consistent", []), "2": ("contradicted", ["3"]), "3": ("contradicted", ["2"])}


def test_plans_are_checked(spark):
    onto = Ontology(classes=frozenset({"A", "B", "C"}), subclasses=frozenset({("C", "A")}), domains=frozenset({("r", "A"), ("no", "A")}), ranges=frozenset({("r", "B"), ("no", "A")}), fields=frozenset({("B", "f")}))
    step = plan.Step
    assert plan.check([step("resolve", type="Z"), step("traverse"), step("filter"), step("traverse", predicate="q")], onto) == [
        "step 1, resolve Z: no class 'Z' in this ontology", "step 2, traverse: needs a relation to cross", "step 3, filter: needs a field to filter on", "step 4, traverse q: no relation 'q' in this ontology",
    ]
    assert plan.check_strict([step("resolve", type="C"), step("traverse", predicate="r"), step("compare", field="f")], onto) == []
    assert any("does not admit ['B']" in p for p in plan.check_strict([step("resolve", type="B"), step("traverse", predicate="r")], onto))
    assert any("not declared on ['A', 'C']" in p for p in plan.check_strict([step("resolve", type="A"), step("filter", field="f")], onto))
    assert any("unused argument 'type'" in p for p in plan.check_strict([step("resolve"), step("traverse", predicate="r", type="B")], onto))
    assert plan.check_strict([step("traverse", predicate="r")], onto)[0] == "a strict plan must start with resolve"
    nodes = spark.createDataFrame([("a", "A", {}), ("b", "B", {"f": "X"}), ("b2", "B", {"f": "y"}), ("c", "C", {})], "id string, type string, fields map<string,string>")
    ls = links(spark, [("a", "r", "b"), ("c", "r", "b2"), ("a", "no", "c")])
    done = plan.run([step("resolve", type="A"), step("join", predicate="r", field="f", value="x"), step("aggregate")], nodes, ls, onto, strict=True)
    assert done.count == 1 and [r.node for r in done.nodes.collect()] == ["a"] and [r.node for r in done.steps[1].excluded.collect()] == ["c"]
    assert [tuple(r) for r in done.steps[1].groups.collect()] == [("a", "b")] and [r.link for r in done.steps[1].witnesses.collect()] == ["a-r-b"]
    some = plan.run([step("resolve", type="B")], nodes, ls, onto, limit=1)
    assert some.partial and [r.node for r in some.nodes.collect()] == ["b"]
    for kind, wrong in (("budget", {"limit": 1}), ("schema", {}), ("schema", {"opposing": ("r",)})):
        with pytest.raises(plan.Refused) as e:
            plan.run([step("resolve", type="B"), *([] if kind == "budget" else [step("oppose", predicate="no")])], nodes, ls, onto, strict=True, **wrong)
        assert e.value.kind == kind
    backward = plan.run([step("resolve", type="B"), step("traverse", predicate="r", forward=False)], nodes, ls, onto)
    assert {r.node for r in backward.nodes.collect()} == {"a", "c"}


def test_expressions_identities_and_clashes(spark):
    t = lambda *rows: spark.createDataFrame(rows, "s string, p string, o string")
    made = lambda f: {(r.s, r.p, r.o) for r in f.where("derived").collect()}
    facts, told, done = reason.close(t(("a", "f", "x"), ("a", "f", "y"), ("x", "type", "C"), ("z", "r", "y")), Ontology(functional=frozenset({"f"})))
    assert done and made(facts) == {("x", "same_as", "y"), ("y", "same_as", "x"), ("y", "type", "C"), ("z", "r", "x")}
    rules = {(("and", "A", ("some", "r", "B")), "D"), ("D", ("only", "r", "E")), ("D", ("value", "v", "w")), (("or", "P", "Q"), ("not", "E")), ("A", ("max", 1, "r", "B")), ("D", ("max", 0, "q", "Thing"))}
    facts, _, _ = reason.close(t(("a", "type", "A"), ("a", "r", "b"), ("b", "type", "B"), ("b", "type", "P"), ("a", "r", "c"), ("c", "type", "B"), ("a", "q", "n")), Ontology(rules=frozenset(rules)))
    assert made(facts) == {("a", "type", "D"), ("a", "v", "w"), ("b", "same_as", "c"), ("c", "same_as", "b"), ("b", "type", "E"), ("c", "type", "E"), ("c", "type", "P")}
    assert {(r.rule, r.node) for r in reason.clashes(facts, Ontology(rules=frozenset(rules))).collect()} == {("cls-com", "b"), ("cls-com", "c"), ("cls-maxc", "a")}
    onto = Ontology(chains=frozenset({(("p", ("q", True)), "s")}), disjoint_properties=frozenset({("p", "pp")}), equivalent=frozenset({("X", "Y")}), equivalent_properties=frozenset({("p", "pp")}), inverse_functional=frozenset({"k"}))
    facts, _, _ = reason.close(t(("a", "p", "b"), ("c", "q", "b"), ("n", "type", "Y"), ("m", "k", "o"), ("n", "k", "o")), onto)
    assert {("a", "pp", "b"), ("a", "s", "c"), ("n", "type", "X"), ("m", "type", "X"), ("m", "same_as", "n")} <= made(facts)
    assert {(r.rule, r.node) for r in reason.clashes(facts, onto).collect()} == {("prp-pdw", "a")}
    span = "array<struct<source_id:string,text:string>>"
    nodes = spark.createDataFrame([(n, "T", [("s", n)]) for n in "xyz"], f"id string, type string, spans {span}")
    ls = spark.createDataFrame([("l1", "p", "x", "y", [("s", "xy")]), ("l2", "p", "y", "z", [("s", "yz")])], f"id string, predicate string, src string, dst string, spans {span}")
    out = reason.entail(nodes, ls, Ontology(transitive=frozenset({"p"}), subproperties=frozenset({("p", "q")}), domains=frozenset({("q", "K")})))
    assert {(r.predicate, r.src, r.dst): r.spans[0].text[:1] for r in out["links"].collect()}.keys() == {("p", "x", "z"), ("q", "x", "y"), ("q", "y", "z"), ("q", "x", "z")}
    assert all(r.spans for r in out["links"].collect()) and {(r.id, r.type) for r in out["typings"].collect()} == {("x", "K"), ("y", "K")} and out["finished"]


def test_align_steps_reads_whole_turns(spark, tmp_path):
    head = "word " * 20
    turns = [(1, 1, "user", head + "salt"), (1, 2, "assistant", head + "sugar"), (2, 1, "user", "x " * 40 + "salt and oil"), (2, 2, "assistant", "y " * 40 + "salt and oil")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = {r.plan: (r.planned, r.actual, r.verdict) for r in QUERIES["align_steps"](spark, f"file://{tmp_path}").collect()}
    assert got == {1: (turns[0][3], turns[1][3], "renamed"), 2: (turns[2][3], turns[3][3], "renamed")}


def test_text_functions(spark):
    df = spark.createDataFrame([("F–score  of the  “Straße” isn’t", "x [a]\ny [b]", ["a"])], "t string, u string, k array<string>")
    got = df.select(fold(F.col("t")).alias("f"), normalise(F.col("t")).alias("n"), tokens(F.col("t")).alias("w"), keep_cited(F.col("u"), F.col("k")).alias("c")).first()
    assert got.f == 'F-score of the "Straße" isn\'t' and got.w == ["f-score", "of", "the", "strasse", "isn't"] and got.c == "x [a]"


def test_sources_and_triples(spark, tmp_path):
    docs = spark.createDataFrame([("d", "one\n\n \n\ntwo"), ("e", ""), ("f", None)], "source_id string, text string")
    assert [(r.source_id, r.number, r.text) for r in cut(docs, "blank-line").collect()] == [("d", 1, "one"), ("d", 2, "two")]
    assert [(r.number, r.text) for r in cut(docs, "window", 5).where("source_id = 'd'").collect()] == [(1, "one\n\n"), (2, " \n\ntw"), (3, "o")]
    (tmp_path / "a.txt").write_text("hello")
    assert ingest_text(spark, f"file://{tmp_path}/a.txt", split="whole").first().text == "hello"
    (tmp_path / "t.csv").write_text("study,value\ns1,5\ns2,\n")
    table = ingest_table(spark, f"file://{tmp_path}/t.csv")
    assert [r.rendered for r in table.collect()] == ["study: s1 | value: 5\n", "study: s2 | value: \n"]
    for r in table.select("study", "value", render(["study", "value"]).alias("t"), *cell_offsets(["study", "value"])).where("value IS NOT NULL").collect():
        assert r.t[r.study_start :].startswith(r.study) and r.t[r.value_start :].startswith(r.value)
    nodes = spark.createDataFrame([("1", "P", {"name": 'a"b'})], "id string, type string, fields map<string,string>")
    assert {r.o for r in triples(nodes, links(spark, [("1", "r", "2")])).collect()} == {"<urn:P>", '"a\\"b"', "<urn:2>"}


def test_log_files_and_stream(spark, tmp_path):
    schema = "seq long, id string, at string, target_id string, supersedes string"
    (tmp_path / "in").mkdir()
    base = f"file://{tmp_path}"
    for k, rows in enumerate([[(1, "a", "2024", "x", None)], [(2, "b", "2023", "x", None), (3, "c", "2025", "y", "a")]]):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "id", "at", "target_id", "supersedes"), r))) for r in rows))
        follow_log(spark, f"{base}/in", schema, f"{base}/store", f"{base}/check").awaitTermination()
    assert {(r.target_id, r.id) for r in projected(spark, f"{base}/store").collect()} == {("x", "b"), ("y", "c")}
    write_log(read_log(spark, f"{base}/in", schema), f"{base}/copy")
    assert read_log(spark, f"{base}/copy", schema).count() == 3


def test_ranking_prefers_dense_matches(spark):
    docs = spark.createDataFrame([(1, "salt and water"), (2, "salt"), (3, "sand")], "id long, text string")
    got = rank.retrieve(rank.postings(docs), rank.lengths(docs), ["salt", "water"]).collect()
    assert [(r.node, r.score) for r in got] == [(1, 1.154701), (2, 1.0)]
    groups = spark.createDataFrame([(1, "t"), (2, "t"), (3, "u")], "node long, topic string")
    rows, partial = rank.retrieve_routed(spark.createDataFrame([(1, 1.0)], "node long, score double"), groups, True, cap=1)
    assert rows.count() == 1 and partial
