"""Queries over the driver's tables, one an operator, and the SQL that DuckDB runs for the same rows.

The graph: regions, nations, customers, suppliers, orders and parts are nodes; ``in_region`` and
``based_in`` lie under the transitive ``located_in``; ``placed_by`` is the inverse of ``placed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions.text import jaccard, keep_cited, normalise, reslices, tokens
from spanweave.operators import bundle, evidence, graph, locate, log, rank, validate
from spanweave.operators.mapping import LinkMap, NodeMap, map_links, map_nodes, node_id, union
from spanweave.plans import conjunctive, plan, reason
from spanweave.plans.ontology import Ontology
from spanweave.session import load
from spanweave.sources import ontology, store
from spanweave.sources.readers import cut, render
from spanweave.streaming.log import counts_per_window

REGION, NATION = NodeMap("Region", "r_regionkey", {"name": "r_name"}), NodeMap("Nation", "n_nationkey", {"name": "n_name"})
CUSTOMER = NodeMap("Customer", "c_custkey", {"name": "c_name", "segment": "c_mktsegment"})
SUPPLIER = NodeMap("Supplier", "s_suppkey", {"name": "s_name"})
ORDER = NodeMap("Order", "o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority"})
TABLES = {"region": REGION, "nation": NATION, "customer": CUSTOMER, "supplier": SUPPLIER, "orders": ORDER}
LINKS = {
    "in_region": ("nation", NATION, NodeMap("Region", "n_regionkey")),
    "based_in": ("customer", CUSTOMER, NodeMap("Nation", "c_nationkey")),
    "supplier_in": ("supplier", SUPPLIER, NodeMap("Nation", "s_nationkey")),
    "placed_by": ("orders", ORDER, NodeMap("Customer", "o_custkey")),
}
ONTOLOGY = Ontology(
    classes=frozenset({"Region", "Nation", "Customer", "Supplier", "Order", "Party", "Place"}),
    subclasses=frozenset({("Customer", "Party"), ("Supplier", "Party"), ("Region", "Place"), ("Nation", "Place")}),
    subproperties=frozenset({("in_region", "located_in"), ("based_in", "located_in"), ("supplier_in", "located_in")}),
    inverses=frozenset({("placed_by", "placed")}),
    transitive=frozenset({"located_in"}),
    chains=frozenset({(("placed_by", "based_in"), "ordered_from")}),
    domains=frozenset({("placed_by", "Order"), ("based_in", "Customer"), ("supplier_in", "Supplier"), ("in_region", "Nation")}),
    ranges=frozenset({("placed_by", "Customer"), ("based_in", "Nation"), ("supplier_in", "Nation"), ("in_region", "Region")}),
    disjoint=frozenset({("Customer", "Supplier"), ("Customer", "Order")}),
    fields=frozenset({("Customer", "name"), ("Customer", "segment"), ("Supplier", "name"), ("Order", "status"), ("Order", "priority"), ("Region", "name"), ("Nation", "name")}),
)


def nodes(spark: SparkSession, sf: str, tables=tuple(TABLES)) -> DataFrame:
    return union([map_nodes(load(spark, sf, t), TABLES[t]) for t in tables])


def links(spark: SparkSession, sf: str, predicates=tuple(LINKS)) -> DataFrame:
    return union([map_links(load(spark, sf, LINKS[p][0]), LinkMap(p, *LINKS[p][1:])) for p in predicates])


def _id(kind: str, key: str) -> str:
    return f"substr(sha256(concat_ws(chr(0), '{kind}', {key}::VARCHAR)), 1, 16)"


NODES_SQL = " UNION ALL ".join(f"SELECT {_id(m.type, m.key)} AS id, '{m.type}' AS type, {m.key}::VARCHAR AS key FROM {t}" for t, m in TABLES.items())
LINKS_SQL = " UNION ALL ".join(f"SELECT DISTINCT {_id(s.type, s.key)} AS src, '{p}' AS predicate, {_id(d.type, d.key)} AS dst FROM {t}" for p, (t, s, d) in LINKS.items())
GRAPH = f"nodes AS ({NODES_SQL}), links AS (SELECT substr(sha256(concat_ws(chr(0), src, predicate, dst)), 1, 16) AS id, * FROM ({LINKS_SQL})), adj AS (SELECT src AS a, dst AS b, predicate FROM links UNION ALL SELECT dst, src, predicate FROM links)"
WITH = f"WITH {GRAPH} "
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _told(m: NodeMap) -> str:
    """SQL of a row's fields as text, by name, blank ones left out."""
    each = ", ".join(f"CASE WHEN trim({c}::VARCHAR) <> '' THEN '{k}=' || {c}::VARCHAR END" for k, c in sorted(m.fields.items()))
    return f"array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), '|')"


@query(" UNION ALL ".join(f"SELECT {_id(m.type, m.key)} AS id, '{m.type}' AS type, {m.key}::VARCHAR AS key, {_told(m)} AS fields FROM {t}" for t, m in TABLES.items()))
def map_nodes_all(spark, sf):
    told = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return nodes(spark, sf).select("id", "type", "key", told.alias("fields"))


@query(WITH + "SELECT id, predicate, src, dst FROM links")
def map_links_all(spark, sf):
    return links(spark, sf)


_EVENTS = "ev AS (SELECT event_id AS seq, event_id AS id, ts::VARCHAR AS made_at, user_id AS target, event_type, CASE WHEN event_type = 'error' THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS supersedes FROM events), live AS (SELECT * FROM ev WHERE id NOT IN (SELECT supersedes FROM ev WHERE supersedes IS NOT NULL))"


def _log(spark, sf):
    e = load(spark, sf, "events")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return e.select(F.col("event_id").alias("seq"), F.col("event_id").alias("id"), at.alias("at"), F.col("user_id").alias("target_id"), "event_type", F.when(F.col("event_type") == "error", before).alias("supersedes"))


@query(f"WITH {_EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY made_at DESC, seq DESC) AS n, min(seq) OVER (PARTITION BY target) AS position FROM live) SELECT target AS target_id, id, event_type, position FROM r WHERE n = 1")
def log_current(spark, sf):
    return log.current(_log(spark, sf)).select("target_id", "id", "event_type", "position")


@query(f"WITH {_EVENTS} SELECT id, event_type FROM live")
def log_live(spark, sf):
    return log.live(_log(spark, sf)).select("id", "event_type")


@query("SELECT user_id, max(event_id) AS event_id, min(event_id) AS position FROM events GROUP BY user_id")
def log_latest(spark, sf):
    return log.latest(load(spark, sf, "events").select("user_id", "event_id", F.col("event_id").alias("seq")), "user_id").select("user_id", "event_id", "position")


@query(f"SELECT {_id('Customer', 'c_custkey')} AS c, {_id('Nation', 'c_nationkey')} AS p FROM customer")
def cq_located_in(spark, sf):
    return conjunctive.answer("q(?c, ?p) :- Customer(?c), located_in(?c, ?p)", nodes(spark, sf, ("customer", "supplier", "nation", "region")), links(spark, sf, ("in_region", "based_in", "supplier_in")), ONTOLOGY)


@query(f"SELECT {_id('Customer', 'c_custkey')} AS x FROM customer UNION SELECT {_id('Supplier', 's_suppkey')} FROM supplier")
def cq_party(spark, sf):
    return conjunctive.answer("q(?x) :- Party(?x)", nodes(spark, sf), links(spark, sf), ONTOLOGY)


@query(f"SELECT DISTINCT {_id('Customer', 'o_custkey')} AS c, {_id('Order', 'o_orderkey')} AS o FROM orders")
def cq_inverse(spark, sf):
    return conjunctive.answer("q(?c, ?o) :- placed(?c, ?o)", nodes(spark, sf), links(spark, sf), ONTOLOGY)


@query(f"SELECT DISTINCT {_id('Order', 'o_orderkey')} AS o, {_id('Region', 'n_regionkey')} AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def cq_path(spark, sf):
    return conjunctive.answer("q(?o, ?r) :- placed_by(?o, ?c), based_in(?c, ?n), in_region(?n, ?r)", nodes(spark, sf), links(spark, sf), ONTOLOGY)


@query(f"SELECT 'Customer' AS first, 'Supplier' AS second, {_id('Customer', 'c_custkey')} AS node FROM customer WHERE c_acctbal < 0 UNION SELECT 'Customer', 'Order', {_id('Order', 'o_orderkey')} FROM orders WHERE o_orderkey % 10 = 1")
def cq_violations(spark, sf):
    """Customers that supply, and orders that a customer's link makes customers."""
    both = map_nodes(load(spark, sf, "customer").where("c_acctbal < 0"), CUSTOMER).withColumn("type", F.lit("Supplier"))
    odd = load(spark, sf, "orders").where("o_orderkey % 10 = 1").select("o_orderkey", F.lit(1).alias("n"))
    wrong = map_links(odd, LinkMap("based_in", ORDER, NodeMap("Nation", "n")))
    return conjunctive.violations(nodes(spark, sf).unionByName(both), links(spark, sf).unionByName(wrong), ONTOLOGY)


def _plan(spark, sf, *steps, tables=tuple(TABLES), predicates=tuple(LINKS), **options):
    made = nodes(spark, sf, tables).withColumn("spans", F.array(F.struct(F.concat_ws(" ", "type", F.substring("key", -1, 1)).alias("source_id"))))
    return plan.run([plan.Step(**s) for s in steps], made, links(spark, sf, predicates), ONTOLOGY, **{"limit": 10**12} | options)


@query(WITH + "SELECT id FROM nodes WHERE type IN ('Customer', 'Supplier')")
def plan_resolve(spark, sf):
    return _plan(spark, sf, {"op": "resolve", "type": "Party"}).nodes.select(F.col("node").alias("id"))


@query(WITH + "SELECT id FROM nodes WHERE type = 'Customer' AND id IN (SELECT " + _id("Customer", "c_custkey") + " FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery'))")
def plan_resolve_terms(spark, sf):
    return _plan(spark, sf, {"op": "resolve", "type": "Customer", "terms": ("Building", "machinery")}, tables=("customer",)).nodes.select(F.col("node").alias("id"))


@query(WITH + f"SELECT {_id('Nation', 'n_nationkey')} AS id FROM nation UNION SELECT {_id('Region', 'r_regionkey')} FROM region")
def plan_resolve_certain(spark, sf):
    """Nodes whose own type says nothing; relations alone make them places."""
    bare = nodes(spark, sf, ("customer", "nation", "region")).withColumn("type", F.when(F.col("type") == "Customer", "Customer").otherwise("Unknown"))
    made = links(spark, sf, ("in_region", "based_in"))
    return plan.run([plan.Step("resolve", type="Place")], bare, made, ONTOLOGY, limit=10**12).nodes.join(bare.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("node").alias("id"))


@query(f"SELECT {_id('Customer', 'c_custkey')} AS id, lower(c_mktsegment) = 'building' AS kept FROM customer")
def plan_filter(spark, sf):
    done = _plan(spark, sf, {"op": "resolve", "type": "Customer"}, {"op": "filter", "type": "Party", "field": "segment", "value": "BUILDING"}, tables=("customer",)).steps[-1]
    return done.nodes.select(F.col("node").alias("id"), F.lit(True).alias("kept")).unionByName(done.excluded.select(F.col("node").alias("id"), F.lit(False).alias("kept")))


@query(WITH + "SELECT 'node' AS kind, dst AS id FROM links WHERE predicate IN ('based_in', 'supplier_in') UNION SELECT 'witness', id FROM links WHERE predicate IN ('based_in', 'supplier_in')")
def plan_traverse(spark, sf):
    done = _plan(spark, sf, {"op": "resolve", "type": "Party"}, {"op": "traverse", "predicate": "located_in"}, strict=True).steps[-1]
    return done.nodes.select(F.lit("node").alias("kind"), F.col("node").alias("id")).unionByName(done.witnesses.select(F.lit("witness").alias("kind"), F.col("link").alias("id")))


@query(WITH + "SELECT l.dst AS anchor, l.src AS matched FROM links l JOIN orders ON l.src = " + _id("Order", "o_orderkey") + " WHERE predicate = 'placed_by' AND o_orderstatus = 'F'")
def plan_join(spark, sf):
    done = _plan(spark, sf, {"op": "resolve", "type": "Customer"}, {"op": "join", "predicate": "placed", "type": "Order", "field": "status", "value": "f"}, strict=True).steps[-1]
    return done.groups.select(F.col("key").alias("anchor"), F.col("node").alias("matched"))


@query(f"SELECT coalesce(nullif(lower(o_orderpriority), ''), 'unrecorded') AS grp, {_id('Order', 'o_orderkey')} AS id FROM orders")
def plan_compare(spark, sf):
    done = _plan(spark, sf, {"op": "resolve", "type": "Order"}, {"op": "compare", "field": "priority"}, tables=("orders",), strict=True).steps[-1]
    return done.groups.select(F.col("key").alias("grp"), F.col("node").alias("id"))


@query(WITH + "SELECT count(*) AS n, (SELECT count(DISTINCT type || ' ' || right(key, 1)) FROM nodes) AS sources FROM nodes")
def plan_aggregate(spark, sf):
    every = _plan(spark, sf, {"op": "resolve"}, {"op": "aggregate"}, {"op": "aggregate", "value": "sources"}, strict=True)
    return spark.createDataFrame([(every.steps[1].count, every.steps[2].count)], "n long, sources long")


@query(WITH + "SELECT 'node' AS kind, src AS id FROM links WHERE predicate = 'based_in' UNION SELECT 'node', dst FROM links WHERE predicate = 'based_in' UNION SELECT 'witness', id FROM links WHERE predicate = 'based_in'")
def plan_oppose(spark, sf):
    done = _plan(spark, sf, {"op": "resolve", "type": "Customer"}, {"op": "oppose", "predicate": "based_in"}, strict=True, opposing=("based_in",)).steps[-1]
    return done.nodes.select(F.lit("node").alias("kind"), F.col("node").alias("id")).unionByName(done.witnesses.select(F.lit("witness").alias("kind"), F.col("link").alias("id")))


@query(WITH + "SELECT id FROM nodes WHERE type = 'Customer' AND id NOT IN (SELECT " + _id("Customer", "o_custkey") + " FROM orders WHERE o_orderstatus = 'P')")
def plan_excluded(spark, sf):
    return nodes(spark, sf, ("customer",)).join(map_nodes(load(spark, sf, "orders").where("o_orderstatus = 'P'"), NodeMap("Customer", "o_custkey")).select("id"), "id", "left_anti").select("id")


@query("SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source")
def source_aggregate(spark, sf):
    return load(spark, sf, "documents").groupBy("source").agg(F.countDistinct("doc_id").alias("n"))


_HELD = "held AS (SELECT id FROM nodes WHERE type IN ('Nation', 'Region'))"


def _places(spark, sf):
    return nodes(spark, sf, ("nation", "region")).select(F.col("id").alias("node"))


@query(f"WITH {GRAPH}, {_HELD} SELECT id FROM links WHERE src IN (SELECT id FROM held) AND dst IN (SELECT id FROM held)")
def links_among(spark, sf):
    return graph.among(links(spark, sf), _places(spark, sf)).select("id")


@query(f"WITH {GRAPH}, {_HELD} SELECT id FROM links WHERE src IN (SELECT id FROM held) OR dst IN (SELECT id FROM held)")
def links_touching(spark, sf):
    return graph.touching(links(spark, sf), _places(spark, sf)).select("id")


@query(WITH + "SELECT a AS node, count(*) AS degree FROM adj GROUP BY a")
def node_degree(spark, sf):
    return graph.degree(links(spark, sf))


def _seed(spark, m: NodeMap, key: str):
    return spark.range(1).select(F.lit(key).alias(m.key)).select(node_id(m).alias("node"))


_REACH = "WITH RECURSIVE {g}, r AS (SELECT {s} AS node, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN adj ON a = node WHERE depth < {d}) SELECT node, min(depth) AS depth FROM r GROUP BY node"


@query(_REACH.format(g=GRAPH, s=_id("Customer", "1"), d=2))
def reach_2(spark, sf):
    return graph.reach(graph.adjacency(links(spark, sf)), _seed(spark, CUSTOMER, "1"), 2)[0].select("node", "depth")


@query(_REACH.format(g=GRAPH, s=_id("Customer", "1"), d=3))
def reach_3(spark, sf):
    return graph.reach(graph.adjacency(links(spark, sf)), _seed(spark, CUSTOMER, "1"), 3)[0].select("node", "depth")


@query(_REACH.format(g=GRAPH, s=_id("Customer", "1"), d=2))
def reach_recursive(spark, sf):
    return graph.reach_sql(spark, links(spark, sf), _seed(spark, CUSTOMER, "1").first()["node"], 2)


@query(f"WITH RECURSIVE {GRAPH}, r AS (SELECT {_id('Region', '1')} AS node, 0 AS depth, '' AS path UNION SELECT src, depth + 1, trim(predicate || ' ' || path) FROM r JOIN links ON dst = node WHERE depth < 4 AND predicate <> 'supplier_in') SELECT node, min(depth) AS depth, min(path) AS path FROM r WHERE depth > 0 GROUP BY node")
def lineage(spark, sf):
    return graph.lineage(links(spark, sf), _seed(spark, REGION, "1"), ["in_region", "based_in", "placed_by"], 4)


@query(f"WITH RECURSIVE {GRAPH}, r AS (SELECT id AS root, id AS node FROM nodes WHERE type = 'Region' UNION SELECT root, b FROM r JOIN adj ON a = node WHERE predicate <> 'supplier_in'), c AS (SELECT node, min(root) AS root FROM r GROUP BY node), low AS (SELECT root, min(node) AS component FROM c GROUP BY root) SELECT node, component FROM c JOIN low USING (root)")
def components(spark, sf):
    return graph.components(links(spark, sf, ("in_region", "based_in", "placed_by")))


def _routes(spark, sf):
    ends = nodes(spark, sf, ("customer",)).select(F.col("id").alias("src")).crossJoin(F.broadcast(_seed(spark, REGION, "1").withColumnRenamed("node", "dst")))  # one row
    return graph.walks(graph.adjacency(links(spark, sf, ("in_region", "based_in")), both_ways=False), ends, 2)


_ROUTES = f"routes AS (SELECT a.src, b.dst, a.id || ' ' || b.id AS signature FROM links a JOIN links b ON a.dst = b.src WHERE a.predicate = 'based_in' AND b.predicate = 'in_region' AND b.dst = {_id('Region', '1')})"


@query(f"WITH {GRAPH}, {_ROUTES} SELECT src, dst, signature, 2::BIGINT AS length FROM routes")
def simple_paths(spark, sf):
    return _routes(spark, sf).select("src", "dst", F.concat_ws(" ", "links").alias("signature"), F.col("length").cast("long").alias("length"))


@query(f"WITH {GRAPH}, {_ROUTES} SELECT src, dst, 0.32::DOUBLE AS score, signature FROM routes ORDER BY signature LIMIT 8")
def path_flow(spark, sf):
    return graph.path_flow(_routes(spark, sf), {"based_in": 0.5}).select("src", "dst", "score", "signature")


def _spread(rounds: int) -> str:
    """SQL of some rounds of the walk from one customer, a step a round."""
    first = "p0 AS (SELECT DISTINCT a AS node, CASE WHEN a = " + _id("Customer", "1") + " THEN 1.0::DOUBLE ELSE 0 END AS score FROM adj), deg AS (SELECT a, count(*) AS n FROM adj GROUP BY a)"
    step = "p{k} AS (SELECT h.node, 0.15 * h.score + 0.85 * coalesce(g.got, 0) AS score FROM p0 h LEFT JOIN (SELECT b AS node, sum(score / n) AS got FROM p{j} JOIN adj ON adj.a = p{j}.node JOIN deg ON deg.a = adj.a GROUP BY b) g USING (node))"
    return ", ".join([first, *[step.format(k=k, j=k - 1) for k in range(1, rounds + 1)]])


@query(f"WITH {GRAPH}, {_spread(12)} SELECT node, round(score, 6) AS score FROM p12 ORDER BY score DESC, node LIMIT 12")
def pagerank(spark, sf):
    return graph.diffuse(links(spark, sf), _seed(spark, CUSTOMER, "1"), rounds=12)


@query()
def communities(spark, sf):
    return graph.communities(links(spark, sf, ("in_region", "supplier_in")))


@query(f"WITH {GRAPH}, near AS (SELECT {_id('Customer', '1')} AS node UNION SELECT b FROM adj WHERE a = {_id('Customer', '1')}), wide AS (SELECT node FROM near UNION SELECT b FROM adj JOIN near ON a = node WHERE predicate = 'supplier_in') SELECT id, predicate = 'supplier_in' AS opposes FROM links WHERE (src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near)) OR (predicate = 'supplier_in' AND (src IN (SELECT node FROM near) OR dst IN (SELECT node FROM near)))")
def expand_objection(spark, sf):
    made = bundle.expand(links(spark, sf), _seed(spark, CUSTOMER, "1"), depth=1, limit=10**9, opposes=("supplier_in",))
    return made.links.select("id", F.col("opposes"))


@query(f"WITH {GRAPH}, near AS (SELECT {_id('Customer', '1')} AS node UNION SELECT b FROM adj WHERE a = {_id('Customer', '1')}) SELECT node, CASE WHEN node = {_id('Customer', '1')} THEN 'ranked 1.000; read twice' END AS reason FROM near UNION SELECT b, 'opposing supplier_in' FROM adj JOIN near ON a = node WHERE predicate = 'supplier_in' AND b NOT IN (SELECT node FROM near)")
def expand_reasons(spark, sf):
    seed = _seed(spark, CUSTOMER, "1")
    made = bundle.expand(links(spark, sf), seed, depth=1, limit=10**9, opposes=("supplier_in",), reasons=seed.select("node", F.lit("ranked 1.000").alias("reason")))
    return bundle.annotate(made, seed.select("node", F.lit("read twice").alias("said"))).nodes.select("node", "reason")


def _facts(spark, sf):
    return links(spark, sf, ("in_region", "based_in")).select(F.col("src").alias("s"), F.col("predicate").alias("p"), F.col("dst").alias("o"))


_LOC = f"base AS (SELECT {_id('Nation', 'n_nationkey')} AS s, 'in_region' AS p, {_id('Region', 'n_regionkey')} AS o FROM nation UNION SELECT {_id('Customer', 'c_custkey')}, 'based_in', {_id('Nation', 'c_nationkey')} FROM customer)"


@query(f"WITH {_LOC} SELECT s, p, o FROM base UNION SELECT s, 'located_in', o FROM base UNION SELECT a.s, 'located_in', b.o FROM base a JOIN base b ON a.o = b.s")
def rl_transitive(spark, sf):
    onto = Ontology(subproperties=ONTOLOGY.subproperties, transitive=ONTOLOGY.transitive)
    return reason.close(_facts(spark, sf), onto)[0].select("s", "p", "o")


def _fact(s: str, p: str, o: str) -> str:
    return f"substr(sha256(concat_ws(chr(0), {s}, {p}, {o})), 1, 16)"


@query(f"WITH {_LOC} SELECT {_fact('s', repr('located_in'), 'o')} AS fact, 'prp-spo1' AS rule, {_fact('s', 'p', 'o')} AS premises FROM base UNION SELECT {_fact('a.s', repr('located_in'), 'b.o')}, 'prp-trp', array_to_string(list_sort([{_fact('a.s', repr('located_in'), 'a.o')}, {_fact('b.s', repr('located_in'), 'b.o')}]), ' ') FROM base a JOIN base b ON a.o = b.s")
def rl_derivations(spark, sf):
    onto = Ontology(subproperties=ONTOLOGY.subproperties, transitive=ONTOLOGY.transitive)
    return reason.close(_facts(spark, sf), onto)[1].select("fact", "rule", F.concat_ws(" ", "premises").alias("premises"))


@query(f"WITH {_LOC} SELECT s, p, o FROM base UNION SELECT s, 'type', CASE p WHEN 'in_region' THEN 'Nation' ELSE 'Customer' END FROM base UNION SELECT o, 'type', CASE p WHEN 'in_region' THEN 'Region' ELSE 'Nation' END FROM base UNION SELECT s, 'type', CASE p WHEN 'in_region' THEN 'Place' ELSE 'Party' END FROM base UNION SELECT o, 'type', 'Place' FROM base UNION SELECT s, 'located_in', o FROM base")
def rl_domain_range(spark, sf):
    return reason.close(_facts(spark, sf), ONTOLOGY, rules=reason.RDFS)[0].select("s", "p", "o")


@query(f"SELECT DISTINCT {_id('Order', 'o_orderkey')} AS s, {_id('Nation', 'c_nationkey')} AS o FROM orders JOIN customer ON o_custkey = c_custkey")
def rl_chain(spark, sf):
    told = links(spark, sf, ("placed_by", "based_in")).select(F.col("src").alias("s"), F.col("predicate").alias("p"), F.col("dst").alias("o"))
    return reason.close(told, Ontology(chains=ONTOLOGY.chains))[0].where("p = 'ordered_from'").select("s", "o")


@query(f"SELECT DISTINCT 'cax-dw' AS rule, {_id('Customer', 'c_custkey')} AS node, 'Customer Supplier' AS detail FROM customer WHERE c_acctbal < 0")
def rl_clash_disjoint(spark, sf):
    c = load(spark, sf, "customer")
    told = c.select(node_id(CUSTOMER).alias("s"), F.lit("type").alias("p"), F.lit("Customer").alias("o")).unionByName(c.where("c_acctbal < 0").select(node_id(CUSTOMER).alias("s"), F.lit("type").alias("p"), F.lit("Supplier").alias("o")))
    return reason.clashes(told, ONTOLOGY)


@query(f"WITH {_LOC}, kept AS (SELECT * FROM base WHERE NOT (p = 'in_region' AND o = {_id('Region', '1')})) SELECT count(*) AS n FROM (SELECT s, p, o FROM kept UNION SELECT s, 'located_in', o FROM kept UNION SELECT a.s, 'located_in', b.o FROM kept a JOIN kept b ON a.o = b.s)")
def supported_after_retraction(spark, sf):
    onto = Ontology(subproperties=ONTOLOGY.subproperties, transitive=ONTOLOGY.transitive)
    facts, derivations, _ = reason.close(_facts(spark, sf), onto)
    gone = facts.where("NOT derived AND p = 'in_region'").join(_seed(spark, REGION, "1").withColumnRenamed("node", "o"), "o", "left_semi")
    return reason.supported(facts, derivations, gone).agg(F.count("*").alias("n"))


_TOK = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}\p{M}_]+(?:[-''][\p{L}\p{N}\p{M}_]+)*')"
_POST = f"post AS (SELECT node, term, count(*) AS tf FROM (SELECT doc_id AS node, unnest({_TOK}) AS term FROM documents) GROUP BY ALL), len AS (SELECT doc_id AS node, len({_TOK}) AS n FROM documents)"


@query(f"WITH {_POST} SELECT term, sum(tf)::BIGINT AS tf, count(*) AS nodes FROM post GROUP BY term")
def index_postings(spark, sf):
    return rank.postings(load(spark, sf, "documents"), "doc_id").groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("nodes"))


_RANK = f"{_POST}, hit AS (SELECT node, count(DISTINCT term) AS shared FROM post WHERE term IN ('the', 'est', 'und', 'que') GROUP BY node), scored AS (SELECT node, round(shared / sqrt(greatest(n, 1)), 6) AS score FROM hit JOIN len USING (node))"


def _ranked(spark, sf, limit):
    return rank.score_texts(load(spark, sf, "documents"), ["the", "est", "und", "que"], limit, "doc_id")


@query(f"WITH {_RANK} SELECT node, score FROM scored ORDER BY score DESC, node LIMIT 8")
def rank_indexed(spark, sf):
    docs = load(spark, sf, "documents")
    return rank.retrieve(rank.postings(docs, "doc_id"), rank.lengths(docs, "doc_id"), ["the", "est", "und", "que"], 8)


@query(f"WITH {_RANK}, weight AS (SELECT source, round(sum(score), 6) AS w FROM scored JOIN documents ON doc_id = node GROUP BY source ORDER BY w DESC, source LIMIT 2) SELECT doc_id AS node, w AS score FROM documents JOIN weight USING (source) ORDER BY w DESC, doc_id LIMIT 50")
def rank_routed(spark, sf):
    groups = load(spark, sf, "documents").select(F.col("doc_id").alias("node"), F.col("source").alias("topic"))
    return rank.retrieve_routed(_ranked(spark, sf, None), groups, True, top=2)[0]


@query(f"WITH {_RANK} SELECT node, score FROM scored ORDER BY score DESC, node LIMIT 8")
def rank_overlap(spark, sf):
    return _ranked(spark, sf, 8)


@query(f"WITH {_RANK}, topic AS (SELECT source, round(max(score), 6) AS t FROM scored JOIN documents ON doc_id = node GROUP BY source), both_ AS (SELECT doc_id AS node, coalesce(score, 0) AS d, coalesce(t, 0) / 2 AS t FROM documents LEFT JOIN scored ON node = doc_id LEFT JOIN topic USING (source)) SELECT node, greatest(d, t) AS score, CASE WHEN d >= t THEN 'direct' ELSE 'topic' END AS via FROM both_ ORDER BY score DESC, node LIMIT 8")
def rank_dual(spark, sf):
    groups = load(spark, sf, "documents").select(F.col("doc_id").alias("node"), F.col("source").alias("topic"))
    direct = _ranked(spark, sf, None)
    topics = direct.join(groups, "node").groupBy("topic").agg((F.round(F.max("score"), 6) / 2).alias("score"))
    return rank.retrieve_dual(direct, groups, topics)


@query(f"WITH {_POST}, c AS (SELECT source, term, sum(tf)::BIGINT AS n, row_number() OVER (PARTITION BY source ORDER BY sum(tf) DESC, term) AS rank FROM post JOIN documents ON doc_id = node GROUP BY source, term) SELECT source AS topic, term, n, rank FROM c WHERE rank <= 8")
def topic_terms(spark, sf):
    docs = load(spark, sf, "documents")
    return rank.topic_terms(rank.postings(docs, "doc_id"), docs.select(F.col("doc_id").alias("node"), F.col("source").alias("topic")))


@query("WITH p AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9_]+(?:[-''][a-z0-9_]+)*')) AS a, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9_]+(?:[-''][a-z0-9_]+)*')) AS b FROM part) SELECT p_partkey, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END::DOUBLE AS score FROM p")
def term_jaccard(spark, sf):
    return load(spark, sf, "part").select("p_partkey", jaccard(tokens(F.col("p_name")), tokens(F.col("p_type"))).alias("score"))


@query(f"SELECT {_id('Order', 'o_orderkey')} AS id, 'priority' AS field FROM orders")
def validate_fields(spark, sf):
    declared = spark.createDataFrame([("Order", "status"), ("Customer", "name"), ("Customer", "segment")], "type string, field string")
    return validate.undeclared_fields(nodes(spark, sf, ("orders", "customer")), declared)


@query(f"SELECT substr(sha256(concat_ws(chr(0), {_id('Supplier', 's_suppkey')}, 'based_in', {_id('Nation', 's_nationkey')})), 1, 16) AS id, 'domain' AS finding FROM supplier")
def signature_check(spark, sf):
    wrong = map_links(load(spark, sf, "supplier"), LinkMap("based_in", SUPPLIER, NodeMap("Nation", "s_nationkey")))
    return validate.signature_findings(wrong.unionByName(links(spark, sf)), nodes(spark, sf), ONTOLOGY)


@query(f"SELECT {_id('Customer', 'c_custkey')} AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 5")
def shacl_cardinality(spark, sf):
    placed = links(spark, sf, ("placed_by",)).select("id", "predicate", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return validate.cardinality_findings(nodes(spark, sf, ("customer",)), placed, "Customer", "placed_by", 5)


@query(r"SELECT doc_id::VARCHAR AS id, f.finding AS finding, f.detail AS detail FROM (SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 9 = 0 THEN {'finding': 'untyped', 'detail': ''} WHEN coalesce(trim(source), '') = '' OR source = 'Order' THEN {'finding': 'unnamed', 'detail': ''} END, CASE WHEN length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) < 40 THEN {'finding': 'thin', 'detail': ''} END, CASE WHEN source <> '' AND NOT contains(lower(coalesce(text, '')), lower(source)) THEN {'finding': 'ungrounded', 'detail': 'name'} END, CASE WHEN contains(lower(coalesce(text, '')), 'no ') THEN {'finding': 'negation', 'detail': 'No '} END], lambda x: x IS NOT NULL)) AS f FROM documents)")
def critique(spark, sf):
    d = load(spark, sf, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 9 == 0, "Nothing").otherwise("Order").alias("type"), F.create_map(F.lit("name"), F.col("source")).alias("fields"), F.col("text").alias("quote"))
    return validate.critique(rows, ONTOLOGY, least_quote=40, grounded=("name",), negations=("No ",))


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a::VARCHAR AS node FROM r WHERE a = b")
def cycle_nodes(spark, sf):
    n = load(spark, sf, "nation").select(F.lit("next").alias("predicate"), F.col("n_nationkey").cast("string").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("string").alias("dst"))
    return validate.cycles(n, "next")


_SPANS = "sp AS (SELECT doc_id, 5 AS s, 5 + least(10, greatest(length(text) - 5, 0)) AS e, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE substr(text, 6, 10) END AS quote, text FROM documents)"


def _spans(spark, sf):
    d = load(spark, sf, "documents")
    end = F.lit(5) + F.least(F.lit(10), F.greatest(F.length("text") - 5, F.lit(0)))
    quote = F.when(F.col("doc_id") % 7 == 0, F.lit("changed")).otherwise(F.substring("text", 6, 10))
    return d.select("doc_id", F.lit(5).alias("start"), end.alias("end"), quote.alias("quote"), "text")


@query(f"WITH {_SPANS} SELECT doc_id, coalesce(substr(text, s + 1, e - s) = quote, false) AS holds FROM sp")
def span_reslice(spark, sf):
    return _spans(spark, sf).select("doc_id", reslices(F.col("text"), F.col("start"), F.col("end"), F.col("quote")).alias("holds"))


@query(f"WITH {_SPANS} SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing source' WHEN NOT coalesce(substr(text, s + 1, e - s) = quote, false) THEN 'drifted span' WHEN doc_id % 13 = 0 THEN 'unknown version' END AS reason FROM sp")
def federation_check(spark, sf):
    d = load(spark, sf, "documents")
    spans = _spans(spark, sf).select("doc_id", F.col("doc_id").alias("source_id"), F.lit(1).alias("segment"), "start", "end", "quote", F.when(F.col("doc_id") % 13 == 0, "v0").otherwise("v1").alias("version"))
    return evidence.federation_check(spans, d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("id")), d.select(F.col("doc_id").alias("source_id"), F.lit(1).alias("number"), "text"), ["v1"]).select("doc_id", "reason")


@query("WITH h AS (SELECT sha256(text) AS s, count(DISTINCT source) AS r FROM documents GROUP BY 1), pair AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 10 = 3 AND doc_id + 1 IN (SELECT doc_id FROM documents)) SELECT (SELECT count(*) FROM h) AS sources, (SELECT count(DISTINCT source) FROM documents) AS registries, (SELECT sum((r > 1)::BIGINT)::BIGINT FROM h) AS republished, (SELECT count(DISTINCT doc_id) FROM documents) - (SELECT count(*) FROM pair) AS individuals, (SELECT count(*) FROM pair) AS identified")
def independence(spark, sf):
    d = load(spark, sf, "documents")
    pairs = d.select(F.col("doc_id").alias("a"), F.when(F.col("doc_id") % 10 == 3, F.col("doc_id") + 1).when(F.col("doc_id") % 10 == 7, -F.col("doc_id")).alias("b")).where("b IS NOT NULL")
    return evidence.independence(d.select(F.sha2("text", 256).alias("source_id"), F.col("source").alias("registry"), F.col("doc_id").alias("node")), pairs)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN round(p_size * 2.54, 6) WHEN p_partkey % 3 = 1 THEN p_size::DOUBLE END AS converted FROM part")
def compare_units(spark, sf):
    rows = load(spark, sf, "part").select("p_partkey", F.col("p_size").alias("value"), F.element_at(F.array(F.lit("in"), F.lit("cm"), F.lit("?")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("unit"))
    return evidence.convert(rows, [("in", "cm", 2.54)], "cm").select("p_partkey", F.round("converted", 6).alias("converted"))


_POSITION = "SELECT o_custkey AS about, o_orderkey::VARCHAR AS id, nullif(lower(o_orderpriority), '') AS x, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS y, CASE WHEN o_orderkey % 17 <> 0 THEN 's' || (o_orderkey % 5) END AS s, 'q' || (o_orderkey % 7) AS q, o_orderkey % 2 AS side FROM orders"


@query(f"WITH p AS ({_POSITION}), j AS (SELECT a.about, a.id AS supporting, b.id AS opposing, a.s AS s1, b.s AS s2, a.q AS q1, b.q AS q2, array_to_string(list_filter([CASE WHEN a.x <> b.x THEN 'priority' END, CASE WHEN a.y <> b.y THEN 'status' END], lambda v: v IS NOT NULL), ' ') AS d FROM p a JOIN p b USING (about) WHERE a.side = 0 AND b.side = 1), v AS (SELECT *, CASE WHEN s1 IS NULL OR s2 IS NULL THEN 'ambiguous' WHEN q1 = q2 THEN 'extraction' WHEN d <> '' THEN 'conditions' WHEN s1 = s2 THEN 'ambiguous' ELSE 'disagreement' END AS verdict FROM j) SELECT about, supporting, opposing, verdict, CASE WHEN verdict = 'conditions' THEN d ELSE '' END AS differing FROM v")
def reconcile(spark, sf):
    k = F.col("o_orderkey")
    conditions = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.when(k % 3 == 0, None).otherwise(F.col("o_orderstatus")))
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("about"), k.cast("string").alias("id"), conditions.alias("conditions"), F.when(k % 17 != 0, F.concat(F.lit("s"), k % 5)).alias("source_id"), F.concat(F.lit("q"), k % 7).alias("quote"), (k % 2).alias("side"))
    return evidence.reconcile(o.where("side = 0"), o.where("side = 1")).drop("reason")


@query("WITH r AS (SELECT o_orderkey AS id, lower(o_orderpriority) AS x, CASE WHEN o_orderkey % 3 > 0 THEN lower(o_orderstatus) END AS y, o_totalprice AS v, CASE o_orderkey % 4 WHEN 0 THEN 'usd' WHEN 1 THEN 'eur' WHEN 2 THEN '' ELSE 'yen' END AS u FROM orders), b AS (SELECT * FROM r WHERE u = 'usd' AND y IS NOT NULL ORDER BY id LIMIT 1), j AS (SELECT r.*, r.x = b.x AS sx, r.y = b.y AS sy FROM r, b WHERE r.id <> b.id), k AS (SELECT *, array_to_string(list_filter([CASE WHEN sx THEN 'priority' END, CASE WHEN sy THEN 'status' END], lambda v: v IS NOT NULL), ' ') AS matched, array_to_string(list_filter([CASE WHEN NOT sx THEN 'priority' END, CASE WHEN NOT sy THEN 'status' END], lambda v: v IS NOT NULL), ' ') AS differed, CASE WHEN y IS NULL THEN 'status' ELSE '' END AS missing FROM j) SELECT id, CASE WHEN u = 'yen' THEN 'insufficient' WHEN missing <> '' THEN 'insufficient' WHEN differed <> '' THEN 'partial' ELSE 'comparable' END AS verdict, matched, differed, missing, CASE WHEN u = 'eur' THEN round(v * 1.25, 4) END AS converted FROM k")
def compare_baseline(spark, sf):
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(F.lit("usd"), F.lit("eur"), F.lit(""), F.lit("yen")), (k % 4 + 1).cast("int"))
    conditions = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.when(k % 3 > 0, F.col("o_orderstatus")))
    o = load(spark, sf, "orders").select(k.alias("id"), conditions.alias("conditions"), F.col("o_totalprice").alias("value"), unit.alias("unit"))
    base = o.where("unit = 'usd' AND id % 3 > 0").orderBy("id").limit(1)
    return evidence.compare(o, base, [("usd", "eur", 0.8)]).drop("reason").withColumn("converted", F.round("converted", 4))


@query()
def align_steps(spark, sf):
    c = load(spark, sf, "conversations").withColumn("label", F.col("text"))
    planned = c.where("role = 'user'").select(F.col("conv_id").alias("plan"), F.col("turn").alias("nth"), "label")
    actual = c.where("role = 'assistant'").select(F.col("conv_id").alias("plan"), F.col("turn").alias("nth"), "label")
    return evidence.align(planned, actual, 0.1)


@query("WITH l AS (SELECT l_orderkey AS plan, l_partkey AS part, l_linenumber AS nth FROM lineitem), p AS (SELECT plan, part, min(nth) AS i FROM l GROUP BY plan, part), q AS (SELECT plan, part, 100 - max(nth) AS j FROM l GROUP BY plan, part HAVING part % 5 > 0), m AS (SELECT p.plan, p.i, q.j, coalesce(lag(q.j) OVER (PARTITION BY p.plan, q.j IS NULL ORDER BY p.i, p.part) > q.j, false) AS r FROM p LEFT JOIN q USING (plan, part)) SELECT plan, i::BIGINT AS planned_nth, j::BIGINT AS actual_nth, CASE WHEN j IS NULL THEN 'missing' ELSE 'same' END AS verdict, j IS NOT NULL AND r AS reordered FROM m")
def align_lines(spark, sf):
    """Parts of an order as planned, and as shipped in another order with some left out."""
    l = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("i"), (100 - F.max("l_linenumber")).alias("j"))
    label = F.concat(F.lit("part"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"))
    planned = l.select(F.col("l_orderkey").alias("plan"), F.col("i").alias("nth"), label.alias("label"))
    actual = l.where("l_partkey % 5 > 0").select(F.col("l_orderkey").alias("plan"), F.col("j").alias("nth"), label.alias("label"))
    return evidence.align(planned, actual).select("plan", "planned_nth", "actual_nth", "verdict", "reordered")


@query("WITH w AS (SELECT p_partkey AS seq, p_brand AS source, lower(p_type) AS label, list_sort(string_split(lower(p_type), ' ')) AS k FROM part), f AS (SELECT k, first(label ORDER BY seq, label) AS term, first(label ORDER BY length(label), label) AS label, count(DISTINCT source) AS support FROM w GROUP BY k) SELECT term, support FROM f")
def induce_pool(spark, sf):
    """Types whose words are the same ones, in any order, are pooled."""
    parts = load(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_type").alias("label"), F.col("p_brand").alias("source_id"))
    return evidence.pooled_labels(parts, 1.0).select("term", "support")


@query("SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size % 4 = 0 THEN 'unsupported' WHEN p_size % 3 = 0 THEN 'lossy' WHEN p_size % 5 = 0 THEN 'unsupported' ELSE 'exact' END AS profile, CASE WHEN p_size % 4 > 0 AND p_size % 3 > 0 AND p_size % 5 > 0 THEN CASE WHEN p_size % 2 = 0 THEN 'disjoint' ELSE 'subclass' END END AS form FROM part WHERE NOT (p_size % 4 > 0 AND p_size % 3 = 0 AND p_size % 5 = 0)")
def unit_forms(spark, sf):
    z = F.col("p_size")
    units = load(spark, sf, "part").where("NOT (p_size % 4 > 0 AND p_size % 3 = 0 AND p_size % 5 = 0)").select(
        F.col("p_partkey").cast("string").alias("id"), F.when(z % 5 == 0, "rhetorical").otherwise("Universal").alias("kind"), F.when(z % 3 > 0, F.when(z % 2 == 0, "no").otherwise("all")).alias("quantifier"),
        F.when(z % 4 > 0, "affirmative").otherwise("").alias("polarity"), F.lit(None).cast("string").alias("modality"), F.col("p_brand").alias("subject_term"), F.col("p_type").alias("object_term"),
    )
    return evidence.translated(evidence.unit_forms(units, ("universal",)), {"all": "all", "no": "none"}).select("id", "profile", "form")


@query(r"WITH w AS (SELECT doc_id AS source_id, i, substr(text, i::BIGINT * 500 + 1, 500) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / 500)::BIGINT))) AS i FROM documents)) SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY i) AS number, sha256(text) AS digest FROM w WHERE NOT regexp_full_match(text, '\s*')")
def segments_window(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), "text")
    return cut(docs, "window", 500).select("source_id", F.col("number").cast("long").alias("number"), F.sha2("text", 256).alias("digest"))


@query("SELECT o_orderkey, 'o_orderkey: ' || o_orderkey || ' | o_orderpriority: ' || coalesce(o_orderpriority, '') || ' | o_clerk: ' || CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus ELSE '' END || chr(10) AS rendered FROM orders")
def render_rows(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("o_clerk"))
    return rows.select("o_orderkey", render(["o_orderkey", "o_orderpriority", "o_clerk"]).alias("rendered"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'made by [' || p_brand || '] and [nobody]' || chr(10) || 'kind [' || p_type || ']' WHEN p_size % 3 = 1 THEN 'made by [' || p_brand || '] and [nobody]' ELSE '' END AS kept FROM part")
def answer_cited(spark, sf):
    said = F.concat(F.lit("made by ["), "p_brand", F.lit("] and [nobody]\nno source\nkind ["), "p_type", F.lit("]\n[other] says so"))
    known = F.when(F.col("p_size") % 3 == 0, F.array("p_type", "p_brand")).when(F.col("p_size") % 3 == 1, F.array("p_brand")).otherwise(F.array(F.lit("none")))
    return load(spark, sf, "part").select("p_partkey", keep_cited(said, known).alias("kept"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_per_hour(spark, sf):
    return counts_per_window(load(spark, sf, "events"))


_QUOTES = "q AS (SELECT conv_id, turn, text, trim(substr(text, 6, 30)) AS piece FROM conversations WHERE length(trim(substr(text, 6, 30))) >= 12 AND NOT regexp_matches(text, '[\\s][\\s]') AND NOT contains(text, chr(10)))"


def _quotes(spark, sf):
    c = load(spark, sf, "conversations")
    piece = F.trim(F.substring("text", 6, 30))
    some = c.where((F.length(piece) >= 12) & ~F.col("text").rlike(r"\s\s") & ~F.col("text").contains("\n"))
    quote = F.when(F.col("turn") % 3 == 0, F.replace(piece, F.lit(" "), F.lit("  "))).otherwise(piece)
    asked = some.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("conv_id").alias("source_id"), F.col("turn").cast("int").alias("segment"), quote.alias("quote"))
    return asked, c.select(F.col("conv_id").alias("source_id"), F.col("turn").cast("int").alias("number"), "text")


@query(f"WITH {_QUOTES} SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS id, turn::INTEGER AS segment, (instr(text, piece) - 1)::INTEGER AS start, (instr(text, piece) - 1 + length(piece))::INTEGER AS stop, CASE WHEN turn % 3 = 0 AND contains(piece, ' ') THEN 'normalised' ELSE 'exact' END AS method FROM q")
def locate_quotes(spark, sf):
    placed = locate.locate(*_quotes(spark, sf))
    return placed.select("id", F.col("span.segment").alias("segment"), F.col("span.start").alias("start"), F.col("span.end").alias("stop"), "method")


@query("SELECT n_nationkey::VARCHAR AS id, 'second ' || n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS assertions FROM nation UNION ALL SELECT 'gone', 'kept', 2")
def store_projection(spark, sf):
    """Nodes asserted twice, the odd ones again, and one whose second assertion is withdrawn by a third."""
    held = store.MemoryStore(spark)
    n = load(spark, sf, "nation")
    node = lambda d, name: d.select(F.col("id"), F.lit("Nation").alias("type"), F.create_map(F.lit("name"), name).alias("fields"))
    rows = n.select(F.col("n_nationkey").cast("string").alias("id"), "n_name", "n_nationkey")
    held.assert_("2024-01-01", node(rows.where("n_nationkey % 2 = 1"), F.col("n_name")))
    held.assert_("2024-01-02", node(rows, F.concat(F.lit("second "), "n_name")))
    one = spark.range(1).select(F.lit("gone").alias("id"))
    held.assert_("2024-01-03", node(one, F.lit("wrong")))
    held.assert_("2024-01-01", node(one, F.lit("kept")), supersedes=held.assertions("gone").first()["id"])
    counts = held.assertions().groupBy(F.col("target_id").alias("id")).agg(F.count("*").cast("int").alias("assertions"))
    return held.nodes().select("id", F.col("fields")["name"].alias("name")).join(counts, "id")


@query(WITH + "SELECT '<urn:graph:' || id || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:graph:' || type || '> .' AS line FROM nodes WHERE type IN ('Nation', 'Region') UNION ALL SELECT '<urn:graph:' || " + _id("Nation", "n_nationkey") + " || '> <urn:graph:name> \"' || n_name || '\" .' FROM nation UNION ALL SELECT '<urn:graph:' || " + _id("Region", "r_regionkey") + " || '> <urn:graph:name> \"' || r_name || '\" .' FROM region UNION ALL SELECT '<urn:graph:' || src || '> <urn:graph:in_region> <urn:graph:' || dst || '> .' FROM links WHERE predicate = 'in_region' UNION ALL SELECT '<urn:graph:' || id || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#' || unnest(['subject', 'predicate', 'object']) || '> <urn:graph:' || unnest([src, predicate, dst]) || '> .' FROM links WHERE predicate = 'in_region'")
def rdf_lines(spark, sf):
    return ontology.graph_triples(nodes(spark, sf, ("nation", "region")), links(spark, sf, ("in_region",)))


_NATIONS = f"base AS (SELECT {_id('Nation', 'n_nationkey')} AS s, {_id('Region', 'n_regionkey')} AS o FROM nation)"


@query(f"WITH {_NATIONS} SELECT s, 'in_region' AS p, o FROM base UNION SELECT a.s, 'same_as', b.s FROM base a JOIN base b ON a.o = b.o AND a.s <> b.s")
def rl_inverse_functional(spark, sf):
    """Were a region of one nation only, its nations would be one."""
    told = links(spark, sf, ("in_region",)).select(F.col("src").alias("s"), F.col("predicate").alias("p"), F.col("dst").alias("o"))
    return reason.close(told, Ontology(inverse_functional=frozenset({"in_region"})))[0].select("s", "p", "o")


@query(f"WITH n AS (SELECT {_id('Nation', 'n_nationkey')} AS id, n_nationkey FROM nation WHERE n_regionkey = 1) SELECT id, 'Home' AS type FROM n UNION SELECT {_id('Customer', 'c_custkey')}, 'Local' FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n) UNION SELECT {_id('Region', '1')}, 'Known'")
def rl_expressions(spark, sf):
    region = _seed(spark, REGION, "1").first()["node"]
    onto = Ontology(rules=frozenset({(("and", "Nation", ("value", "in_region", region)), "Home"), (("some", "based_in", "Home"), "Local"), ("Home", ("only", "in_region", "Known"))}))
    made = reason.entail(nodes(spark, sf, ("nation", "customer")), links(spark, sf, ("in_region", "based_in")), onto)
    return made["typings"]


@query(f"SELECT DISTINCT 'cls-maxc' AS rule, {_id('Nation', 'c_nationkey')} AS node FROM customer UNION SELECT DISTINCT 'cls-com', {_id('Customer', 'c_custkey')} FROM customer WHERE c_nationkey = 3 UNION SELECT 'prp-irp', {_id('Region', 'r_regionkey')} FROM region")
def rl_clashes(spark, sf):
    told = links(spark, sf, ("based_in",)).select(F.col("dst").alias("s"), F.lit("base_of").alias("p"), F.col("src").alias("o"))
    typed = told.select(F.col("s"), F.lit("type").alias("p"), F.lit("Empty").alias("o")).distinct()
    regions = nodes(spark, sf, ("region",)).select(F.col("id").alias("s"), F.lit("within").alias("p"), F.col("id").alias("o"))
    third = _seed(spark, NATION, "3").first()["node"]
    onto = Ontology(rules=frozenset({("Empty", ("max", 0, "base_of", "Thing")), (("value", ("base_of", True), third), ("not", ("value", ("base_of", True), third)))}), irreflexive=frozenset({"within"}))
    return reason.clashes(told.unionByName(typed).unionByName(regions), onto).select("rule", "node").distinct()


@query(WITH + "SELECT (SELECT count(*) FROM links WHERE predicate IN ('placed_by', 'based_in')) + (SELECT count(DISTINCT (o.src, c.dst)) FROM links o JOIN links c ON o.dst = c.src WHERE o.predicate = 'placed_by' AND c.predicate = 'based_in') AS links, (SELECT count(*) FROM links o JOIN links c ON o.dst = c.src WHERE o.predicate = 'placed_by' AND c.predicate = 'based_in') AS derived")
def expand_entailed(spark, sf):
    """The package around all customers over told and derived links."""
    told = links(spark, sf, ("placed_by", "based_in"))
    made = reason.entail(nodes(spark, sf, ("orders", "customer", "nation")), told, Ontology(chains=ONTOLOGY.chains))
    seeds = nodes(spark, sf, ("customer", "nation")).select(F.col("id").alias("node"))
    found = bundle.expand_entailed(told, seeds, made, depth=1, limit=10**9)
    return found.links.agg(F.count("*").alias("links"), F.count_if("derived").alias("derived"))


PART = NodeMap("Part", "p_partkey", {"name": "p_name", "brand": "p_brand"})


@query(f"SELECT {_id('Part', 'p_partkey')} AS id, p_name AS name, p_brand AS brand FROM part")
def map_parts(spark, sf):
    return map_nodes(load(spark, sf, "part"), PART).select("id", F.col("fields")["name"].alias("name"), F.col("fields")["brand"].alias("brand"))


_LINES = f"(SELECT DISTINCT {_id('Order', 'l_orderkey')} AS src, 'ordered_part' AS predicate, {_id('Part', 'l_partkey')} AS dst FROM lineitem UNION SELECT DISTINCT {_id('Part', 'l_partkey')}, 'supplied_by', {_id('Supplier', 'l_suppkey')} FROM lineitem)"


def _lines(spark, sf):
    rows = load(spark, sf, "lineitem")
    part = NodeMap("Part", "l_partkey")
    return union([map_links(rows, LinkMap("ordered_part", NodeMap("Order", "l_orderkey"), part)), map_links(rows, LinkMap("supplied_by", part, NodeMap("Supplier", "l_suppkey")))])


@query(f"SELECT substr(sha256(concat_ws(chr(0), src, predicate, dst)), 1, 16) AS id, predicate, src, dst FROM {_LINES}")
def map_lineitems(spark, sf):
    return _lines(spark, sf)


@query(f"WITH l AS (SELECT * FROM {_LINES}) SELECT DISTINCT a.src AS o, b.dst AS s FROM l a JOIN l b ON a.dst = b.src WHERE a.predicate = 'ordered_part' AND b.predicate = 'supplied_by'")
def cq_supplier_of_order(spark, sf):
    empty = nodes(spark, sf, ("region",)).where("false")
    return conjunctive.answer("q(?o, ?s) :- ordered_part(?o, ?p), supplied_by(?p, ?s)", empty, _lines(spark, sf), ONTOLOGY)


@query(f"WITH o AS (SELECT {_id('Order', 'o_orderkey')} AS id, * FROM orders), n AS (SELECT o.id, count(l.dst) AS n FROM o LEFT JOIN {_LINES} l ON l.src = o.id AND l.predicate = 'ordered_part' GROUP BY o.id) SELECT id, 'minCount' AS finding, 'violation' AS severity FROM n WHERE n < 2 UNION ALL SELECT id, 'maxCount', 'violation' FROM n WHERE n > 6 UNION ALL SELECT id, 'minLength', 'warning' FROM o WHERE length(o_orderpriority) < 6")
def shacl_shapes(spark, sf):
    shapes = [validate.Shape("Order", "ordered_part", at_least=2, at_most=6), validate.Shape("Order", "priority", field=True, min_length=6, severity="warning")]
    return validate.shape_findings(nodes(spark, sf, ("orders",)), _lines(spark, sf), shapes, ONTOLOGY).select("id", "finding", "severity")


@query(f"WITH o AS (SELECT {_id('Order', 'o_orderkey')} AS id FROM orders), n AS (SELECT o.id, count(l.dst) AS n FROM o LEFT JOIN {_LINES} l ON l.src = o.id AND l.predicate = 'ordered_part' GROUP BY o.id) SELECT src, dst FROM {_LINES} WHERE predicate = 'ordered_part' AND src NOT IN (SELECT id FROM n WHERE n < 2 OR n > 6)")
def shacl_kept(spark, sf):
    shapes = [validate.Shape("Order", "ordered_part", at_least=2, at_most=6)]
    ordered = _lines(spark, sf).where("predicate = 'ordered_part'")
    return validate.shacl_validate(nodes(spark, sf, ("orders",)), ordered, shapes, ONTOLOGY)["links"].select("src", "dst")
