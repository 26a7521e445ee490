"""Forward chaining over triples by the OWL 2 RL rules: a loop of joins, one a rule, with derivations kept.

Facts are (s, p, o) with ids; ``type`` facts name a node's classes and ``same_as`` facts its identities.
Class expressions are names or tuples: ("and", a, b, ...), ("or", a, b, ...), ("not", a),
("some", property, a), ("only", property, a), ("value", property, node), ("max", 0 or 1, property, a).
A property is a name, or (name, True) where it is read backwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions.text import content_id
from spanweave.plans.ontology import Ontology
from spanweave.session import materialize

TYPE, SAME, ANY, NONE = "type", "same_as", "Thing", "Nothing"
#: The rules that are RDFS entailment.
RDFS = ("prp-dom", "prp-rng", "prp-spo1", "cax-sco")
_KIND = {"and": "cls-int", "or": "cls-uni", "some": "cls-svf", "value": "cls-hv"}
_SHAPE = "s string, p string, o string, rule string, premises array<string>"
c = F.col


def _small(spark, rows, schema):
    return F.broadcast(spark.createDataFrame(sorted(rows), schema))  # axioms, not data


def _role(prop) -> tuple[str, bool]:
    return (prop, False) if isinstance(prop, str) else (prop[0], bool(prop[1]))


def _edges(facts: DataFrame, prop, x: str = "x", y: str = "y", i: str = "e") -> DataFrame:
    """(x, y, e) of a property, read the way it says."""
    name, back = _role(prop)
    s, o = ("o", "s") if back else ("s", "o")
    return facts.where(c("p") == name).select(c(s).alias(x), c(o).alias(y), c("id").alias(i))


def holds(expression, facts: DataFrame) -> DataFrame:
    """(x, premises): the nodes that facts show to be of a class expression, each with one proof."""
    if isinstance(expression, str):
        if expression == ANY:
            every = facts.select(c("s").alias("x")).union(facts.where(c("p") != TYPE).select("o")).distinct()
            return every.select("x", F.array().cast("array<string>").alias("premises"))
        return facts.where((c("p") == TYPE) & (c("o") == expression)).select(c("s").alias("x"), F.array("id").alias("premises"))
    kind, *rest = expression
    if kind == "and":
        parts = [holds(e, facts).withColumnRenamed("premises", f"p{k}") for k, e in enumerate(rest)]
        both = reduce(lambda a, b: a.join(b, "x"), parts)
        return both.select("x", F.concat(*[c(f"p{k}") for k in range(len(rest))]).alias("premises"))
    if kind == "or":
        some = reduce(DataFrame.union, [holds(e, facts).select("x", F.struct(F.lit(k).alias("k"), "premises").alias("m")) for k, e in enumerate(rest)])
        return some.groupBy("x").agg(F.min("m").alias("m")).select("x", "m.premises")
    if kind == "some":
        filler = holds(rest[1], facts).select(c("x").alias("y"), c("premises").alias("q"))
        met = _edges(facts, rest[0]).join(filler, "y").select("x", F.struct("y", F.concat(F.array("e"), "q").alias("premises")).alias("m"))
        return met.groupBy("x").agg(F.min("m").alias("m")).select("x", "m.premises")
    if kind == "value":
        return _edges(facts, rest[0]).where(c("y") == rest[1]).groupBy("x").agg(F.array(F.min("e")).alias("premises"))
    raise ValueError(f"not on the left of an inclusion: {expression}")


def _inclusions(facts: DataFrame, onto: Ontology) -> tuple[list[DataFrame], list[DataFrame]]:
    """What inclusions of class expressions make new, and the clashes (rule, node, detail) they find."""
    made: list[DataFrame] = []
    broken: list[DataFrame] = []

    def put(df: DataFrame, s, p, o, rule: str) -> None:
        made.append(df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(rule).alias("rule"), "premises"))

    def apply(right, have: DataFrame, rule: str) -> None:
        if isinstance(right, str):
            return put(have, c("x"), TYPE, F.lit(right), rule)
        kind, *rest = right
        if kind == "and":
            for e in rest:
                apply(e, have, rule)
        elif kind == "not":
            against = holds(rest[0], facts).select("x")
            broken.append(have.join(against, "x").select(F.lit("cls-com").alias("rule"), c("x").alias("node"), F.lit(str(rest[0])).alias("detail")))
        elif kind == "only":
            reached = have.join(_edges(facts, rest[0]), "x").select(c("y").alias("x"), F.concat("premises", F.array("e")).alias("premises"))
            apply(rest[1], reached, "cls-avf")
        elif kind == "value":
            name, back = _role(rest[0])
            s, o = (F.lit(rest[1]), c("x")) if back else (c("x"), F.lit(rest[1]))
            put(have, s, name, o, "cls-hv")
        elif kind == "max":
            filler = holds(rest[2], facts).select(c("x").alias("y"), c("premises").alias("q"))
            met = have.join(_edges(facts, rest[1]), "x").join(filler, "y").select("x", "y", F.concat("premises", F.array("e"), "q").alias("premises"))
            if rest[0] == 0:
                broken.append(met.select(F.lit("cls-maxc").alias("rule"), c("x").alias("node"), F.lit(str(rest[1])).alias("detail")))
            else:
                first = met.groupBy("x").agg(F.min(F.struct(c("y").alias("y"), c("premises").alias("q"))).alias("m"))
                pairs = met.join(first, "x").where("y <> m.y").select(c("m.y").alias("a"), c("y").alias("b"), F.array_distinct(F.concat("m.q", "premises")).alias("premises"))
                put(pairs, c("a"), SAME, c("b"), "cls-maxc")
        else:
            raise ValueError(f"not on the right of an inclusion: {right}")

    for left, right in sorted(onto.rules, key=str):
        rule = "cax-sco" if isinstance(left, str) else _KIND[left[0]]
        apply(right, holds(left, facts), rule)
    return made, broken


def _rules(delta: DataFrame, facts: DataFrame, onto: Ontology, only: tuple[str, ...] | None, identity: bool) -> list[DataFrame]:
    """(s, p, o, rule, premises) of all that delta makes new together with facts."""
    spark, out = facts.sparkSession, []

    def one(rule: str, df: DataFrame, s, p, o, *premises) -> None:
        out.append(df.select(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(rule).alias("rule"), F.array(*premises).alias("premises")))

    wanted = lambda rule, axioms: axioms and (only is None or rule in only)
    turned = lambda pairs: {*pairs, *((b, a) for a, b in pairs)}
    edges = delta.where(~c("p").isin(TYPE, SAME))
    for rule, pairs in (("cax-sco", set(onto.subclasses)), ("cax-eqc", turned(onto.equivalent))):
        if wanted(rule, pairs):
            one(rule, delta.where(c("p") == TYPE).join(_small(spark, pairs, "o string, sup string"), "o"), c("s"), F.lit(TYPE), c("sup"), c("id"))
    if wanted("prp-dom", onto.domains):
        one("prp-dom", edges.join(_small(spark, onto.domains, "p string, cls string"), "p"), c("s"), F.lit(TYPE), c("cls"), c("id"))
    if wanted("prp-rng", onto.ranges):
        one("prp-rng", edges.join(_small(spark, onto.ranges, "p string, cls string"), "p"), c("o"), F.lit(TYPE), c("cls"), c("id"))
    over = [(a, b, False, "prp-spo1") for a, b in onto.subproperties]
    if only is None:
        over += [(a, b, False, "prp-eqp") for a, b in turned(onto.equivalent_properties)] + [(a, b, True, "prp-inv") for a, b in turned(onto.inverses)] + [(p, p, True, "prp-symp") for p in onto.symmetric]
    if wanted("prp-spo1", over):
        step = edges.join(_small(spark, over, "p string, sup string, turned boolean, r string"), "p")
        made = step.select(F.when(c("turned"), c("o")).otherwise(c("s")).alias("s"), c("sup").alias("p"), F.when(c("turned"), c("s")).otherwise(c("o")).alias("o"), c("r").alias("rule"), F.array("id").alias("premises"))
        out.append(made)
    if only is not None:
        return out
    for ps, p, rule in [*[((p, p), p, "prp-trp") for p in sorted(onto.transitive)], *[(ps, p, "prp-spo2") for ps, p in sorted(onto.chains, key=str)]]:
        for new in range(1 if delta is facts else len(ps)):  # the place that delta takes; all are one where it is everything
            step = lambda k: _edges(delta if k == new else facts, ps[k], f"n{k}", f"n{k + 1}", f"i{k}")  # noqa: E731, B023
            joined = reduce(lambda a, k: a.join(step(k), f"n{k}"), range(1, len(ps)), step(0))  # noqa: B023
            name, back = _role(p)
            ends = (c(f"n{len(ps)}"), c("n0")) if back else (c("n0"), c(f"n{len(ps)}"))
            one(rule, joined, ends[0], F.lit(name), ends[1], *[c(f"i{k}") for k in range(len(ps))])
    for rule, names, near, far in (("prp-fp", onto.functional, "s", "o"), ("prp-ifp", onto.inverse_functional, "o", "s")):
        if names:
            a = edges.where(c("p").isin(*sorted(names))).select("p", c(near).alias("n"), c(far).alias("x"), c("id").alias("i"))
            b = facts.where(c("p").isin(*sorted(names))).select("p", c(near).alias("n"), c(far).alias("y"), c("id").alias("j"))
            one(rule, a.join(b, ["p", "n"]).where("x <> y"), c("x"), F.lit(SAME), c("y"), c("i"), c("j"))
    out += _inclusions(facts, onto)[0]
    if identity:
        same, now = (d.where((c("p") == SAME) & (c("s") != c("o"))).select(c("s").alias("x"), c("o").alias("y"), c("id").alias("k")) for d in (facts, delta))
        one("eq-sym", now, c("y"), F.lit(SAME), c("x"), c("k"))
        further = same.select(c("x").alias("y"), c("y").alias("z"), c("k").alias("l"))
        one("eq-trans", now.join(further, "y").where("x <> z"), c("x"), F.lit(SAME), c("z"), c("k"), c("l"))
        for pairs, some in ((same, delta.where(c("p") != SAME)), (now, facts.where(c("p") != SAME))):
            one("eq-rep", some.join(pairs, c("s") == c("x")), c("y"), c("p"), c("o"), c("id"), c("k"))
            one("eq-rep", some.where(c("p") != TYPE).join(pairs, c("o") == c("x")), c("s"), c("p"), c("y"), c("id"), c("k"))
    return out


def with_ids(triples: DataFrame) -> DataFrame:
    return triples.select("s", "p", "o").distinct().withColumn("id", content_id(c("s"), c("p"), c("o")))


def close(triples: DataFrame, onto: Ontology, rules: tuple[str, ...] | None = None, rounds: int | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(facts, derivations, finished): facts s, p, o, id, derived; derivations fact, rule, premises.

    ``rules``: RDFS for that subset, None for all. Rounds go on until nothing is new; ``rounds`` is for
    callers that want fewer, who then have to look at ``finished``. Identities are followed only once a
    same_as fact is there, or can come to be. Each round's new facts are written to the shared folder;
    every way of deriving a fact is kept once, and the first proof of an expression.
    """
    spark = triples.sparkSession
    facts = materialize(with_ids(triples).withColumn("derived", F.lit(False)), "facts")
    makes_same = bool(onto.functional or onto.inverse_functional or any("max" in str(r) for _, r in onto.rules))
    identity = rules is None and (makes_same or not facts.where(c("p") == SAME).isEmpty())
    delta, kept, finished, k = facts, [], False, 0
    while rounds is None or k < rounds:
        k += 1
        made = _rules(delta, facts, onto, rules, identity)
        if not made:
            finished = True
            break
        derived = reduce(DataFrame.unionByName, made).withColumn("id", content_id(c("s"), c("p"), c("o")))
        sorted_ = derived.withColumn("premises", F.array_sort("premises")).where(~F.array_contains("premises", c("id")))
        derived = materialize(sorted_.dropDuplicates(["id", "rule", "premises"]), "derived")
        kept.append(derived)
        new = derived.select("s", "p", "o", "id").dropDuplicates(["id"]).join(facts.select("id"), "id", "left_anti").select("s", "p", "o", "id").withColumn("derived", F.lit(True))
        delta = materialize(new, "new-facts")
        if delta.isEmpty():
            finished = True
            break
        facts = facts.unionByName(delta)
    told = reduce(DataFrame.unionByName, kept) if kept else spark.createDataFrame([], f"{_SHAPE}, id string")
    return facts, told.select(c("id").alias("fact"), "rule", "premises").distinct(), finished


def clashes(facts: DataFrame, onto: Ontology) -> DataFrame:
    """(rule, node, detail) where facts (s, p, o) contradict the ontology."""
    spark = facts.sparkSession
    if "id" not in facts.columns:
        facts = with_ids(facts)
    typed = facts.where(c("p") == TYPE)
    found = lambda df, rule, node, detail: df.select(F.lit(rule).alias("rule"), node.alias("node"), detail.alias("detail"))
    out = [found(typed.where(c("o") == NONE), "cls-nothing", c("s"), c("o"))]
    if onto.disjoint:
        pairs = _small(spark, onto.disjoint, "a string, b string")
        first = typed.select(c("s").alias("node"), c("o").alias("a"))
        second = typed.select(c("s").alias("node"), c("o").alias("b"))
        out.append(found(first.join(pairs, "a").join(second, ["node", "b"]), "cax-dw", c("node"), F.concat_ws(" ", "a", "b")))
    if onto.irreflexive:
        out.append(found(facts.where(c("p").isin(*sorted(onto.irreflexive)) & (c("s") == c("o"))), "prp-irp", c("s"), c("p")))
    if onto.asymmetric:
        a = facts.where(c("p").isin(*sorted(onto.asymmetric))).select("s", "p", "o")
        out.append(found(a.join(a.select(c("s").alias("o"), "p", c("o").alias("s")), ["s", "p", "o"]), "prp-asyp", c("s"), c("p")))
    for p, q in sorted(onto.disjoint_properties, key=str):
        both = _edges(facts, p).join(_edges(facts, q, i="f"), ["x", "y"])
        out.append(found(both, "prp-pdw", c("x"), F.lit(" ".join(sorted((_role(p)[0], _role(q)[0]))))))
    out += _inclusions(facts, onto)[1]
    return reduce(DataFrame.unionByName, out).distinct()


def supported(facts: DataFrame, derivations: DataFrame, retracted: DataFrame) -> DataFrame:
    """Ids of facts that still stand once the retracted told ones go: a least fixpoint."""
    standing = new = materialize(facts.where("NOT derived").select("id").join(retracted.select("id"), "id", "left_anti"), "standing")
    needs = materialize(derivations.select(content_id(c("fact"), c("rule"), F.concat_ws(" ", "premises")).alias("d"), "fact", F.explode(F.array_distinct("premises")).alias("id"), F.size(F.array_distinct("premises")).alias("n")), "needs")
    while not new.isEmpty():
        ready = needs.join(standing, "id").groupBy("d", "fact", "n").count().where("count = n").select(c("fact").alias("id")).distinct()
        new = materialize(ready.join(standing, "id", "left_anti"), "standing-new")
        standing = materialize(standing.union(new), "standing")
    return standing


def lent_spans(told: DataFrame, derivations: DataFrame) -> DataFrame:
    """(id, spans) of told (id, spans) and derived facts: a derived one has those of its first premise that has any.

    Derivations are taken in the order of their premises; a fact that others lend to lends in turn.
    """
    known = materialize(told.where(F.size("spans") > 0).select("id", "spans"), "spans")
    asks = materialize(derivations.select("fact", c("premises").alias("all"), F.posexplode("premises").alias("nth", "id")), "asks")
    while True:
        lent = asks.join(known, "id").groupBy(c("fact").alias("id")).agg(F.min_by("spans", F.struct("all", "nth")).alias("spans"))
        new = materialize(lent.join(known.select("id"), "id", "left_anti").select("id", "spans"), "lent")
        if new.isEmpty():
            return known
        known = materialize(known.unionByName(new), "spans")


def entail(nodes: DataFrame, links: DataFrame, onto: Ontology) -> dict[str, DataFrame | bool]:
    """What the ontology makes of a graph: derived links, typings, identities, clashes, whether it finished.

    nodes: id, type and spans; links: id, predicate, src, dst and spans. links (derived): id, predicate,
    src, dst, rule, spans; relations of a node to itself are left out. typings: id, type. identities: a, b.
    """
    typed = nodes.select(c("id").alias("s"), F.lit(TYPE).alias("p"), c("type").alias("o"))
    told = links.select(c("src").alias("s"), c("predicate").alias("p"), c("dst").alias("o"))
    facts, derivations, finished = close(typed.unionByName(told), onto)
    spans = with_spans = None
    if "spans" in nodes.columns and "spans" in links.columns:
        own = typed.withColumn("spans", F.lit(None)).select("s", "p", "o").join(nodes.select(c("id").alias("s"), "spans"), "s")
        more = links.select(c("src").alias("s"), c("predicate").alias("p"), c("dst").alias("o"), "spans")
        with_spans = own.select("s", "p", "o", "spans").unionByName(more).select(content_id(c("s"), c("p"), c("o")).alias("id"), "spans").dropDuplicates(["id"])
        spans = lent_spans(with_spans, derivations)
    new = facts.where("derived")
    rule = derivations.groupBy(c("fact").alias("id")).agg(F.min("rule").alias("rule"))
    made = new.where(~c("p").isin(TYPE, SAME) & (c("s") != c("o"))).join(rule, "id")
    made = made.join(spans, "id", "left") if spans is not None else made
    shown = ["id", c("p").alias("predicate"), c("s").alias("src"), c("o").alias("dst"), "rule", *(["spans"] if spans is not None else [])]
    return {
        "links": made.select(*shown), "typings": new.where(c("p") == TYPE).select(c("s").alias("id"), c("o").alias("type")),
        "identities": new.where((c("p") == SAME) & (c("s") < c("o"))).select(c("s").alias("a"), c("o").alias("b")),
        "clashes": clashes(facts, onto), "derivations": derivations, "finished": finished,
    }
