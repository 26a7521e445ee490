"""Comparing recorded evidence: units, conditions, opposed results, steps, republished sources."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spanweave.functions.text import jaccard, normalise, tokens
from spanweave.operators.components import connected_components
from spanweave.session import materialize


def convert(values: DataFrame, factors: list[tuple[str, str, float]], unit: str, value: str = "value", column: str = "unit") -> DataFrame:
    """``converted``: the value in ``unit``, null where no factor leads there; factors are read both ways."""
    rows = [(a, f) for a, b, f in factors if b == unit] + [(b, 1 / f) for a, b, f in factors if a == unit] + [(unit, 1.0)]
    table = F.broadcast(values.sparkSession.createDataFrame(rows, f"{column} string, __sw_f double"))  # the caller's factors
    number = F.expr(f"try_cast(replace(cast(`{value}` as string), ',', '.') as double)")
    return values.join(table, column, "left").withColumn("converted", number * F.col("__sw_f")).drop("__sw_f")


def _said(values: Column) -> Column:
    """A condition map with normalised values, blank ones left out."""
    return F.map_filter(F.transform_values(values, lambda _, v: normalise(F.coalesce(v, F.lit("")))), lambda _, v: v != "")


def reconcile(supporting: DataFrame, opposing: DataFrame) -> DataFrame:
    """Each pair of a supporting and an opposing position on one thing, and what is true of it.

    Both: about, id, conditions (map), source_id, quote; a position that the graph lacks has a null
    source_id. Returns about, supporting, opposing, verdict, reason, differing. In this order: ambiguous
    (a position is missing), extraction (both rest on the same words), conditions (recorded values of a
    condition differ), ambiguous (one source under the same conditions), else disagreement. Positions on
    one thing meet in an equi-join; each pair is a row of the result.
    """
    side = lambda d, name, c, q: d.select("about", F.col("id").alias(name), _said(F.col("conditions")).alias(c), F.col("source_id").alias(f"{c}s"), F.trim("quote").alias(q))
    both = side(supporting, "supporting", "x", "xq").join(side(opposing, "opposing", "y", "yq"), "about")
    differ = F.array_sort(F.filter(F.array_intersect(F.map_keys("x"), F.map_keys("y")), lambda k: F.element_at("x", k) != F.element_at("y", k)))
    ladder = [
        (F.col("xs").isNull() | F.col("ys").isNull(), "ambiguous", F.lit("one of the two positions is not in the store")),
        (F.col("xq") == F.col("yq"), "extraction", F.lit("both positions rest on the same words, read two ways")),
        (F.size(differ) > 0, "conditions", F.concat(F.lit("recorded conditions differ: "), F.array_join(differ, ", "))),
        (F.col("xs") == F.col("ys"), "ambiguous", F.format_string("both positions were cut from '%s' under the same recorded conditions", F.col("xs"))),
    ]
    verdict, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for test, name, why in ladder:
        verdict, reason = verdict.when(test, name), reason.when(test, why)
    opposite = F.format_string("'%s' and '%s' take opposite positions on the same claim", F.col("xs"), F.col("ys"))
    verdict, reason = verdict.otherwise("disagreement"), reason.otherwise(opposite)
    return both.select("about", "supporting", "opposing", verdict.alias("verdict"), reason.alias("reason"), F.when(verdict == "conditions", F.array_join(differ, " ")).otherwise("").alias("differing"))


def asserted_comparable(conditions: DataFrame, links: DataFrame, predicates: list[str]) -> DataFrame:
    """(id, other, by): results of which a condition of one is linked to one of the other, either way.

    conditions: id, condition.
    """
    declared = links.where(F.col("predicate").isin(*predicates))
    either = declared.select(F.col("src").alias("x"), F.col("dst").alias("y"), "predicate").union(declared.select("dst", "src", "predicate"))
    first = conditions.select("id", F.col("condition").alias("x")).join(either, "x")
    found = first.join(conditions.select(F.col("id").alias("other"), F.col("condition").alias("y")), "y").where("id <> other")
    return found.groupBy("id", "other").agg(F.min("predicate").alias("by"))


def compare(results: DataFrame, baseline: DataFrame, factors: list[tuple[str, str, float]] = (), asserted: DataFrame | None = None) -> DataFrame:
    """Each result against the one baseline row: id, verdict, reason, matched, differed, missing, converted.

    Both: id, conditions (map), value, unit. insufficient: no conversion between the units, or a condition
    that only one recorded; comparable: asserted so (``asserted``: id, other, by), or all agree; partial:
    some differ. ``converted``: the value in the baseline's unit, null where units are the same or none
    leads there. ``factors`` (from, to, factor) are read both ways.
    """
    spark = results.sparkSession
    base = baseline.limit(1).select(F.col("id").alias("base"), _said(F.col("conditions")).alias("x"), F.coalesce("unit", F.lit("")).alias("into"))
    rows = [(a, b, float(f)) for a, b, f in factors] + [(b, a, 1 / f) for a, b, f in factors if f]
    table = spark.createDataFrame(rows, "unit string, into string, factor double").dropDuplicates(["unit", "into"])
    there = results.select("id", _said(F.col("conditions")).alias("y"), "value", F.coalesce("unit", F.lit("")).alias("unit"))
    both = there.join(F.broadcast(base), F.col("id") != F.col("base")).join(F.broadcast(table), ["unit", "into"], "left")  # one row; the caller's factors
    by = F.lit(None).cast("string")
    if asserted is not None:
        both, by = both.join(asserted.select("id", F.col("other").alias("base"), "by"), ["id", "base"], "left"), F.col("by")
    keys = F.array_union(F.map_keys("x"), F.map_keys("y"))
    of = lambda m, k: F.try_element_at(m, k)
    x, y = F.col("x"), F.col("y")
    pick = lambda test: F.array_join(F.array_sort(F.filter(keys, test)), " ")
    both = both.withColumns({
        "matched": pick(lambda k: of(x, k) == of(y, k)),
        "differed": pick(lambda k: of(x, k) != of(y, k)),
        "missing": pick(lambda k: of(x, k).isNull() | of(y, k).isNull()),
        "converted": F.when(F.col("unit") != F.col("into"), F.expr("try_cast(replace(cast(value as string), ',', '.') as double)") * F.col("factor")),
    })
    apart = (F.col("unit") != "") & (F.col("into") != "") & (F.col("unit") != F.col("into")) & F.col("converted").isNull()
    listed = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(", "))
    ladder = [
        (apart, "insufficient", F.format_string("no declared conversion from '%s' to '%s'", F.col("unit"), F.col("into"))),
        (by.isNotNull(), "comparable", F.format_string("conditions asserted comparable by '%s'", by)),
        (F.col("missing") != "", "insufficient", F.concat(F.lit("conditions not recorded: "), listed("missing"))),
        (F.col("differed") != "", "partial", F.concat(F.lit("conditions differ: "), listed("differed"))),
    ]
    verdict, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for test, name, why in ladder:
        verdict, reason = verdict.when(test, name), reason.when(test, why)
    return both.select("id", verdict.otherwise("comparable").alias("verdict"), reason.otherwise("every recorded condition agrees").alias("reason"), "matched", "differed", "missing", "converted")


def _in_order(planned: list[tuple], actual: list[tuple], believed: dict, least: float) -> list[tuple]:
    """Planned steps in turn, each with its partner: an asserted one first, then the closest label left.

    Steps: (id, place, words). Labels of equal words share their scores, so ties cost nothing.
    """
    groups: dict[frozenset, list[int]] = defaultdict(list)
    for k, (_, _, words) in enumerate(actual):
        groups[words].append(k)
    for left in groups.values():
        left.sort(key=lambda k: (actual[k][1], k), reverse=True)
    index: dict[str, set[frozenset]] = defaultdict(set)
    for words in groups:
        for w in words:
            index[w].add(words)
    of: dict = defaultdict(list)
    for k, (i, _, _) in enumerate(actual):
        if i in believed:
            of[believed[i]].append(k)
    taken: set[int] = set()
    out = []
    for i, _, words in planned:
        pick = next((k for k in of.get(i, ()) if k not in taken), None)
        if pick is None:
            near = {g for w in words for g in index[w]} if least > 0 else set(groups)
            best = (-1.0, 0)
            for g in near:
                left = groups[g]
                while left and left[-1] in taken:
                    left.pop()
                if left:
                    score = len(words & g) / len(words | g) if words and g else 0.0
                    best = max(best, (score, -actual[left[-1]][1], -left[-1]))
            if best[0] >= least:
                pick = -best[2]
        if pick is not None:
            taken.add(pick)
        out.append((i, pick))
    return out


_ALIGNED = "planned_nth long, actual_nth long, planned string, actual string, verdict string, reordered boolean"


def align(planned: DataFrame, actual: DataFrame, least: float = 0.5, asserted: DataFrame | None = None) -> DataFrame:
    """Planned steps beside the ones carried out, within a plan.

    Both: plan, nth, label. Planned steps are taken in their order; each gets the step asserted to be its
    own (``asserted``: plan, planned, actual by nth), or of those left the one whose label's words overlap
    most, from ``least`` on, ties to the earlier. Returns plan, planned_nth, actual_nth, planned, actual,
    verdict (same, renamed, missing, extra) and reordered: carried out before the step planned before it.
    The choice is sequential by nature: a plan is one task, which holds its steps and never their pairs.
    Steps of null labels have no words and match only where asserted. Plans of null are one plan.
    """
    spark = planned.sparkSession
    slim = lambda d, side: d.select("plan", F.lit(side).alias("side"), F.col("nth").cast("long").alias("nth"), F.col("label"), F.lit(None).cast("long").alias("own"), F.array_join(tokens(F.coalesce("label", F.lit(""))), " ").alias("words"))
    steps = slim(planned, 0).unionByName(slim(actual, 1))
    if asserted is not None:
        told = asserted.select("plan", F.lit(2).alias("side"), F.col("actual").cast("long").alias("nth"), F.lit(None).cast("string").alias("label"), F.col("planned").cast("long").alias("own"), F.lit("").alias("words"))
        steps = steps.unionByName(told)
    kind = steps.schema["plan"].dataType.simpleString()
    schema = spark.createDataFrame([], f"plan {kind}, {_ALIGNED}").schema
    names = schema.fieldNames()

    def match(plan, rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda r: (r[0], r[1], r[2] or ""))
        mine, theirs = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        believed = {r[1]: r[3] for r in rows if r[0] == 2}
        cut = lambda part: [(r[1], r[1], frozenset(r[4].split())) for r in part]
        planned, actual = cut(mine), cut(theirs)
        out, before, used = [], None, set()
        for (_, nth, label, _, _), (_, _, words), (_, k) in zip(mine, planned, _in_order(planned, actual, believed, least)):
            if k is None:
                out.append((plan, nth, None, label, None, "missing", False))
                continue
            used.add(k)
            at, other = theirs[k][1], theirs[k][2]
            same = words == actual[k][2] and words or believed.get(at) == nth
            out.append((plan, nth, at, label, other, "same" if same else "renamed", before is not None and before > at))
            before = at
        return out + [(plan, None, r[1], None, r[2], "extra", False) for k, r in enumerate(theirs) if k not in used]

    def every(batches):
        table = lambda out: pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=to_arrow_schema(schema))
        plan, rows = None, []
        for batch in batches:
            out = []
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("plan", "side", "nth", "label", "own", "words"))):
                if rows and p != plan and (p == p or plan == plan):  # NaN is one plan
                    out += match(plan, rows)
                    rows = []
                plan = p
                rows.append(row)
            if out:
                yield table(out)
        if rows and (out := match(plan, rows)):
            yield table(out)

    # plans in sequence within a task: a call for each would cost more than its steps
    return steps.repartition("plan").sortWithinPartitions("plan").mapInArrow(every, schema)


def federation_check(spans: DataFrame, sources: DataFrame, segments: DataFrame, versions: list[str]) -> DataFrame:
    """spans and ``reason``: why a registry's record is refused, null where it holds.

    In this order: its source is missing, its quote is not there, its schema version is unknown.
    """
    have = sources.select(F.col("id").alias("source_id"), F.lit(True).alias("__sw_has"))
    text = segments.select("source_id", F.col("number").alias("segment"), F.col("text").alias("__sw_text"))
    joined = spans.join(have, "source_id", "left").join(text, ["source_id", "segment"], "left")
    there = F.coalesce(F.substring(F.col("__sw_text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quote"), F.lit(False))
    reason = F.when(F.col("__sw_has").isNull(), "missing source").when(~there, "drifted span").when(~F.col("version").isin(*versions), "unknown version")
    return joined.withColumn("reason", reason).drop("__sw_has", "__sw_text")


def independence(claims: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """One row: sources, registries, republished (sources in several registries), individuals, identified.

    claims: source_id, registry, node. ``identities``: pairs a, b of nodes that are one; only pairs of two
    different claimed nodes count, which ``identified`` numbers.
    """
    held = claims.groupBy("source_id").agg(F.countDistinct("registry").alias("r"))
    counts = claims.agg(F.countDistinct("source_id").alias("sources"), F.countDistinct("registry").alias("registries"))
    again = held.agg(F.coalesce(F.sum((F.col("r") > 1).cast("long")), F.lit(0)).alias("republished"))
    nodes = claims.select("node").distinct()
    pairs = F.lit(0).cast("long")
    if identities is not None:
        ends = nodes.select(F.col("node").alias("a")), nodes.select(F.col("node").alias("b"))
        inside = identities.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        inside = materialize(inside.join(ends[0], "a", "left_semi").join(ends[1], "b", "left_semi").select("a", "b"), "identities")
        pairs = F.lit(inside.count()).cast("long")
        named = connected_components(inside, "a", "b")
        nodes = nodes.join(named, "node", "left").select(F.coalesce("component", "node").alias("node")).distinct()
    people = nodes.agg(F.count("*").alias("individuals"))
    return counts.join(F.broadcast(again)).join(F.broadcast(people)).withColumn("identified", pairs)  # single rows


def pooled_labels(labels: DataFrame, least: float = 0.6, most_labels: int = 100_000) -> DataFrame:
    """term, label, variants, families, support: refused types pooled by the overlap of their words.

    labels: seq, label, source_id, and ``family`` where sources belong together. Labels are taken in the
    order in which they were first seen; each joins the pool whose first label overlaps most, from
    ``least`` on, a later one in a tie, or begins its own under its normalised form. That is sequential,
    over distinct labels alone, on the driver; more than ``most_labels`` are refused. Counting the rest is
    one join and one aggregation.
    """
    spark = labels.sparkSession
    family = F.col("family") if "family" in labels.columns else F.col("source_id")
    seen = labels.groupBy("label").agg(F.min("seq").alias("seq"), F.first(tokens(F.coalesce("label", F.lit("")))).alias("words"), F.first(normalise(F.col("label"))).alias("norm"))
    rows = seen.orderBy("seq", "label").limit(most_labels + 1).collect()  # distinct labels, refused beyond the bound
    if len(rows) > most_labels:
        raise ValueError(f"more than {most_labels} distinct labels; filter them first")
    pools: dict[str, frozenset] = {}
    index: dict[str, list[str]] = defaultdict(list)
    joined: list[tuple[str | None, str]] = []
    rank: dict[str, int] = {}
    for r in rows:
        words = frozenset(r["words"])
        term, best = r["norm"] or "", (least, -1)
        for key in {k for w in words for k in index[w]}:
            first = pools[key]
            score = len(words & first) / len(words | first)
            if (score, rank[key]) >= best:
                term, best = key, (score, rank[key])
        if term not in pools:
            pools[term] = words
            rank[term] = len(rank)
            for w in words:
                index[w].append(term)
        joined.append((r["label"], term))
    named = spark.createDataFrame(joined, "label string, term string")
    pooled = labels.withColumn("family", family).join(F.broadcast(named), labels["label"].eqNullSafe(named["label"])).drop(named["label"])  # bounded above
    each = pooled.groupBy("term").agg(F.array_sort(F.collect_set(labels["label"])).alias("variants"), F.array_sort(F.collect_set("family")).alias("families"))
    shortest = F.array_min(F.transform("variants", lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))["v"]
    return each.select("term", shortest.alias("label"), "variants", "families", F.size("families").cast("long").alias("support"))


def merged_rounds(found: DataFrame, held: DataFrame) -> DataFrame:
    """A round's pools with those of rounds before: families united, rounds one more, the old definition kept."""
    old = held.select("term", F.col("families").alias("f"), F.col("rounds").alias("r"), F.col("definition").alias("d"))
    both = found.join(old, "term", "left")
    families = F.array_sort(F.array_union("families", F.coalesce("f", F.array().cast("array<string>"))))
    own = F.nullif(F.coalesce(F.col("definition"), F.lit("")), F.lit("")) if "definition" in found.columns else F.lit(None).cast("string")
    return both.select("term", "label", "variants", families.alias("families"), F.size(families).cast("long").alias("support"), (F.coalesce("r", F.lit(0)) + 1).alias("rounds"), F.coalesce(own, "d", F.lit("")).alias("definition"))


def promote(candidates: DataFrame, known: list[str], min_support: int = 3, min_rounds: int = 2, reuse: float = 0.75, require_definition: bool = True) -> DataFrame:
    """Candidates (term, label, support, rounds, definition) with nearest, similarity, and ``refused``: why, null if promoted.

    ``known``: the ontology's names; the one whose words overlap most is nearest.
    """
    spark = candidates.sparkSession
    table = spark.createDataFrame([(k,) for k in sorted(known)], "name string").select("name", tokens(F.col("name")).alias("w"))
    scored = candidates.join(F.broadcast(table)).withColumn("s", jaccard(F.array_distinct(tokens(F.col("label"))), F.array_distinct("w")))  # the ontology's names
    near = scored.groupBy("term").agg(F.max(F.struct("s", "name")).alias("n"))
    both = candidates.join(near, "term", "left").withColumns({"similarity": F.coalesce("n.s", F.lit(0.0)), "nearest": F.when(F.col("n.s") > 0, F.col("n.name")).otherwise("")}).drop("n")
    why = (
        F.when(F.col("support") < min_support, F.format_string("support %d in independent families, below %d", "support", F.lit(min_support)))
        .when(F.col("rounds") < min_rounds, F.format_string("seen in %d round(s), below %d", "rounds", F.lit(min_rounds)))
        .when(F.col("similarity") >= reuse, F.format_string("reuse '%s' instead (%.2f overlap)", "nearest", "similarity"))
    )
    if require_definition:
        why = why.when(F.coalesce(F.trim("definition"), F.lit("")) == "", "no definition distinguishing it from what the schema already has")
    return both.withColumn("refused", why)


def unit_forms(units: DataFrame, kinds: tuple[str, ...], quantifiers: tuple[str, ...] = (), modalities: tuple[str, ...] = (), polarities: tuple[str, ...] = ()) -> DataFrame:
    """Claims (id, kind, quantifier, polarity, modality) with ``profile`` and ``reason``: how far a form may be trusted.

    The words a run reads are its own; none are assumed. unsupported where no polarity or kind is there or
    read; lossy where the quantifier is unknown or the modality not read; else exact.
    """
    of = {c: normalise(F.coalesce(F.col(c), F.lit(""))) for c in ("kind", "quantifier", "polarity", "modality")}
    among = lambda c, words: of[c].isin(*words) if words else F.lit(False)
    ladder = [
        (of["polarity"] == "", "unsupported", F.lit("no polarity recorded, so the scope of any negation is unknown")),
        (F.lit(bool(polarities)) & ~among("polarity", polarities), "unsupported", F.format_string("polarity '%s' is not one this run reads", of["polarity"])),
        (of["kind"] == "", "unsupported", F.lit("no kind recorded, so there is no form to read")),
        (~among("kind", kinds), "unsupported", F.format_string("kind '%s' is not one this run interprets", of["kind"])),
        (of["quantifier"] == "", "lossy", F.lit("no quantifier recorded; a formal reading would have to choose one")),
        (F.lit(bool(quantifiers)) & ~among("quantifier", quantifiers), "lossy", F.format_string("quantifier '%s' is not one this run reads formally", of["quantifier"])),
        ((of["modality"] != "") & ~among("modality", modalities), "lossy", F.format_string("modality '%s' is not one this run reads formally", of["modality"])),
    ]
    profile, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for test, name, why in ladder:
        profile, reason = profile.when(test, name), reason.when(test, why)
    return units.withColumns({"profile": profile.otherwise("exact"), "reason": reason.otherwise("kind, quantifier, polarity and modality are all ones this run reads")})


def translated(units: DataFrame, readings: dict[str, str], negative: tuple[str, ...] = ()) -> DataFrame:
    """Exact claims with subject_term and object_term get ``form``: subclass, disjoint, exists or exists-not.

    ``readings``: which quantifiers read as all, some or none; others do not translate. ``negative``:
    polarities that negate the object.
    """
    table = F.create_map(*[F.lit(x) for kv in (readings or {"": ""}).items() for x in kv])
    quantity = F.try_element_at(table, normalise(F.coalesce("quantifier", F.lit(""))))
    negated = normalise(F.coalesce("polarity", F.lit(""))).isin(*negative) if negative else F.lit(False)
    ready = (F.col("profile") == "exact") & (F.coalesce(F.trim("subject_term"), F.lit("")) != "") & (F.coalesce(F.trim("object_term"), F.lit("")) != "")
    form = F.when(quantity == "some", F.when(negated, "exists-not").otherwise("exists")).when(quantity.isNotNull(), F.when((quantity == "all") != negated, "subclass").otherwise("disjoint"))
    return units.withColumn("form", F.when(ready, form))


def judged(units: DataFrame, onto, most_units: int = 10_000) -> DataFrame:
    """(id, status, against) of translated claims: follows from the ontology, consistent, or contradicted.

    contradicted: with all universal claims the ontology leaves the claim false; ``against`` are the
    fewest other claims that still do. The ontology's engine runs on the driver, over at most
    ``most_units`` claims; more are refused.
    """
    spark = units.sparkSession
    rows = units.where("form IS NOT NULL").select("id", "form", F.trim("subject_term").alias("s"), F.trim("object_term").alias("o")).orderBy("id").limit(most_units + 1).collect()  # bounded
    if len(rows) > most_units:
        raise ValueError(f"more than {most_units} claims")
    universal = {r["id"]: r for r in rows if r["form"] in ("subclass", "disjoint")}

    def engine(ids) -> tuple[dict[str, set[str]], set[str]]:
        more = [universal[i] for i in ids]
        return onto.with_axioms(
            subclasses={(r["s"], r["o"]) for r in more if r["form"] == "subclass"}, disjoint={(r["s"], r["o"]) for r in more if r["form"] == "disjoint"},
            classes={c for r in rows for c in (r["s"], r["o"])},
        ).classify()

    def empty(found, a: str, b: str) -> bool:
        above = found[0].get(a, {a}) | found[0].get(b, {b})
        return a in found[1] or b in found[1] or any(x in above and y in above for x, y in disjoint)

    disjoint = set(onto.disjoint) | {(r["s"], r["o"]) for r in universal.values() if r["form"] == "disjoint"}

    def false(r, found) -> bool:
        if r["s"] in found[1]:
            return True
        if r["form"] == "exists":
            return empty(found, r["s"], r["o"])
        return r["form"] == "exists-not" and r["o"] in found[0].get(r["s"], set())

    def true(r, found) -> bool:
        if r["form"] == "subclass":
            return r["o"] in found[0].get(r["s"], set())
        return r["form"] == "disjoint" and onto.are_disjoint(r["s"], r["o"])

    alone, together = engine(()), engine(universal)
    out = []
    for r in rows:
        against: list[str] = []
        if false(r, together):
            kept = sorted(universal)
            for one in sorted(universal):
                trial = [k for k in kept if k != one]
                disjoint = set(onto.disjoint) | {(universal[k]["s"], universal[k]["o"]) for k in trial if universal[k]["form"] == "disjoint"}
                if false(r, engine(trial)):
                    kept = trial
            disjoint = set(onto.disjoint) | {(u["s"], u["o"]) for u in universal.values() if u["form"] == "disjoint"}
            against = [k for k in kept if k != r["id"]]
        out.append((r["id"], "contradicted" if false(r, together) else "follows" if true(r, alone) else "consistent", against))
    return spark.createDataFrame(out, "id string, status string, against array<string>")
