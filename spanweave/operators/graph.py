"""Bounded walks over a link table: adjacency, reach, simple paths, diffusion, selection."""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.components import connected_components
from spanweave.session import materialize


def adjacency(links: DataFrame, follow: list[str] | None = None, both_ways: bool = True) -> DataFrame:
    """a, b, link, predicate, forward: each link from either end; ``follow`` keeps some predicates."""
    kept = links if not follow else links.where(F.col("predicate").isin(*follow))
    out = kept.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("id").alias("link"), "predicate", F.lit(True).alias("forward"))
    back = kept.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("id").alias("link"), "predicate", F.lit(False).alias("forward"))
    return out.unionByName(back) if both_ways else out


def degree(links: DataFrame) -> DataFrame:
    """Link ends of each node; a link to itself counts twice."""
    return adjacency(links).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def among(links: DataFrame, held: DataFrame) -> DataFrame:
    """Links with both ends in ``held`` (node)."""
    a = links.join(held.select(F.col("node").alias("src")), "src", "left_semi")
    return a.join(held.select(F.col("node").alias("dst")), "dst", "left_semi").select(links.columns)


def touching(links: DataFrame, held: DataFrame, predicate: str | None = None) -> DataFrame:
    """Links with an end in ``held``; two semi-joins rather than a join on either end."""
    some = links if predicate is None else links.where(F.col("predicate") == predicate)
    one = some.join(held.select(F.col("node").alias("src")), "src", "left_semi").select(links.columns)
    other = some.join(held.select(F.col("node").alias("dst")), "dst", "left_semi").select(links.columns)
    return one.unionByName(other).distinct()


def reach(adj: DataFrame, seeds: DataFrame, depth: int = 2, limit: int | None = None, forward: bool = True, backward: bool = True, written: bool = False) -> tuple[DataFrame, bool]:
    """(node, depth, parent, link, predicates, links) by breadth, and whether the limit cut it.

    The walk kept is the first found: nodes of a hop are taken in the order in which they were found, the
    links of each by id, seeds by id. ``links`` along a walk therefore order the nodes of a hop. The
    limit counts all nodes, seeds included, and the search stops once it is reached. ``forward`` and
    ``backward`` tell which way links may be crossed. The adjacency is written first, unless it is ``written``; each hop is one join,
    one aggregation and an anti-join with what was seen, then written.
    """
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    ways = [w for w, on in ((True, forward), (False, backward)) if on]
    adj = adj.where(F.col("forward").isin(*ways)).select("a", "b", "link", "predicate")
    adj = adj if written else materialize(adj, "adjacency")
    front = seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), none.alias("parent"), none.alias("link"), empty.alias("predicates"), F.array("node").alias("links"))
    seen, partial = materialize(front, "reach"), False
    front, held = seen, seen.count() if limit is not None else 0
    for hop in range(1, depth + 1):
        step = front.select(F.col("node").alias("a"), "predicates", "links").join(adj, "a")
        walked = F.struct(F.concat("links", F.array("link")).alias("links"), F.col("a").alias("parent"), "link", F.concat("predicates", F.array("predicate")).alias("predicates"))
        best = step.groupBy(F.col("b").alias("node")).agg(F.min(walked).alias("m")).join(seen.select("node"), "node", "left_anti")
        front = materialize(best.select("node", F.lit(hop).alias("depth"), "m.parent", "m.link", "m.predicates", "m.links"), "reach")
        if limit is not None and held + (found := front.count()) > limit:
            front, partial = front.orderBy("links", "node").limit(max(limit - held, 0)), True
        elif limit is not None:
            held += found
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if partial:
            break
    return seen, partial


def reach_sql(spark, links: DataFrame, seed: str, depth: int = 2) -> DataFrame:
    """Smallest depth of each node by a recursive common table expression."""
    adjacency(links).select("a", "b").createOrReplaceTempView("spanweave_adjacency")
    return spark.sql(
        f"""WITH RECURSIVE r(node, depth) AS (
              SELECT :seed, 0 UNION ALL
              SELECT b, depth + 1 FROM r JOIN spanweave_adjacency ON a = node WHERE depth < {int(depth)})
            SELECT node, min(depth) AS depth FROM r GROUP BY node""",
        args={"seed": seed},
    )


def lineage(links: DataFrame, causes: DataFrame, depends: list[str], depth: int = 6) -> DataFrame:
    """All that depends on the causes, against the direction of dependency links, with the way there."""
    against = adjacency(links, depends, both_ways=False).select(F.col("b").alias("a"), F.col("a").alias("b"), "link", "predicate", F.lit(False).alias("forward"))
    found, _ = reach(against, causes, depth)
    return found.where("depth > 0").select("node", "depth", F.array_join(F.reverse("predicates"), " ").alias("path"))


def walks(adj: DataFrame, ends: DataFrame, depth: int = 3, limit: int | None = 60) -> DataFrame:
    """Simple paths from src to dst of ``ends``: src, dst, nodes, links, predicates, length.

    ``limit`` keeps the shortest of a pair, ties by their links. Only nodes that can still reach the
    other end are walked to: their distance from it is found first, backwards.
    """
    near = ends.select("dst", F.col("dst").alias("b"), F.lit(0).alias("far")).distinct()
    front = near = materialize(near, "near")
    for far in range(1, depth):
        back = front.join(adj.select("a", "b"), "b").select("dst", F.col("a").alias("b")).distinct()
        front = materialize(back.join(near.select("dst", "b"), ["dst", "b"], "left_anti").select("dst", "b", F.lit(far).alias("far")), "near")
        near = near.unionByName(front)
    empty = F.array().cast("array<string>")
    now = ends.select("src", "dst", F.array("src").alias("nodes"), empty.alias("links"), empty.alias("predicates"), F.col("src").alias("a"))
    found = None
    for hop in range(1, depth + 1):
        step = now.join(adj.select("a", "b", "link", "predicate"), "a").where(~F.array_contains("nodes", F.col("b")))
        step = step.join(near.where(F.col("far") <= depth - hop).drop("far"), ["dst", "b"], "left_semi")
        now = step.select("src", "dst", F.concat("nodes", F.array("b")).alias("nodes"), F.concat("links", F.array("link")).alias("links"), F.concat("predicates", F.array("predicate")).alias("predicates"), F.col("b").alias("a"))
        got = now.where("a = dst").drop("a")
        found = got if found is None else found.unionByName(got)
        now = now.where("a <> dst")
    found = found.withColumn("length", F.size("links"))
    if limit is None:
        return found
    order = Window.partitionBy("src", "dst").orderBy("length", "links")
    return found.withColumn("__sw_n", F.row_number().over(order)).where(F.col("__sw_n") <= limit).drop("__sw_n")


def path_flow(paths: DataFrame, weights: dict[str, float], decay: float = 0.8, keep: int = 8, against: tuple[str, ...] = ("disputes",)) -> DataFrame:
    """The best ``keep`` of all paths by flow, and all counter-paths; adds score, signature, reason.

    Flow is the product of each link's weight (none below 0) and the decay. Equal signatures count once.
    """
    table = F.create_map(*[x for k, v in (weights or {"": 1.0}).items() for x in (F.lit(k), F.lit(max(float(v), 0.0)))])
    flow = F.aggregate("predicates", F.lit(1.0), lambda a, p: a * F.coalesce(F.element_at(table, p), F.lit(1.0)) * decay)
    scored = materialize(paths.withColumn("score", F.round(flow, 6)).withColumn("signature", F.concat_ws(" ", "links")).dropDuplicates(["signature"]), "flows")
    best = scored.orderBy(F.desc("score"), "signature").limit(keep)
    counter = F.arrays_overlap("predicates", F.array(*[F.lit(p) for p in against]).cast("array<string>"))
    rest = scored.where(counter).join(best.select("signature"), "signature", "left_anti").select(scored.columns)
    said = F.format_string("flow %.4f", F.col("score"))
    return best.withColumn("reason", said).unionByName(rest.withColumn("reason", F.concat(said, F.lit(", kept as a counter-path"))))


def components(links: DataFrame) -> DataFrame:
    """node, component: its smallest node."""
    return connected_components(links, "src", "dst")


def weighted(links: DataFrame, table: dict[str, float]) -> DataFrame:
    """Links with ``weight`` from the predicate's entry, 1 by default."""
    entry = F.create_map(*[x for k, v in (table or {"": 1.0}).items() for x in (F.lit(k), F.lit(float(v)))])
    return links.withColumn("weight", F.coalesce(F.element_at(entry, F.col("predicate")), F.lit(1.0)))


def diffuse(links: DataFrame, seeds: DataFrame, weights: dict[str, float] | None = None, damping: float = 0.85, rounds: int = 30, top: int | None = 12) -> DataFrame:
    """Personalised PageRank over links read both ways: (node, score) with scores rounded to 6.

    ``seeds``: node, and ``score`` where some weigh more; the walk restarts among those of the graph in
    proportion. Nodes without weight to leave by return theirs to the seeds, so scores sum to one. Leaves,
    nodes of one neighbour that has others, only give back what they got: rounds keep their sum beside the
    neighbour, and their own scores follow from its last but one. The other nodes are numbered once; a round
    is a join, an aggregation and the sum that returns, cut from its lineage every five rounds. Without seeds, or none in the graph, there is no result.
    """
    heavy = weighted(links, weights or {}).withColumn("weight", F.greatest(F.lit(0.0), "weight"))
    ends = heavy.select(F.col("src").alias("x"), F.col("dst").alias("y"), "weight").unionByName(heavy.select(F.col("dst").alias("x"), F.col("src").alias("y"), "weight"))
    pull = materialize(ends.groupBy("x", "y").agg(F.sum("weight").alias("w")), "pull")
    out = pull.groupBy("x").agg(F.sum("w").alias("out"), F.count("*").alias("n"), F.min("y").alias("y"))
    given = F.col("score").cast("double") if "score" in seeds.columns else F.lit(1.0)
    home = seeds.groupBy("node").agg(F.max(given).alias("seed")).where("seed > 0")
    every = materialize(out.join(home.withColumnRenamed("node", "x"), "x", "left"), "restart")
    total = every.agg(F.sum("seed").alias("s")).first()["s"]
    if not total:
        return every.select(F.col("x").alias("node"), F.lit(0.0).alias("score")).where("false")
    every = every.withColumn("home", F.coalesce("seed", F.lit(0.0)) / total)
    one = F.coalesce((F.col("n") == 1) & (F.col("x") != F.col("y")) & (F.col("out") > 0), F.lit(False))
    of = every.select(F.col("x").alias("y"), F.col("out").alias("out_y"), F.col("n").alias("n_y"))
    ends_ = materialize(every.where(one).join(of, "y"), "leaves")  # a link is as heavy from either end
    leaves = ends_.where("n_y > 1").select(F.col("x").alias("node"), "y", "home", (F.col("out") / F.col("out_y")).alias("share"))
    rest = every.where(~one).select("x", "out", "home").unionByName(ends_.where("n_y = 1").select("x", "out", "home"))
    hung = leaves.groupBy(F.col("y").alias("x")).agg(F.sum("home").alias("leaf_home"), F.sum("share").alias("leaf_share"))
    none = F.lit(0.0)
    base = rest.join(hung, "x", "left").select(F.col("x").alias("node"), "out", "home", F.coalesce("leaf_home", none).alias("leaf_home"), F.coalesce("leaf_share", none).alias("leaf_share"))
    base = materialize(base.withColumn("a", F.monotonically_increasing_id()), "inner")
    number = base.select("node", "a")
    share = pull.join(base.where("out > 0").select(F.col("node").alias("x"), "a", "out"), "x").join(number.select(F.col("node").alias("y"), F.col("a").alias("b")), "y")
    share = share.select("a", "b", (F.col("w") / F.col("out")).alias("share"), F.lit(False).alias("own")).where("share > 0")
    own = base.select("a", F.col("a").alias("b"), none.alias("share"), F.lit(True).alias("own"))  # so that a round reads rank once
    share = materialize(share.unionByName(own), "shares")
    rank = base.select("a", F.col("home").alias("score"), F.col("leaf_home").alias("hung"), none.alias("before"))
    stuck = base.where("out <= 0").select("a")
    fixed, again = stuck.isEmpty(), 1.0
    for k in range(rounds):
        lost = 0.0 if fixed else rank.join(stuck, "a", "left_semi").agg(F.coalesce(F.sum("score"), none).alias("s")).first()["s"]
        again = 1 - damping + damping * lost
        flow = rank.join(share, "a").groupBy("b").agg(F.sum(F.col("score") * F.col("share")).alias("got"), F.max(F.when(F.col("own"), F.col("hung"))).alias("hung"), F.max(F.when(F.col("own"), F.col("score"))).alias("score"))
        now = base.join(flow, F.col("a") == F.col("b"))
        rank = now.select("a", (again * F.col("home") + damping * (F.col("got") + F.col("hung"))).alias("score"), (again * F.col("leaf_home") + damping * F.col("score") * F.col("leaf_share")).alias("hung"), F.col("score").alias("before"))
        if k % 5 == 4 or not fixed:
            rank = materialize(rank, "rank")
    rank = base.select("node", "a").join(materialize(rank, "rank"), "a")
    at = leaves.join(rank.select(F.col("node").alias("y"), "before"), "y").select("node", (again * F.col("home") + damping * F.col("before") * F.col("share")).alias("score"))
    scored = rank.select("node", "score").unionByName(at).select("node", F.round("score", 6).alias("score"))
    return scored if top is None else scored.orderBy(F.desc("score"), "node").limit(top)


def partition(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Greedy modularity communities of a graph small enough for the driver (a package of expand).

    The pair that gains most is merged, ties by name, until none gains. A pair is held by its end of more
    neighbours, among those of one weight and size, which gain alike and keep their order while the holder
    grows; so a merge looks at a holder's kinds of neighbours, not at all of them.
    """
    m = float(len(pairs))
    number: dict[str, int] = {}
    for p in pairs:
        for n in p:
            number.setdefault(n, len(number))
    name = list(number)
    member: list[list[str] | None] = [[n] for n in name]
    ends = [0.0] * len(name)
    near: list[dict[int, float]] = [{} for _ in name]  # neighbour: links between
    for p in pairs:
        a, b = number[p[0]], number[p[1]]
        ends[a] += 1
        ends[b] += 1
        if a != b:
            near[a][b] = near[b][a] = near[a].get(b, 0.0) + 1
    holders: list[set[int]] = [set() for _ in name]  # those that hold the pair with this one
    kinds: list[dict[tuple[float, float], list[tuple[str, int]]]] = [{} for _ in name]  # heaps by name
    stamp = [0] * len(name)
    heap: list[tuple] = []

    def put(x: int, y: int) -> None:
        heappush(kinds[x].setdefault((near[x][y], ends[y]), []), (name[y], y))

    def offer(x: int) -> None:
        """The best pair that ``x`` holds."""
        best = None
        for (s, e), held in list(kinds[x].items()):
            while held and not (member[y := held[0][1]] is not None and x in holders[y] and (near[x][y], ends[y], name[y]) == (s, e, held[0][0])):
                heappop(held)
            if not held:
                del kinds[x][s, e]
                continue
            now = (-(s / m - ends[x] * e / (2 * m * m)), *held[0])
            best = now if best is None or now < best else best
        stamp[x] += 1
        if best is not None and best[0] < 0:  # a pair that does not gain may do so later; then it is offered again
            heappush(heap, (best[0], *sorted((name[x], best[1])), x, best[2], stamp[x]))

    for x in range(len(name)):
        for y in near[x]:
            if (len(near[x]), -x) > (len(near[y]), -y):
                holders[y].add(x)
                put(x, y)
    for x in range(len(name)):
        offer(x)
    while heap:
        _, _, _, x, y, at = heappop(heap)
        if member[x] is None or at != stamp[x]:
            continue
        if member[y] is None or x not in holders[y]:
            offer(x)
            continue
        big, small = (x, y) if len(near[x]) >= len(near[y]) else (y, x)
        name[big] = min(name[big], name[small])
        ends[big] += ends[small]
        more, less = sorted((member[big], member[small]), key=len, reverse=True)
        more.extend(less)
        member[big], member[small] = more, None
        for d in (near[big], near[small]):
            d.pop(big, None)
            d.pop(small, None)
        holders[big] -= {big, small}
        for z, s in near[small].items():
            del near[z][small]
            holders[z].discard(small)
            known = z in near[big]
            near[big][z] = near[z][big] = near[big].get(z, 0.0) + s
            if known and big in holders[z] or not known and len(near[big]) >= len(near[z]):
                holders[z].add(big)
                put(big, z)
            else:
                holders[big].add(z)
        near[small], holders[small], kinds[small] = {}, set(), {}
        for z in list(holders[big]):
            if len(near[big]) > 2 * len(near[z]):
                holders[big].remove(z)
                holders[z].add(big)
                put(big, z)
            else:
                put(z, big)
            offer(z)
        offer(big)
    order = sorted((g for g in member if g is not None), key=lambda g: (-len(g), min(g)))
    return {n: f"c{k:03d}" for k, g in enumerate(order) for n in g}


def communities(links: DataFrame, min_size: int = 1, most_links: int = 100_000) -> DataFrame:
    """node, community. The agglomeration is sequential, so the graph is bounded: more links are refused."""
    rows = links.select("src", "dst").limit(most_links + 1).collect()
    if len(rows) > most_links:
        raise ValueError(f"more than {most_links} links; expand or filter the graph first")
    groups = partition([(r["src"], r["dst"]) for r in rows])
    sizes: dict[str, int] = defaultdict(int)
    for g in groups.values():
        sizes[g] += 1
    kept = sorted((n, g) for n, g in groups.items() if sizes[g] >= min_size)
    return links.sparkSession.createDataFrame(kept, "node string, community string")


def grow(prizes: dict[str, float], pairs: list[tuple[str, str]], cost: float = 1.0, limit: int = 40, whole: dict[str, tuple[str, ...]] | None = None) -> tuple[list[str], float, float]:
    """(nodes, prize, cost) of a region grown from the best prize: each step takes the neighbour that pays most.

    A neighbour pays its prize, and that of the parts that ``whole`` says come with it, less ``cost``; ties
    go to the neighbour of the smallest node held, then by id. Nothing that does not pay is taken.
    """
    whole = whole or {}
    near: dict[str, set[str]] = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    if not prizes:
        return [], 0.0, 0.0
    first = max(sorted(prizes), key=lambda n: prizes[n])
    held, spent = {first, *whole.get(first, ())}, 0.0
    while len(held) < limit:
        worth = lambda n: sum(prizes.get(x, 0.0) for x in {n, *whole.get(n, ())} - held) - cost  # noqa: E731, B023
        best, gain = None, 0.0
        for h in sorted(held):
            for n in sorted(near[h] - held):
                if (w := worth(n)) > gain:
                    best, gain = n, w
        if best is None:
            break
        held |= {best, *whole.get(best, ())}
        spent += cost
    return sorted(held), round(sum(prizes.get(n, 0.0) for n in held), 6), spent


def select_subgraph(links: DataFrame, hits: DataFrame, cost: float = 0.3, limit: int = 40, whole: DataFrame | None = None, most_links: int = 100_000) -> DataFrame:
    """(node, prize) of the region that pays around the hits (node, score), prizes as shares of the best score.

    ``whole``: node, part: parts that come with a node. Growth is sequential, so it runs on the driver over
    the links near the hits: only nodes that pay can be taken, and those are hits or bring hits, so the
    links among hits, nodes with parts, and their parts are all that can matter. More than ``most_links``
    of them are refused.
    """
    scored = [(r["node"], float(r["score"])) for r in hits.groupBy("node").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "node").limit(most_links).collect()]
    top = max((s for _, s in scored), default=0.0) or 1.0
    prizes = {n: s / top for n, s in scored}
    near = hits.select("node")
    parts: dict[str, list[str]] = defaultdict(list)
    if whole is not None:
        near = near.union(whole.select("node")).union(whole.select("part"))
        for r in whole.orderBy("node", "part").limit(most_links).collect():
            parts[r["node"]].append(r["part"])
    pairs = [(r["src"], r["dst"]) for r in among(links, near.distinct()).select("src", "dst").limit(most_links + 1).collect()]
    if len(pairs) > most_links:
        raise ValueError(f"more than {most_links} links near the hits; rank fewer")
    nodes, _, _ = grow(prizes, pairs, cost, limit, {k: tuple(v) for k, v in parts.items()})
    return links.sparkSession.createDataFrame([(n, prizes.get(n, 0.0)) for n in nodes], "node string, prize double")
