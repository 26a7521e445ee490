"""Connected components of an edge table by alternating star contractions.

Every round hangs each node on the smallest neighbour seen, first across larger neighbours, then
across smaller ones, until all edges point at their component's smallest node. Each half is one
aggregation with map-side combining and one join; a round's edges are written to the shared folder,
so lineage stays one round long. A node with very many neighbours is one key of a skewed join, which
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.session import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst", rows: int | None = None) -> DataFrame:
    """(node, component) for every node of an edge, the component named by its smallest node.

    Self links and repeated links are fine; links with a null end are ignored. Nodes that are not
    numbers are numbered once, so that rounds move 8 bytes a node; those of one neighbour only follow it
    and take no part in the rounds. Rounds go on until nothing changes; their number grows with the logarithm of the longest way. ``rows``: about how many edges, if known.
    """
    a, b = F.col(left), F.col(right)
    ends = edges.where(a.isNotNull() & b.isNotNull()).select(a.alias("a"), b.alias("b"))
    if ends.schema["a"].dataType.simpleString() in ("bigint", "int"):
        return _contract(ends, rows)
    ends = materialize(ends.distinct(), "ends")
    both = ends.select(F.col("a").alias("node"), F.col("b").alias("to")).union(ends.select("b", "a"))
    nodes = materialize(both.groupBy("node").agg(F.min("to").alias("to"), F.max("to").alias("last")), "nodes")
    one = (F.col("to") == F.col("last")) & (F.col("to") != F.col("node"))
    tips = nodes.where(one).select("node", "to")
    after = tips.where("node > to")
    mutual = after.select(F.col("to").alias("node"), F.col("node").alias("to"))  # the smaller of such a pair is no leaf
    leaves = materialize(after.union(tips.where("node < to").join(mutual, ["node", "to"], "left_anti")), "leaves")
    inner = nodes.where(~one).select("node").union(leaves.select("to")).distinct()
    numbered = materialize(inner.withColumn("number", F.monotonically_increasing_id()), "numbered")
    of = lambda c, n: numbered.select(F.col("node").alias(c), F.col("number").alias(n))
    found = _contract(ends.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    known = numbered.join(found.withColumnRenamed("node", "number"), "number", "left").select("node", F.coalesce("component", "number").alias("component"))
    known = materialize(known, "inner")
    hung = leaves.join(known.withColumnRenamed("node", "to"), "to").select("node", "component")
    named = materialize(known.union(hung), "named")
    least = named.groupBy("component").agg(F.min("node").alias("least"))
    return named.join(least, "component").select("node", F.col("least").alias("component"))


def _contract(ends: DataFrame, rows: int | None = None) -> DataFrame:
    everyone = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = materialize(everyone.distinct(), "links", rows)
    n = now.count()
    loops = now.where("u = v").select(F.col("u").alias("node"))
    now, before = now.where("u <> v"), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(hung.union(low.select("u", F.col("m").alias("v"))).distinct(), "links", n)
        state = _state(now)
        n = state[0]
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    joined = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    alone = loops.join(joined, "node", "left_anti").select("node", F.col("node").alias("component"))
    return joined.union(alone)
