"""Inverted index and ranking by shared terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.text import tokens


def postings(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """term, node, tf. Texts are shuffled by their node, not their words; the index stays dealt by node."""
    dealt = docs.select(F.col(key).alias("node"), F.col(text).alias("__sw_text")).repartition("node")
    return dealt.select("node", F.explode(tokens(F.col("__sw_text"))).alias("term")).groupBy("term", "node").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """node, n: its tokens."""
    return docs.select(F.col(key).alias("node"), F.size(tokens(F.col(text))).cast("long").alias("n"))


def retrieve(index: DataFrame, sizes: DataFrame, terms: list[str], limit: int | None = 8) -> DataFrame:
    """Best nodes by distinct shared terms over the root of their length; the terms filter the index."""
    hits = index.where(F.col("term").isin(*sorted(set(terms)))).groupBy("node").agg(F.countDistinct("term").alias("shared"))
    scored = hits.join(sizes, "node").select("node", F.round(F.col("shared") / F.sqrt(F.greatest(F.col("n"), F.lit(1))), 6).alias("score"))
    return scored if limit is None else scored.orderBy(F.desc("score"), "node").limit(limit)


def score_texts(docs: DataFrame, terms: list[str], limit: int | None = 8, key: str = "id", text: str = "text") -> DataFrame:
    """What ``retrieve`` gives, from the texts themselves: one pass without an index or a shuffle."""
    found = docs.select(F.col(key).alias("node"), tokens(F.col(text)).alias("t"))
    shared = F.size(F.array_intersect("t", F.array(*[F.lit(t) for t in sorted(set(terms))])))
    scored = found.select("node", F.size("t").alias("n"), shared.alias("shared")).where("shared > 0")
    scored = scored.select("node", F.round(F.col("shared") / F.sqrt(F.greatest(F.col("n"), F.lit(1))), 6).alias("score"))
    return scored if limit is None else scored.orderBy(F.desc("score"), "node").limit(limit)


def topic_terms(index: DataFrame, groups: DataFrame, k: int = 8) -> DataFrame:
    """Most frequent terms of each group (node, topic), ties by term."""
    counted = index.join(groups.hint("shuffle_hash"), "node").groupBy("topic", "term").agg(F.sum("tf").alias("n"))
    w = Window.partitionBy("topic").orderBy(F.desc("n"), "term")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieve_dual(direct: DataFrame, groups: DataFrame, by_topic: DataFrame, limit: int = 8) -> DataFrame:
    """The better of a node's own score and its topic's, and through which."""
    indirect = groups.join(by_topic.select("topic", F.col("score").alias("t")), "topic").select("node", "t")
    both = direct.select("node", F.col("score").alias("d")).join(indirect, "node", "full_outer")
    d, t = F.coalesce("d", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    return both.select("node", F.greatest(d, t).alias("score"), F.when(d >= t, "direct").otherwise("topic").alias("via")).orderBy(F.desc("score"), "node").limit(limit)


def retrieve_routed(direct: DataFrame, groups: DataFrame, overview: bool, top: int = 8, cap: int = 50) -> tuple[DataFrame, bool]:
    """A fact question: the best nodes; an overview: the best whole groups up to ``cap`` nodes, and if it cut."""
    if not overview:
        return direct.orderBy(F.desc("score"), "node").limit(top), False
    weight = direct.join(groups, "node").groupBy("topic").agg(F.round(F.sum("score"), 6).alias("score"))
    rows = groups.join(weight.orderBy(F.desc("score"), "topic").limit(top), "topic").select("node", "score").orderBy(F.desc("score"), "node")
    return rows.limit(cap), rows.limit(cap + 1).count() > cap
