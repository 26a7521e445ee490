"""Mapped tables: rows of ordinary tables become typed nodes and links with content ids."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.text import content_id

NODE, LINK = ["id", "type", "key", "fields"], ["id", "predicate", "src", "dst"]


@dataclass(frozen=True)
class NodeMap:
    """``key``: the column that names a node; ``fields``: field name to column."""

    type: str
    key: str
    fields: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class LinkMap:
    predicate: str
    src: NodeMap
    dst: NodeMap


def _key(m: NodeMap):
    return F.trim(F.col(m.key).cast("string"))


def node_id(m: NodeMap):
    return content_id(F.lit(m.type), _key(m))


def map_nodes(rows: DataFrame, m: NodeMap, order: str | None = None, evidence: Column | None = None) -> DataFrame:
    """id, type, key, fields, and ``spans`` where ``evidence`` (a span column) says what a node stands on.

    Empty keys give no node; blank fields are left out; the first row of a key wins.

    ``order`` names the column that orders rows; without it the table's keys are taken to be unique.
    """
    names = [x for k, c in m.fields.items() for x in (F.lit(k), F.col(c).cast("string"))]
    filled = F.map_filter(F.create_map(*names), lambda _, v: F.trim(v) != "") if names else F.create_map().cast("map<string,string>")
    made = rows.where(_key(m) != "").select(node_id(m).alias("id"), F.lit(m.type).alias("type"), _key(m).alias("key"), filled.alias("fields"), *([F.array(evidence).alias("spans")] if evidence is not None else []), *([F.col(order).alias("o")] if order else []))
    if order is None:
        return made
    rest = [c for c in made.columns if c not in ("id", "o")]
    return made.groupBy("id").agg(F.min_by(F.struct(*rest), "o").alias("b")).select("id", "b.*")


def unmapped(rows: DataFrame, m: NodeMap) -> DataFrame:
    """Rows without a key, which give no node."""
    return rows.where(F.coalesce(_key(m), F.lit("")) == "")


def map_links(rows: DataFrame, m: LinkMap, evidence: Column | None = None) -> DataFrame:
    """id, predicate, src, dst; both ends in the same row, each link once.

    With ``evidence`` (a span column) a link has ``spans``, those of all its rows, which its id takes in.
    """
    if evidence is not None:
        both = rows.where((_key(m.src) != "") & (_key(m.dst) != "")).select(node_id(m.src).alias("src"), F.lit(m.predicate).alias("predicate"), node_id(m.dst).alias("dst"), evidence.alias("span"))
        once = both.groupBy("src", "predicate", "dst").agg(F.array_sort(F.collect_set("span")).alias("spans"))
        at = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["source_id"], s["segment"], s["start"], s["end"])), ",")
        return once.select(content_id(F.col("src"), F.col("predicate"), F.col("dst"), at).alias("id"), "predicate", "src", "dst", "spans")
    ends = rows.where((_key(m.src) != "") & (_key(m.dst) != "")).select(node_id(m.src).alias("src"), F.lit(m.predicate).alias("predicate"), node_id(m.dst).alias("dst")).distinct()
    return ends.select(content_id(F.col("src"), F.col("predicate"), F.col("dst")).alias("id"), "predicate", "src", "dst")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
