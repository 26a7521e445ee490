"""Stores of the assertion log: appended to, projected on reading, in Parquet, JSON lines or memory.

Tables: sources (id, origin, meta, text_hash, seq), segments (source_id, number, text), assertions (seq, id,
agent, at, kind, target_id, supersedes, confidence, node, link), schemas (version, axioms), runs. Nothing
is changed in place. A later batch has larger ``seq``; a batch is numbered by its writer, one at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions.text import content_id
from spanweave.operators import log
from spanweave.operators.locate import SPAN
from spanweave.plans.ontology import Ontology

NODE = f"struct<type:string,fields:map<string,string>,spans:array<{SPAN}>,schema_version:string>"
LINK = f"struct<predicate:string,src:string,dst:string,spans:array<{SPAN}>,fields:map<string,string>,schema_version:string>"
TABLES = {
    "sources": "id string, origin string, meta map<string,string>, text_hash string, seq long",
    "segments": "source_id string, number int, text string",
    "assertions": f"seq long, id string, agent struct<id:string,kind:string,label:string>, at string, kind string, target_id string, supersedes string, confidence double, node {NODE}, link {LINK}",
    "schemas": "version string, axioms string, seq long",
    "runs": "id string, at string, pipeline string, schema_version string, agent string, counts map<string,long>, seconds double, notes string, seq long",
}


class Store:
    """What all stores do; ``append`` and ``read`` are the store's own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def append(self, table: str, rows: DataFrame) -> None:
        raise NotImplementedError

    def read(self, table: str) -> DataFrame:
        raise NotImplementedError

    def _next(self, table: str) -> int:
        """Where the next batch's numbers begin."""
        last = self.read(table).agg(F.max("seq").alias("s")).first()["s"]
        return 0 if last is None else ((last >> 40) + 1) << 40

    def add_sources(self, sources: DataFrame, segments: DataFrame) -> None:
        """sources: id, origin, meta; the hash of a source is made from its segments."""
        each = F.concat(F.col("number").cast("string"), F.lit("\0"), "text", F.lit("\0"))
        text = segments.groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", each.alias("t")))), lambda x: x["t"]), "").alias("t"))
        numbered = sources.join(text, "id", "left").select("id", "origin", "meta", F.substring(F.sha2(F.coalesce("t", F.lit("")), 256), 1, 12).alias("text_hash"), (F.lit(self._next("sources")) + F.monotonically_increasing_id()).alias("seq"))
        self.append("sources", numbered)
        self.append("segments", segments.select("source_id", F.col("number").cast("int").alias("number"), "text"))

    def sources(self) -> DataFrame:
        """The last written of each id."""
        return log.latest(self.read("sources"))

    def segments(self) -> DataFrame:
        return self.read("segments").distinct()

    def assert_(self, at: str, nodes: DataFrame | None = None, links: DataFrame | None = None, agent: str = "", kind: str = "run", label: str = "", supersedes: str | None = None, confidence: float | None = None) -> int:
        """Appends an assertion a node and link and returns how many; refuses spans of unknown sources.

        The agent's id is its label, or ``kind:at``; an assertion's is a digest of agent, time and target.
        """
        who = agent or label or f"{kind}:{at}"
        fields = lambda d: F.col("fields") if "fields" in d.columns else F.create_map().cast("map<string,string>")
        version = lambda d: F.col("schema_version") if "schema_version" in d.columns else F.lit("")
        parts = []
        for d, what in ((nodes, "node"), (links, "link")):
            if d is None:
                continue
            spans = F.col("spans") if "spans" in d.columns else F.array().cast(f"array<{SPAN}>")
            shape = [F.col("type"), fields(d).alias("fields"), spans.alias("spans"), version(d).alias("schema_version")]
            if what == "link":
                shape = [F.col("predicate"), F.col("src"), F.col("dst"), spans.alias("spans"), fields(d).alias("fields"), version(d).alias("schema_version")]
            body = {"node": F.lit(None).cast(NODE), "link": F.lit(None).cast(LINK)} | {what: F.struct(*shape).cast(NODE if what == "node" else LINK)}
            parts.append(d.select(F.lit(what).alias("kind"), F.col("id").alias("target_id"), body["node"].alias("node"), body["link"].alias("link")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        spans = F.coalesce("node.spans", "link.spans")
        unknown = log.missing_sources(rows.select(F.explode(spans).alias("s")).select("s.source_id"), self.sources())
        if not unknown.isEmpty():
            raise ValueError(f"unknown source: {unknown.first()['source_id']}")
        made = rows.select(
            (F.lit(self._next("assertions")) + F.monotonically_increasing_id()).alias("seq"), content_id(F.lit(who), F.lit(at), F.col("target_id")).alias("id"),
            F.struct(F.lit(who).alias("id"), F.lit(kind).alias("kind"), F.lit(label).alias("label")).alias("agent"), F.lit(at).alias("at"), "kind", "target_id",
            F.lit(supersedes).cast("string").alias("supersedes"), F.lit(confidence).cast("double").alias("confidence"), "node", "link",
        )
        before = self.read("assertions").count()
        self.append("assertions", made)
        return self.read("assertions").count() - before

    def assertions(self, target: str | None = None) -> DataFrame:
        return log.history(self.read("assertions"), target)

    def nodes(self) -> DataFrame:
        """What holds now: id, type, fields, spans, schema_version, position."""
        return log.current(self.read("assertions")).where("kind = 'node'").select(F.col("target_id").alias("id"), "node.*", "position")

    def links(self) -> DataFrame:
        return log.current(self.read("assertions")).where("kind = 'link'").select(F.col("target_id").alias("id"), "link.*", "position")

    def get_nodes(self, ids: list[str]) -> DataFrame:
        """The nodes asked for, in that order."""
        return log.lookup(self.nodes(), ids)

    def by_type(self, name: str) -> DataFrame:
        """Nodes of exactly this type."""
        return self.nodes().where(F.col("type") == name)

    def select(self, sql: str) -> DataFrame:
        """One reading statement over the views sources, segments, nodes and links."""
        for name in ("sources", "segments", "nodes", "links"):
            getattr(self, name)().createOrReplaceTempView(name)
        return log.select(self.spark, sql)

    def add_schema(self, version: str, onto: Ontology) -> None:
        """Written once a version."""
        if self.get_schema(version) is None:
            axioms = json.dumps({k: sorted(v, key=str) for k, v in asdict(onto).items() if v}, default=list)
            self.append("schemas", self.spark.createDataFrame([(version, axioms, self._next("schemas"))], TABLES["schemas"]))

    def get_schema(self, version: str) -> Ontology | None:
        row = self.read("schemas").where(F.col("version") == version).orderBy("seq").first()
        tuples = lambda x: tuple(map(tuples, x)) if isinstance(x, list) else x
        return row and Ontology(**{k: frozenset(map(tuples, v)) for k, v in json.loads(row["axioms"]).items()})

    def add_run(self, at: str, pipeline: str, counts: dict[str, int], seconds: float, schema_version: str = "", agent: str = "", notes: str = "") -> None:
        row = (uuid.uuid4().hex[:16], at, pipeline, schema_version, agent, counts, seconds, notes, self._next("runs"))
        self.append("runs", self.spark.createDataFrame([row], TABLES["runs"]))

    def runs(self) -> DataFrame:
        return self.read("runs").orderBy("seq")


class FileStore(Store):
    """A folder a table, of Parquet or JSON files; ``path`` in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "parquet"):
        super().__init__(spark)
        self.path, self.kind = path.rstrip("/"), kind

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.format(self.kind).mode("append").save(f"{self.path}/{table}")

    def read(self, table: str) -> DataFrame:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).format(self.kind).load(f"{self.path}/{table}")


class MemoryStore(Store):
    """Tables of this session, for tests and small graphs."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self.tables: dict[str, DataFrame] = {}

    def append(self, table: str, rows: DataFrame) -> None:
        kept = self.spark.createDataFrame(rows.collect(), TABLES[table])  # what a session can hold
        self.tables[table] = self.read(table).unionByName(kept)

    def read(self, table: str) -> DataFrame:
        return self.tables.get(table, self.spark.createDataFrame([], TABLES[table]))


_KINDS: dict[str, Callable[[SparkSession, str], Store]] = {
    "parquet": FileStore,
    "jsonl": lambda spark, path: FileStore(spark, path, "json"),
    "memory": lambda spark, _: MemoryStore(spark),
}


def register_store(name: str, make: Callable[[SparkSession, str], Store]) -> None:
    _KINDS[name] = make


def open_store(spark: SparkSession, spec: str) -> Store:
    """``kind:path``, such as ``parquet:/data/graph`` or ``memory:``."""
    kind, _, path = spec.partition(":")
    if kind not in _KINDS:
        raise ValueError(f"unknown store '{kind}'; there are {', '.join(sorted(_KINDS))}")
    return _KINDS[kind](spark, path)


def to_markdown(sources: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, markdown): front matter with the text's hash, then each segment after its marker."""
    block = F.concat(F.lit("\n<!-- segment "), F.col("number").cast("string"), F.lit(" -->\n"), "text", F.lit("\n<!-- end -->\n"))
    body = segments.groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", block.alias("b")))), lambda x: x["b"]), "").alias("b"), F.count("*").alias("n"))
    head = F.concat(F.lit("---\nid: "), "id", F.lit("\norigin: "), "origin", F.lit("\ntext_hash: "), "text_hash", F.lit("\nsegments: "), F.col("n").cast("string"), F.lit("\n---\n"))
    return sources.join(body, "id").select("id", F.concat(head, "b").alias("markdown"))


def from_markdown(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, segments) of renderings; raises on reading one whose segments or hash were changed."""
    field = lambda name: F.regexp_extract("markdown", f"(?m)^{name}: (.*)$", 1)
    pattern = r"(?s)\n<!-- segment (\d+) -->\n(.*?)\n<!-- end -->\n"
    numbers, texts = (F.regexp_extract_all("markdown", F.lit(pattern), F.lit(k)) for k in (1, 2))
    read = pages.select(field("id").alias("id"), field("origin").alias("origin"), field("text_hash").alias("text_hash"), field("segments").cast("int").alias("n"), F.arrays_zip(numbers.alias("number"), texts.alias("text")).alias("parts"))
    each = F.array_join(F.transform("parts", lambda p: F.concat(p["number"], F.lit("\0"), p["text"], F.lit("\0"))), "")
    whole = (F.size("parts") == F.col("n")) & (F.substring(F.sha2(each, 256), 1, 12) == F.col("text_hash"))
    checked = read.withColumn("parts", F.when(whole, F.col("parts")).otherwise(F.raise_error(F.concat(F.lit("the rendering was changed: "), "id")).cast("array<struct<number:string,text:string>>")))
    segments = checked.select(F.col("id").alias("source_id"), F.explode("parts").alias("p")).select("source_id", F.col("p.number").cast("int").alias("number"), "p.text")
    return read.select("id", "origin", F.create_map().cast("map<string,string>").alias("meta"), "text_hash"), segments


def federate(spark: SparkSession, registries: dict[str, Store], versions: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """One log of what several stores hold, each record checked against its own store's sources.

    assertions: those that hold, as they are, with ``registry``; held: registry, id, target_id, reason of
    the others; origins: target_id, registries; sources: the first registry's of each id, by name. In this
    order a record is held: its source was not published, a span's segment is not there, a span no longer
    cuts its text, its schema version is not among ``versions`` (none: all are).
    """
    logs, spans, sources, segments = [], [], [], []
    for name, held in sorted(registries.items()):
        tag = F.lit(name).alias("registry")
        log_ = held.read("assertions").select(tag, "*")
        logs.append(log_)
        sources.append(held.sources().select(tag, "id", "origin", "meta", "text_hash"))
        segments.append(held.segments().select(tag, "*"))
    whole, known, text = (_union(parts) for parts in (logs, sources, segments))
    target = whole.select("registry", "id", "target_id", F.coalesce("node.spans", "link.spans").alias("spans"), F.coalesce("node.schema_version", "link.schema_version").alias("version"))
    spans = target.select("registry", "id", "version", F.explode_outer("spans").alias("s")).select("registry", "id", "version", "s.*")
    have = known.select("registry", F.col("id").alias("source_id"), F.lit(True).alias("there"))
    at = text.select("registry", "source_id", F.col("number").alias("segment"), F.col("text").alias("whole"))
    seen = spans.join(have, ["registry", "source_id"], "left").join(at, ["registry", "source_id", "segment"], "left")
    cut = F.expr("substr(whole, start + 1, end - start)") == F.col("text")
    why = lambda n, text, *of: F.struct(F.lit(n).alias("n"), F.format_string(text, *of).alias("why"))
    spanned = F.col("source_id").isNotNull()
    reason = (
        F.when(spanned & F.col("there").isNull(), why(1, "the registry published no source '%s' for it to stand on", "source_id"))
        .when(spanned & F.col("whole").isNull(), why(2, "segment %d is not in '%s'", "segment", "source_id"))
        .when(spanned & ~cut, why(3, "evidence at %d:%d-%d no longer cuts its own text out of the source", "segment", "start", "end"))
    )
    if versions:
        reason = reason.when(~F.coalesce(F.col("version").isin(*versions), F.lit(False)), why(4, "written under schema '%s', which is unmapped here", "version"))
    bad = seen.select("registry", "id", reason.alias("r")).where("r IS NOT NULL").groupBy("registry", "id").agg(F.min("r").alias("r"))
    held = whole.select("registry", "id", "target_id").join(bad, ["registry", "id"]).select("registry", "id", "target_id", F.col("r.why").alias("reason"))
    good = whole.join(bad.select("registry", "id"), ["registry", "id"], "left_anti")
    origins = good.groupBy("target_id").agg(F.array_sort(F.collect_set("registry")).alias("registries"))
    first = known.groupBy("id").agg(F.min_by(F.struct("origin", "meta", "text_hash"), "registry").alias("s")).select("id", "s.*")
    return {"assertions": good, "held": held, "origins": origins, "sources": first}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
