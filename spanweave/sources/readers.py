"""Text and table sources cut into numbered segments, and the files that the engine writes and reads back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(docs: DataFrame, split: str = "window", window: int = 2000) -> DataFrame:
    """source_id, number, text of documents (source_id, text): ``window``, ``whole`` or ``blank-line``.

    Text stays verbatim; pieces of white space alone go before pieces are numbered from 1.
    """
    if split == "whole":
        pieces = F.array("text")
    elif split == "blank-line":
        pieces = F.split("text", r"\n[ \t]*\n")
    elif split == "window":
        starts = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1, F.lit(window))).otherwise(F.array().cast("array<int>"))
        pieces = F.transform(starts, lambda i: F.substring(F.col("text"), i + 1, F.lit(window)))
    else:
        raise ValueError(f"unknown split: {split}")
    kept = F.filter(pieces, lambda p: ~F.coalesce(p.rlike(r"(?U)^\s*$"), F.lit(True)))
    return docs.select("source_id", F.posexplode(kept).alias("number", "text")).withColumn("number", F.col("number") + 1)


def ingest_text(spark: SparkSession, path: str, **options) -> DataFrame:
    """Segments of UTF-8 files; a source's id is the digest of its bytes."""
    files = spark.read.format("binaryFile").load(path)
    docs = files.select(F.substring(F.sha2("content", 256), 1, 12).alias("source_id"), F.decode("content", "UTF-8").alias("text"))
    return cut(docs, **options)


def render(columns: list[str]) -> Column:
    """A row as text: ``name: value | name: value`` and a line feed; null is empty."""
    return F.concat(F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]), F.lit("\n"))


def cell_offsets(columns: list[str]) -> list[Column]:
    """Where each cell's value starts in the rendering: running lengths, so no value can be mistaken."""
    out, at = [], F.lit(0)
    for c in columns:
        at = at + F.lit(len(c) + 2)
        out.append(at.alias(f"{c}_start"))
        at = at + F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) + 3
    return out


def cell_span(columns: list[str], column: str | None, source_id: Column, number: Column) -> Column:
    """The span of a cell in its row's rendering, or of the whole row without its line end."""
    starts = dict(zip(columns, cell_offsets(columns)))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    text = value(column) if column else F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), value(c)) for c in columns])
    start = starts[column] if column else F.lit(0)
    return F.struct(source_id.cast("string").alias("source_id"), number.cast("int").alias("segment"), start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("end"), text.alias("text"))


def ingest_pdf(spark: SparkSession, path: str) -> DataFrame:
    """A segment a page: source_id, number, text, title, author. Needs a PDF library on the workers; none comes with this package."""

    def read(rows):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for batch in rows:
            out = []
            for source_id, content in zip(batch["source_id"], batch["content"]):
                pdf = PdfReader(io.BytesIO(content))
                told = pdf.metadata or {}
                out += [(source_id, k, page.extract_text() or "", told.get("/Title"), told.get("/Author")) for k, page in enumerate(pdf.pages, 1)]
            yield pd.DataFrame(out, columns=["source_id", "number", "text", "title", "author"])

    files = spark.read.format("binaryFile").load(path).select(F.substring(F.sha2("content", 256), 1, 12).alias("source_id"), "content")
    return files.mapInPandas(read, "source_id string, number int, text string, title string, author string").where(F.trim("text") != "")


def ingest_table(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """The rows of a delimited file with their rendering in column ``rendered``."""
    rows = spark.read.csv(path, header=True, sep=delimiter, encoding=encoding, inferSchema=False)
    return rows.withColumn("rendered", render(rows.columns))


def write_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """An append-only folder of JSON lines under an explicit schema."""
    return spark.read.schema(schema).json(path)


def triples(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """s, p, o of a graph: types, fields and links, for a text sink of N-Triples."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    iri = lambda c: F.concat(F.lit("<urn:"), c, F.lit(">"))
    typed = nodes.select(iri(F.col("id")).alias("s"), F.lit("<urn:type>").alias("p"), iri(F.col("type")).alias("o"))
    fields = nodes.select("id", F.explode("fields").alias("k", "v")).select(iri(F.col("id")).alias("s"), iri(F.col("k")).alias("p"), quoted(F.col("v")).alias("o"))
    return typed.unionByName(fields).unionByName(links.select(iri(F.col("src")).alias("s"), iri(F.col("predicate")).alias("p"), iri(F.col("dst")).alias("o")))
