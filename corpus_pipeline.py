"""A training-data pipeline over ``documents``; each stage's result is written and read by the next.

quality rules -> line dedup -> SimHash near-dedup -> mixing to target weights -> best-fit packing.

Null and empty texts have no words, so the base rules reject them. Documents of a null doc_id take part
in all stages and keep it null; to line dedup they are one document that comes last. Of linked documents
the one of the smallest doc_id stays, of equal rows one. A null source is the last source of the mix. An
empty ``documents`` gives an empty result. Other columns travel through the first four stages, whatever
their names.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import line_dedup, mixing, packing, quality, simhash
from spanweave.session import load, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    return quality.filter_quality(docs, load(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("__sw_n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row each time the mix takes a document, shard by shard; a source's last one is cut to its first words."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece, with its sequence of at most 2048 tokens and its place there."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The learned rules, the fingerprints and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = os.path.join(shared_dir(spark), "spanweave", f"stage-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
