"""Queries over the operators of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import line_dedup, mixing, packing, pseudonyms, quality, simhash, sketches, suffixes, token_output, toxicity
from spanweave.llm.common import row_columns, whole_text
from spanweave.session import load


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_output.write_token_files(load(spark, sf_dir, "documents"), _path("word_bpe_49k.json"), end_id=1)
    return token_output.token_digests(files)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(load(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = row_columns(load(spark, sf_dir, "documents"), "doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", F.col("__sw_n_lines").alias("n_lines"), F.col("__sw_n_dropped").alias("n_dropped"), F.sha2(whole_text(), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, t.pos AS pos, t.line AS line,
         translate(trim(t.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents) t
), s AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
j AS (SELECT l.doc_id, l.pos, l.line, s.first IS NOT NULL AND l.doc_id > s.first AS gone FROM l LEFT JOIN s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = row_columns(load(spark, sf_dir, "documents"), "doc_id", "text")
    rules = quality.learn_rules(docs, load(spark, sf_dir, "labels"))
    made = quality.with_statistics(docs)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return made.select("doc_id", *[F.col("__sw_" + s).alias(s) for s in base], quality.base_failed().alias("base_failed"), quality.kept(rules).alias("kept"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, load(spark, sf_dir, "labels")))


def op8_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sketches.compare_edited(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


#: The session's setting that holds the key of pseudonyms.
KEY = "spark.spanweave.pseudonym.key"


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text with pseudonyms, and how many values of each kind were replaced.

    The key is the session's; where it has none, a random one is made and kept for the session.
    """
    key = spark.conf.get(KEY, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY, key)
    docs = row_columns(load(spark, sf_dir, "documents"), "doc_id", "text")
    out = pseudonyms.pseudonymise(docs, key)
    return out.select("doc_id", "text", *[F.col("__sw_found")[k].alias(f"n_{k}") for k in pseudonyms.KINDS])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(load(spark, sf_dir, "documents"))
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", n_removed.cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_source_mix, op3_line_dedup, op4_quality_rules, op5_simhash, op6_best_fit, op7_toxicity, op8_sketches, op9_pseudonyms, op10_suffix_dedup)}
ORACLE_SQL = {"op3_line_dedup": OP3_SQL}
