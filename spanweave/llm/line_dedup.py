"""Removes lines that other documents have too, on DataFrame functions alone.

Each normalised line becomes a 128-bit hash, written once. A hash is in two documents or more exactly
where its smallest and largest doc_id differ, so counting needs no set of documents: one aggregation
with map-side combining, however frequent the line. Texts are not shuffled for that, only hashes with
positions; the positions to drop then go back to their documents, once. Lines that make up more than
1/512 of all, of which there can be 512 at most, are looked up by a broadcast instead of the join.

A document is known by its doc_id: rows that share one count as one document. Documents with a null
doc_id count as one that comes last. A null or empty text is one empty line. Repeated rows are each
treated alike. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import BLANKS, text_key, whole_text
from spanweave.session import materialize

_LAST = (1 << 63) - 1


def trimmed(line: Column) -> Column:
    """The line without blanks at its ends."""
    return F.btrim(line, F.lit(BLANKS))


def folded_hash(line: Column) -> Column:
    """128-bit hash that is equal for lines equal but for the case of A-Z.

    ``lower`` would change other letters too. Read as ISO 8859-1, the UTF-8 bytes of other letters
    change only in their lead byte, from a two-byte lead to a longer one, and how many bytes follow
    still tells those apart: so the result differs exactly where the line does.
    """
    bytes_as_text = F.decode(F.encode(line, "UTF-8"), "ISO-8859-1")
    return F.unhex(F.md5(F.lower(F.when(F.octet_length(line) == F.length(line), line).otherwise(bytes_as_text))))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with text reduced to the lines that stay, and n_lines, n_dropped (long).

    A line goes where its key has ``min_chars`` code points or more and another document with a
    smaller doc_id has it too. The new columns are ``__sw_n_lines`` and ``__sw_n_dropped``.
    """
    columns = docs.columns
    keyed = docs.withColumns({"__sw_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "__sw_h": text_key(F.col("text"))})
    lines = keyed.select("__sw_d", "__sw_h", F.posexplode(F.split(whole_text(), "\n")).alias("pos", "line"))
    long_ones = lines.select("__sw_d", "__sw_h", "pos", trimmed(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = materialize(long_ones.select("__sw_d", "__sw_h", "pos", folded_hash(F.col("key")).alias("h")), "lines")
    counted = hashed.groupBy("h").agg(F.min("__sw_d").alias("first"), F.max("__sw_d").alias("last"), F.count("*").alias("n")).where("first < last")
    shared = materialize(counted.select("h", "first", "n"), "shared-lines")
    most = hashed.count() // 512
    frequent = shared.where(F.col("n") > most).select("h", "first")  # 512 rows at most
    rare = shared.where(F.col("n") <= most).select("h", "first")
    often = hashed.join(F.broadcast(frequent), "h")
    seldom = hashed.join(F.broadcast(frequent), "h", "left_anti").join(rare, "h")
    drops = often.unionByName(seldom).where(F.col("__sw_d") > F.col("first"))
    gone = drops.groupBy("__sw_d", "__sw_h").agg(F.collect_set("pos").alias("__sw_gone"))
    parts = F.split(whole_text(), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__sw_gone"))
    kept = F.when(F.col("__sw_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda k: F.get(parts, k)), "\n"))
    joined = keyed.join(gone, ["__sw_d", "__sw_h"], "left")
    return joined.select(
        *[kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in columns],
        F.size(parts).cast("long").alias("__sw_n_lines"),
        F.coalesce(F.size("__sw_gone"), F.lit(0)).cast("long").alias("__sw_n_dropped"),
    )
