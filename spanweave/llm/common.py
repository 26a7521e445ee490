"""What the operators of this package share: word patterns, row keys, small numpy helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: code points other than blank and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole_text(col: str | Column = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0), on the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """A 64-bit key of a text; with the id it names a row's content (null texts have their own)."""
    return F.xxhash64(F.when(text.isNull(), F.lit("n")).otherwise(F.lit("t")), text)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters kept.

    ``lower`` also changes other letters, but is far faster than ``translate``; it is taken where
    the characters beyond ASCII come out as they went in.
    """
    low = F.lower(text)
    rest = lambda c: F.regexp_replace(c, r"[\x00-\x7F]+", "")
    same = (F.octet_length(text) == F.length(text)) | (rest(text) == rest(low))
    return F.when(same, low).otherwise(F.translate(text, UPPER, LOWER))


def batches(schema: pa.Schema, rows: dict[str, list | np.ndarray | pa.Array], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of a schema; nothing for no rows."""
    table = pa.table([pa.array(rows[f.name], f.type) if not isinstance(rows[f.name], (pa.Array, pa.ChunkedArray)) else rows[f.name].cast(f.type) for f in schema], schema=schema)
    yield from table.to_batches(max_chunksize=most)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges (a, b) lead to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(up := label[label], label):
            label = up
        keep = label[a] != label[b]
        a, b = label[a[keep]], label[b[keep]]
    return label


def row_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column's name can clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
