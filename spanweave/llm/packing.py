"""Best-two-fit packing of documents into training sequences.

A bin is filled greedily, longest fitting piece first; then its smallest piece makes way for two
unpacked pieces that fit the widened gap more tightly. Pieces are at most ``capacity`` long, so all
that matters of a million pieces is how many there are of each length. The plan is therefore made
over that histogram, at most ``capacity`` numbers whatever the input, a pattern of lengths and how
often it is used at a time. Pieces get their place by their rank among pieces of the same length:
rank decides pattern, bin and offset by arithmetic. Ranks come from counts a (part, length), so no
length, however frequent, has to be in one task.

Null texts are empty and have the end id alone; repeated rows are packed each on its own; an empty
table gives an empty result; other columns are ignored. Rows with a null doc_id keep it null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.llm.common import batches, row_columns, whole_text
from spanweave.llm.tokens import encoder
from spanweave.session import materialize


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a bin, how many bins) that use up the histogram of lengths."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sizes = np.arange(capacity + 1)
    plan: list[tuple[list[int], int]] = []
    while (there := np.flatnonzero(left)).size:
        used: dict[int, int] = {}
        fitting = np.maximum.accumulate(np.where(left > 0, sizes, 0))

        def largest(room: int) -> int:
            """The longest unpacked piece that fits."""
            while room > 0 and (found := int(fitting[room])):
                if left[found] > used.get(found, 0):
                    return found
                room = found - 1
            return 0

        gap, bin_ = capacity, []
        while piece := largest(gap):
            bin_.append(piece)
            used[piece] = used.get(piece, 0) + 1
            gap -= piece
        if gap and len(bin_) > 1:
            smallest = bin_.pop()
            used[smallest] -= 1
            room, best = gap + smallest, (smallest, 0)
            for a in there[there <= room][::-1].tolist():  # the longer of the two
                if 2 * a <= sum(best):
                    break
                if left[a] > used.get(a, 0):
                    used[a] = used.get(a, 0) + 1
                    b = largest(min(a, room - a))
                    used[a] -= 1
                    if b and a + b > sum(best):
                        best = (a, b)
                        if a + b == room:
                            break
            for piece in best:
                if piece:
                    bin_.append(piece)
                    used[piece] = used.get(piece, 0) + 1
        times = min(int(left[k]) // n for k, n in used.items() if n)
        for k, n in used.items():
            left[k] -= n * times
        plan.append((bin_, times))
    return plan


def _slots(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """A row for each slot of each pattern: its length, its first rank, its first bin, its offset."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for lengths, times in plan:
        at = 0
        for length in lengths:
            rows.append((length, taken.get(length, 0), first, at))
            taken[length] = taken.get(length, 0) + times
            at += length
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) + table[:, 1], "rank": table[:, 1], "bin": table[:, 2], "offset": table[:, 3]}


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """A row for each piece of each document, with its task and its rank there among equal lengths."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, end = encoder(tokenizer), TaskContext.get().partitionId(), struct.pack("<I", end_id)
        seen = [0] * (capacity + 1)
        for batch in rows:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                out: list[tuple] = []
                for doc_id, ids in zip(some.column(0).to_pylist(), code.encode(some.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        out.append((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), part, seen[b - a]))
                        seen[b - a] += 1
                yield from batches(schema, dict(zip(schema.names, map(list, zip(*out)))))

    slim = row_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return slim.mapInArrow(cut, f"{_PIECE}, part int, nth long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Packs all documents; returns a row a piece with its sequence and its offset there.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document longer than ``capacity``
    is cut into full pieces, of which the first may be shorter.
    """
    pieces = materialize(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    counted = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = _slots(best_two_fit(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = pa.schema([*[(f, pa.int32() if f == "piece" else pa.int64()) for f in ("doc_id", "piece", "start", "length", "ids_crc32")], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
                k = np.searchsorted(slots["key"], (length << 48) + rank, "right") - 1
                kept = {f: batch.column(f) for f in schema.names[:5]}
                yield from batches(schema, kept | {"sequence_id": slots["bin"][k] + rank - slots["rank"][k], "offset": slots["offset"][k]}, batch.num_rows)

    ranked = pieces.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, f"{_PIECE}, sequence_id long, offset long")
