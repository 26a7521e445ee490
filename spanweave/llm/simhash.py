"""Near-duplicate documents by SimHash: exact linking at a Hamming radius, by tiles.

Fingerprints of equal value are one. To be within ``radius`` of each other, two fingerprints cut into
``radius + 1`` or more pieces must agree in some piece (in more, with more pieces), so each goes to
one cell for each combination of pieces, and linked ones meet in a cell. Cells are of even size; in a
cell everything is compared: sorted by population count, tile against tile, with numpy's exclusive-or
and bit counts, skipping pairs of tiles whose population counts differ beyond the radius. A piece
value that very many fingerprints share is dealt over a triangle of cells, so each pair still meets.
A cell gives a spanning forest of its links, never all pairs; components are joined from the forests.

Null and empty texts have fingerprint zero, which links like any other. Repeated rows share a
fingerprint. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import batches, forest, row_columns, text_key
from spanweave.operators.components import connected_components
from spanweave.session import materialize

_BIT = np.uint64(1)


def fingerprint_text(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats counted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, glue = xxhash.xxh64_intdigest, b" ".join
    h = np.fromiter((digest(glue(words[k : k + shingle]), seed) for k in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65_536):  # a very long text in pieces
        ones += np.unpackbits(h[lo : lo + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, th (key of the text) and fp (the fingerprint as a signed 64-bit number)."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = np.fromiter((fingerprint_text(t.as_py(), shingle, seed) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield from batches(schema, {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "fp": made.view(np.int64)})

    slim = row_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("th"), "text")
    return slim.mapInArrow(read, "doc_id long, th long, fp long")


def tile_links(values: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, its component's smallest member) of all links within a cell."""
    values = np.unique(values.view(np.uint64))
    counts = np.bitwise_count(values)
    order = np.argsort(counts, kind="stable")
    values, counts = values[order], counts[order].astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for i in range(0, len(values), tile):
        a, top = values[i : i + tile], counts[min(i + tile, len(values)) - 1]
        for j in range(i, len(values), tile):
            if counts[j] - top > radius:
                break  # all later tiles are farther still
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ values[None, j : j + tile]) <= radius)
            x, y = x + i, y + j
            off = x < y
            found.append((x[off], y[off]))
            held += int(off.sum())
            if held > 2_000_000:  # dense: keep the forest so far
                label = forest(len(values), *(np.concatenate(s) for s in zip(*found)))
                node = np.flatnonzero(label != np.arange(len(values)))
                found, held = [(node, label[node])], len(node)
    if not held:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label = forest(len(values), *(np.concatenate(s) for s in zip(*found)))
    node = np.flatnonzero(label != np.arange(len(values)))
    return values[node].view(np.int64), values[label[node]].view(np.int64)


def _pieces(n: int, radius: int) -> list[int]:
    """Masks to agree under: more bits where more fingerprints would meet by chance."""
    parts = radius + (1 if n < 1 << 22 else 2 if n < 1 << 31 else 3)
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, parts - radius)]


def link_fingerprints(fps: DataFrame, radius: int = 3, cell_rows: int = 8192) -> DataFrame:
    """(a, b): forests of links between distinct fingerprints (column fp) of Hamming distance <= radius."""
    n = fps.count()
    masks = _pieces(n, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    cells = max(1, -(-n * len(masks) // cell_rows))
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for k, m in enumerate(signed)]))
    spread = fps.select("fp", key.alias("p")).select("fp", "p.k", "p.m")
    crowded = spread.groupBy("k", "m").count().where(F.col("count") > cell_rows).select("k", "m", F.ceil(F.col("count") / cell_rows).cast("int").alias("tiles"))
    tiles = F.coalesce("tiles", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    # each pair of a crowded key's tiles is a cell of its own; other keys share even cells
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    dealt = spread.join(crowded, ["k", "m"], "left").select("fp", "k", "m", "tiles", mine.alias("t"), other.alias("o"))
    even = F.struct(F.lit(0).alias("c"), F.pmod(F.xxhash64("k", "m"), F.lit(cells)).alias("x"), F.lit(0).alias("t"), F.lit(0).alias("o"))
    own = F.struct(F.lit(1).alias("c"), F.xxhash64("k", "m").alias("x"), F.least("t", "o").alias("t"), F.greatest("t", "o").alias("o"))
    placed = dealt.select("fp", F.when(F.col("tiles").isNull(), even).otherwise(own).alias("cell"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        a, b = tile_links(table.column("fp").to_numpy(), radius)
        return pa.table({"a": a, "b": b}, schema=schema)

    return placed.groupBy("cell").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, cell_rows: int = 8192) -> DataFrame:
    """A row a document: doc_id, th, fp, component_id, the smallest doc_id that links lead to, and component.

    A null doc_id takes part in links; component_id is null where all of a component's documents have
    a null doc_id. ``component``, the component's smallest fingerprint, is never null and its own.
    """
    rows = materialize(fingerprints(docs, shingle, seed), "simhash")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-simhash", rows.count())
    n = fps.count()
    links = materialize(link_fingerprints(fps.select("fp"), radius, cell_rows), "simhash-links", n)
    parts = materialize(connected_components(links, "a", "b", n).withColumnRenamed("node", "fp"), "simhash-parts", n)
    named = fps.join(parts, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "component").select("fp", "component_id", "component"), "fp")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents, one of each group: the row with the component's smallest (doc_id, text key).

    All columns are kept; of repeated equal rows one stays.
    """
    found = near_duplicates(docs, **options)
    best = found.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("th").alias("h"))).alias("best"))
    stay = best.select(F.col("best.d").alias("__sw_d"), F.col("best.h").alias("__sw_h"))
    keyed = docs.withColumns({"__sw_d": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "__sw_h": text_key(F.col("text"))})
    kept = keyed.join(stay, ["__sw_d", "__sw_h"], "left_semi").dropDuplicates(["__sw_d", "__sw_h"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
