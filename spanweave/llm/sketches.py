"""Document fingerprints as invertible Bloom lookup sketches, on DataFrame functions alone.

A text's paragraphs (pieces between line feeds or sentence ends, white space around them dropped, empty
ones left out) become a set of 64-bit digests. The fingerprint deals them by their high bits to buckets,
a power of two of them, so that a bucket has ``BUCKET`` digests or fewer on average; a bucket has three
tables of cells, and a digest goes into one cell of each, where digests are counted and joined by
exclusive-or with their check sums. A fingerprint therefore grows with its text.

Two stored fingerprints subtract: the one of more buckets is folded to the other's number by adding
neighbouring buckets cell by cell, then cells subtract, and what both have vanishes. A cell with one
digest left gives it away; taking it out of its other cells frees more, until nothing is left: the
digests that differ, with the side they are on. Where cells stay full the sketch was too small: that
bucket's digests are dealt to twice the buckets, and again, until they are few enough to be sketched and
peeled anew. Two digests that differ part at the 64th doubling at the latest, so that this always ends. Work is in
proportion to the number of digests and the logarithm of the number of buckets. The likeness is the
share of the united paragraphs that both have, 1 where both have none.

A null text counts as empty and has no paragraphs. Repeats and the order of paragraphs do not count.
Equal texts have equal fingerprints. Repeated rows are treated alike; other columns are ignored. A text
of any length is one row: its digests, about an eighth of it, have to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.common import row_columns, whole_text

#: Cells in each of a bucket's three tables.
SIZE = 8
#: Digests of one text that share a bucket on average, at most.
BUCKET = 12
_ROUNDS = 16
#: Digests that peel from a bucket's 24 cells nearly always, and the empty cells below which there are too many.
_FEW, _EMPTY = 18, 2
_ENDS = r"[.!?]+[ \t]+|[ \t]*[\n\r]+"
_LEAST = -(1 << 63)
_PAIR = "struct<l:array<bigint>,r:array<bigint>>"
_FOUND = "array<struct<k:bigint,n:int>>"


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` is the value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def paragraph_digests(text: Column) -> Column:
    """The set of a text's paragraph digests, sorted."""
    pieces = F.filter(F.transform(F.split(text, _ENDS), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p))))


# The functions below write SQL, which is far quicker to make than nested columns.


def _goes(digest: str, cell: str, table: int) -> str:
    """Whether a digest goes to a table's cell, whose number stands at the table's bits."""
    return f"{digest} & {SIZE - 1 << 9 * table}L = {cell}"


def _cells(table: int) -> str:
    return f"sequence(0L, {SIZE - 1 << 9 * table}L, {1 << 9 * table}L)"


def _half(digests: str, level: str, bit: int) -> str:
    """The digests of a bucket whose bit of a level, counted from the highest, is 0 or 1."""
    return f"filter({digests}, d -> shiftrightunsigned(d, 64 - {level}) & 1L = {bit}L)"


def level_of(digests: str) -> str:
    """The doublings from one bucket to a text's number of buckets."""
    return f"CAST(ceil(log2(greatest(1.0D, size({digests}) / {BUCKET}.0D))) AS INT)"


def split(digests: str, level: str) -> str:
    """The digests by bucket: each level halves all buckets by one more bit."""
    halves = f"flatten(transform(a, b -> array({_half('b', 'j', 0)}, {_half('b', 'j', 1)})))"
    return f"aggregate(slice(sequence(1, 64), 1, {level}), array({digests}), (a, j) -> {halves})"


def sketch(digests: str) -> str:
    """The three tables of one bucket in a row: structs n, k, c."""
    cell = "named_struct('n', size(m), 'k', aggregate(m, 0L, (a, d) -> a ^ d), 'c', aggregate(m, 0, (a, d) -> a ^ hash(d)))"
    tables = [f"transform({_cells(t)}, i -> {_let(f'filter({digests}, d -> {_goes("d", "i", t)})', 'm', cell)})" for t in range(3)]
    return f"concat({', '.join(tables)})"


def fingerprint(digests: str) -> str:
    """All buckets' cells: an array of buckets, each ``3 * SIZE`` cells."""
    return f"transform({split(digests, level_of(digests))}, b -> {sketch('b')})"


def add(left: str, right: str, sign: str = "+") -> str:
    """Cell by cell sum (or difference) of two buckets."""
    return f"zip_with({left}, {right}, (x, y) -> named_struct('n', x.n {sign} y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def fold(buckets: str, number: str) -> str:
    """A fingerprint with its neighbouring buckets added until ``number`` of them are left."""
    group = f"slice({buckets}, i * g + 1, g)"
    summed = f"transform(sequence(0, {number} - 1), i -> aggregate(slice({group}, 2, g - 1), element_at({group}, 1), (u, v) -> {add('u', 'v')}))"
    return f"CASE WHEN size({buckets}) = {number} THEN {buckets} ELSE {_let(f'CAST(size({buckets}) DIV {number} AS INT)', 'g', summed)} END"


def peel(cells: str) -> str:
    """The digests left in a bucket's difference: structs k, n (1: only left, -1: only right); null on failure."""
    full = "exists(s.cells, c -> c.n <> 0 OR c.k <> 0)"
    lone = "filter(s.cells, c -> (c.n = 1 OR c.n = -1) AND c.c = hash(c.k))"
    tables = []
    for t in range(3):
        taken = f"aggregate(filter(f, p -> {_goes('p.k', 'i', t)}), c, (a, p) -> named_struct('n', a.n - p.n, 'k', a.k ^ p.k, 'c', a.c ^ hash(p.k)))"
        tables.append(f"zip_with(slice(s.cells, {t * SIZE + 1}, {SIZE}), {_cells(t)}, (c, i) -> {taken})")
    freed = f"named_struct('cells', concat({', '.join(tables)}), 'out', concat(s.out, f), 'go', true)"
    step = _let(f"array_distinct(transform({lone}, c -> named_struct('k', c.k, 'n', c.n)))", "f", f"CASE WHEN size(f) > 0 THEN {freed} ELSE named_struct('cells', s.cells, 'out', s.out, 'go', false) END")
    start = f"named_struct('cells', {cells}, 'out', CAST(array() AS {_FOUND}), 'go', true)"
    return _let(f"aggregate(sequence(1, {_ROUNDS}), {start}, (s, r) -> CASE WHEN s.go THEN {step} ELSE s END)", "s", f"CASE WHEN NOT {full} THEN s.out END")


def subtracted(left: str, right: str) -> str:
    """By bucket of the smaller of two fingerprints: the digests that differ, null where they do not peel."""
    sparse = f"size(filter(z, c -> c.n = 0 AND c.k = 0)) >= {_EMPTY}"
    both = f"zip_with({fold(left, 'w')}, {fold(right, 'w')}, (u, v) -> {add('u', 'v', '-')})"
    return _let(f"least(size({left}), size({right}))", "w", f"transform({both}, z -> CASE WHEN {sparse} THEN {peel('z')} END)")


def differing(left: str, right: str, left_print: str, right_print: str) -> str:
    """The digests of one set and not the other: from the fingerprints, and larger ones where those fail."""
    level = f"CAST(round(log2(least(size({left_print}), size({right_print})))) AS INT)"
    pairs = f"zip_with({split(left, 'lv')}, {split(right, 'lv')}, (x, y) -> named_struct('l', x, 'r', y))"
    failed = f"filter({pairs}, (p, i) -> got[i] IS NULL)"
    half = lambda bit: f"named_struct('l', {_half('p.l', 'j', bit)}, 'r', {_half('p.r', 'j', bit)})"
    tried = _let(sketch("p.l"), "u", _let(sketch("p.r"), "v", peel(add("u", "v", "-"))))
    judged = f"named_struct('p', p, 'got', CASE WHEN size(p.l) + size(p.r) <= {_FEW} THEN {tried} END)"
    halves = f"filter(flatten(transform(s.todo, p -> array({half(0)}, {half(1)}))), p -> size(p.l) + size(p.r) > 0)"
    step = _let(
        f"transform({halves}, p -> {judged})",
        "t",
        "named_struct('todo', transform(filter(t, x -> x.got IS NULL), x -> x.p), 'out', concat(s.out, flatten(transform(filter(t, x -> x.got IS NOT NULL), x -> x.got))))",
    )
    start = f"named_struct('todo', CAST({failed} AS array<{_PAIR}>), 'out', CAST(flatten(filter(got, x -> x IS NOT NULL)) AS {_FOUND}))"
    retried = f"aggregate(slice(sequence(1, 64), lv + 1, 64), {start}, (s, j) -> CASE WHEN size(s.todo) > 0 THEN {step} ELSE s END).out"
    return _let(subtracted(left_print, right_print), "got", f"CASE WHEN exists(got, x -> x IS NULL) THEN {_let(level, 'lv', retried)} ELSE flatten(got) END")


def likeness(left: str, right: str, left_print: str, right_print: str) -> str:
    """Share of the united paragraphs that both versions have."""
    both = f"(size({left}) + size({right}))"
    return _let(f"size({differing(left, right, left_print, right_print)})", "n", f"CASE WHEN {both} = 0 THEN 1.0D ELSE ({both} - n) / ({both} + n) END")


def as_text(buckets: str) -> str:
    """A fingerprint as base 64 text: per cell a count (2 bytes), digests (8) and check sums (4)."""
    shown = "lpad(hex(c.n), 4, '0') || lpad(hex(c.k), 16, '0') || lpad(substr(hex(c.c), -8), 8, '0')"
    return f"base64(unhex(array_join(transform(flatten({buckets}), c -> {shown}), '')))"


def from_text(text: str) -> str:
    """The buckets that ``as_text`` wrote."""
    signed = lambda at, n: f"CAST(conv(substr(h, i + {at}, {n}), 16, -10) AS BIGINT)"
    check = _let(signed(21, 8), "v", "CAST(CASE WHEN v >= 2147483648L THEN v - 4294967296L ELSE v END AS INT)")
    cell = f"named_struct('n', CAST({signed(1, 4)} AS INT), 'k', {signed(5, 16)}, 'c', {check})"
    width = 28 * 3 * SIZE
    return _let(f"hex(unbase64({text}))", "h", f"transform(sequence(0, CAST(length(h) DIV {width} AS INT) - 1), b -> transform(sequence(b * {width}, b * {width} + {width - 28}, 28), i -> {cell}))")


def with_next(docs: DataFrame, block_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, text and the digests of every document and its next one in descending doc_id order.

    Columns doc_id, text, digests, next_text, next_digests. After the last document comes the first.
    Documents of one doc_id are ordered by a hash of the text; null ids come last. Texts are shuffled
    once: to blocks of neighbours, whose bounds come from range partitions of the ids, two numbers a
    document; there are more blocks for more bytes, so that a task stays small. A copy of the document
    that follows a block travels with it. Only bounds, one a block, reach the driver.
    """
    spark = docs.sparkSession
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("d"), F.xxhash64("text").alias("h")]
    slim = row_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).select("doc_id", "text", *keys)
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))
    key = F.struct("d", "h")
    parts = slim.select("d", "h").repartitionByRange(n, "d", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    bounds = sorted((r["low"]["d"], r["low"]["h"], r["high"]["d"], r["high"]["h"]) for r in parts.collect())  # a row a partition
    if not bounds:
        bounds = [(0, 0, 0, 0)]
    lows = F.struct(F.lit([b[0] for b in bounds]).cast("array<bigint>").alias("d"), F.lit([b[1] for b in bounds]).cast("array<bigint>").alias("h"))
    middle = "(s.a + s.b) DIV 2"
    not_above = f"(get(lows.d, CAST({middle} AS INT)) < d OR get(lows.d, CAST({middle} AS INT)) = d AND get(lows.h, CAST({middle} AS INT)) <= h)"
    halve = f"CASE WHEN s.b - s.a <= 1 THEN s WHEN {not_above} THEN named_struct('a', {middle}, 'b', s.b) ELSE named_struct('a', s.a, 'b', {middle}) END"
    found = F.expr(f"CAST(aggregate(sequence(1, {len(bounds).bit_length() + 1}), named_struct('a', 0L, 'b', {len(bounds)}L), (s, r) -> {halve}).a AS INT)")
    rows = slim.withColumn("digests", paragraph_digests(F.col("text")))
    own = rows.withColumn("lows", lows).withColumn("block", found).drop("lows").withColumn("guest", F.lit(False))
    heads = spark.createDataFrame([(b[2], b[3], (k + 1) % len(bounds)) for k, b in enumerate(bounds)], "d long, h long, block int")
    guests = rows.join(F.broadcast(heads), ["d", "h"]).withColumn("guest", F.lit(True))  # a row a block
    order = Window.partitionBy("block").orderBy("guest", F.desc("d"), F.desc("h"))
    both = own.unionByName(guests.select(*own.columns))
    return both.withColumns({"next_text": F.lead("text").over(order), "next_digests": F.lead("digests").over(order)}).where("NOT guest").select("doc_id", "text", "digests", "next_text", "next_digests")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and likenesses.

    The edited text has the last floor(n_chars / 2) code points replaced by as many first ones (or all)
    of the next document. Returns doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint,
    near_edited, near_next, and the digests that the edit removed and added (arrays of long).
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = with_next(docs).withColumn("edited", edited)
    made = made.withColumn("edited_digests", paragraph_digests(F.col("edited")))
    made = made.withColumns({"own": F.expr(fingerprint("digests")), "new": F.expr(fingerprint("edited_digests")), "following": F.expr(fingerprint("next_digests"))})
    diff = made.withColumn("diff", F.expr(differing("digests", "edited_digests", "own", "new")))
    both = F.size("digests") + F.size("edited_digests")
    side = lambda k: F.transform(F.filter("diff", lambda x: x["n"] == k), lambda x: x["k"])
    return diff.select(
        "doc_id", n.cast("long").alias("n_chars"), "edited",
        F.expr(as_text("own")).alias("fingerprint"), F.expr(as_text("new")).alias("edited_fingerprint"),
        F.when(both == 0, F.lit(1.0)).otherwise((both - F.size("diff")) / (both + F.size("diff"))).alias("near_edited"),
        F.expr(likeness("digests", "next_digests", "own", "following")).alias("near_next"),
        side(1).alias("removed"), side(-1).alias("added"),
    )
