"""Mixing sources to target weights by a splitting tree over blocks, on DataFrame functions alone.

* Targets: sources in code-point order (null last) have weights that repeat; together they get a
  share of all words. No target exceeds ``cap`` times its source, the excess being dealt to the others
  by weight. That is one water level, read off the sorted ratios of cap to weight with running sums.
* Blocks: a hash deals a source's documents into blocks of about ``block_words`` words. A source
  takes its blocks in a hashed order, whole rounds first, then as many as its target still needs; only
  in the last block documents are taken one by one, and the very last is cut. Taken words therefore
  equal the target but for rounding.
* Splitting tree: the block draws are split among output shards by halving: of a node's draws an
  exact number, without replacement, goes left. How many each source sends left is then multivariate
  hypergeometric. Each shard draws its quota of each source's permuted blocks, disjoint from all
  others, and orders its documents by a hash.

There are at most ``max_blocks`` blocks besides one a source, at any size of input, so the tree works
on a small table; documents only meet the blocks in a join on (source, block), whose keys are even. Blocks
grow with the input instead: of 100 TB one has about 6 GB of text, some 2 million keys of 40 bytes, which
is what the task that orders a source's last block sorts. Targets take a row a source in one task.
Everything random is a hash with the seed: reruns agree. Null texts have no words and are never taken
but in whole rounds; a null doc_id is an id of its own; equal rows are dealt together; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.common import text_key, word_count
from spanweave.session import materialize

_D, _S, _H, _N = "__sw_d", "__sw_s", "__sw_h", "__sw_n"
_ROW, _SHARD, _ORDER = "__sw_row", "__sw_shard", "__sw_order"


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds the row's key columns and its number of words."""
    return docs.withColumns({_D: F.col("doc_id").cast("long"), _S: F.col("source").cast("string"), _H: text_key(F.col("text")), _N: word_count(F.col("text"))})


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(s, size, target) of each source from (s, size)."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("nth") - 1, F.lit(len(weights))).cast("int") + 1)
    nth = F.row_number().over(Window.orderBy(F.col("s").asc_nulls_last()))
    ranked = sizes.withColumn("nth", nth).withColumn("w", w)
    by_ratio = Window.orderBy(F.col("size") / F.col("w"), "nth")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum(F.col("size") * cap).over(before), F.lit(0.0))
    rest = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (F.sum("size").over(everything) * share - full) / rest
    # the level holds from the first source on that it does not fill up
    open_ = ranked.withColumns({"level": level}).withColumn("open", F.col("level") * F.col("w") <= F.col("size") * cap)
    first = F.min(F.when(F.col("open"), F.struct(F.col("size") / F.col("w"), "nth", "level"))).over(everything)["level"]
    return open_.withColumn("at", first).select("s", "size", F.when(F.col("at").isNull(), F.col("size") * cap).otherwise(F.least(F.col("at") * F.col("w"), F.col("size") * cap)).cast("double").alias("target"))


def _split(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """Deals draw labels (s, j) to shards by recursive halving; adds ``shard``."""
    tree = draws.withColumns({"lo": F.lit(0), "hi": F.lit(shards)})
    level = 0
    while (1 << level) < shards:
        node = Window.partitionBy("lo", "hi")
        rank = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed), F.lit(level), "s", "j"), "s", "j"))
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        share = F.floor(F.count("*").over(node) * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        split = F.col("hi") - F.col("lo") > 1
        tree = tree.withColumns({"r": rank, "m": mid, "q": share}).select(
            "s", "j",
            F.when(split & (F.col("r") > F.col("q")), F.col("m")).otherwise(F.col("lo")).alias("lo"),
            F.when(split & (F.col("r") <= F.col("q")), F.col("m")).otherwise(F.col("hi")).alias("hi"),
        )
        level += 1
    return tree.select("s", "j", F.col("lo").alias("shard"))


def plan_mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 4096, max_blocks: int = 16_384, shards: int = 16, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, blocks, cuts, draws).

    rows: the documents' keys, words, source sizes, targets and blocks, without texts.
    blocks: s, block, size, target, rounds, extra (1: once more, whole), rest (words still to take one
    by one, null: none). cuts: the last block's documents with the words taken of each. draws: s,
    block, round, shard.
    """
    rows = materialize(_keyed(docs).select(_D, _S, _H, _N), "sizes")
    sizes = rows.groupBy(F.col(_S).alias("s")).agg(F.sum(_N).alias("size"))
    aimed = materialize(targets(sizes, weights, share, cap), "targets", 1)
    total = aimed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    words = max(block_words, -(-total // max_blocks))
    most = 3 * max_blocks  # rows of the tables of blocks and draws, but for one or two a source
    aimed = aimed.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("size") / words)).cast("long"))
    dealt = deal(rows, aimed, seed)
    filled = materialize(dealt.groupBy("s", "block").agg(F.sum(_N).alias("words"), F.first("size").alias("size"), F.first("target").alias("target")), "blocks", most)
    order = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed + 1), "s", "block"), "block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rounds = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("int")
    left = F.round(F.col("target")).cast("long") - F.col("rounds") * F.col("size") - F.col("before")
    ranked = filled.withColumns({"nth": F.row_number().over(order), "before": before, "rounds": rounds}).withColumn("left", left)
    blocks = materialize(
        ranked.select(
            "s", "block", "size", "target", "rounds", "nth",
            ((F.col("left") >= F.col("words")) & (F.col("left") > 0)).cast("int").alias("extra"),
            F.when((F.col("left") > 0) & (F.col("left") < F.col("words")), F.col("left")).alias("rest"),
        ),
        "block-plan",
        most,
    )
    last = _same(dealt.select(_D, _S, _H, _N, "s", "block"), blocks.where("rest IS NOT NULL").select("s", "block", "rest"), ["s", "block"])
    each = last.groupBy(_D, _S, _H, "s", "block", "rest").agg(F.count("*").alias("copies"), F.sum(_N).alias("n"))
    inside = Window.partitionBy("s", "block").orderBy(F.xxhash64(F.lit(seed + 2), _D, _H), _D, _H)
    so_far = F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = F.greatest(F.lit(0), F.least(F.col("n"), F.col("rest") - F.col("so_far")))
    cuts = each.withColumn("so_far", so_far).select(_D, _S, _H, F.floor(got / F.col("copies")).cast("long").alias("cut")).where("cut > 0")
    again = F.explode(F.sequence(F.lit(1), F.col("rounds") + F.col("extra") + F.when(F.col("rest").isNotNull(), 1).otherwise(0)))
    drawn = blocks.where(F.col("rounds") + F.col("extra") + F.when(F.col("rest").isNotNull(), 1).otherwise(0) > 0).select("s", "block", "nth", again.alias("round"))
    by_turn = Window.partitionBy("s").orderBy("round", "nth")
    numbered = materialize(drawn.withColumn("j", F.row_number().over(by_turn)), "draws", most)
    quotas = _split(numbered.select("s", "j"), shards, seed + 3)
    in_turn = quotas.select("s", "shard", F.row_number().over(Window.partitionBy("s").orderBy("shard", "j")).alias("j"))
    draws = _same(numbered, in_turn, ["s", "j"]).select("s", "block", "round", "shard")
    return dealt, blocks, cuts, draws


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's keys go."""
    other = right.select(*[F.col(c).alias(f"__sw_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"__sw_r_{c}")) for c in keys]
    return left.join(other, on, how).drop(*[f"__sw_r_{c}" for c in keys])


def deal(keyed: DataFrame, aimed: DataFrame, seed: int) -> DataFrame:
    """Adds to each document its source's s, size, target, and its block."""
    joined = _same(keyed.withColumn("s", F.col(_S)), aimed, ["s"], "left")
    return joined.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), _D, _H), F.col("blocks")))


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """A row a document: doc_id, size, source_size, target, taken, shards (of its draws, as text)."""
    found, blocks, cuts, draws = plan_mix(docs, **options)
    homes = draws.groupBy("s", "block").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("shard")), lambda x: x.cast("string"))).alias("shards"))
    planned = _same(blocks.select("s", "block", "rounds", "extra"), homes, ["s", "block"], "left")
    rows = _same(_same(found, planned, ["s", "block"], "left"), cuts, [_D, _S, _H], "left")
    taken = F.col(_N) * (F.col("rounds") + F.col("extra")) + F.coalesce("cut", F.lit(0))
    return rows.select(F.col(_D).alias("doc_id"), F.col(_N).alias("size"), F.col("size").alias("source_size"), "target", taken.cast("long").alias("taken"), F.coalesce("shards", F.lit("")).alias("shards"))


def _first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, its white space kept."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, seed: int = 17, shards: int = 64, **options) -> DataFrame:
    """The mixed documents themselves: a row each time one is taken, columns as in ``docs``.

    Rows come shard by shard, as the splitting tree deals the blocks, and within a shard in the order of a
    hash: each shard's rows are one partition's, to be written so. The last document of a source is cut to
    its first words. A document travels as one column, so that no column's name matters.
    """
    found, blocks, cuts, draws = plan_mix(docs, seed=seed, shards=shards, **options)
    whole = _same(blocks.select("s", "block", "rounds", "extra"), draws, ["s", "block"])
    aimed = found.select("s", "blocks").distinct()
    rows = _keyed(docs).select(_D, _S, _H, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_ROW))
    cut = _same(_same(deal(rows, aimed, seed), whole, ["s", "block"]), cuts, [_D, _S, _H], "left")
    last = F.col("round") > F.col("rounds") + F.col("extra")
    of = lambda c: F.col(_ROW)[c]
    text = F.when(last, _first_words(of("text"), F.col("cut"))).otherwise(of("text"))
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(last, F.length(text)).otherwise(of("n_chars")).cast(docs.schema["n_chars"].dataType)
    kept = cut.where(~last | F.col("cut").isNotNull())
    order = F.xxhash64(F.lit(seed + 4), _D, _H, "round")
    row = F.struct(*[made.get(c, of(c)).alias(c) for c in docs.columns]).alias(_ROW)
    dealt = kept.select(row, F.col("shard").alias(_SHARD), order.alias(_ORDER)).repartitionById(shards, F.col(_SHARD).cast("int")).sortWithinPartitions(_ORDER)
    return dealt.select(*[of(c).alias(c) for c in docs.columns])
