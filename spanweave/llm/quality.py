"""Learned quality rules: an ordered list of threshold conjunctions over a text's statistics.

Sequential covering: rules for the rejected class are grown one after another, each by adding the
threshold condition of largest information gain until it covers no kept document, then pruned from
its end on rows set aside, where it also has to prove its precision. What a rule covers is taken away
before the next is grown. The list comes out as one Spark conditional expression, first match wins,
and documents that no rule covers stay.

The rules are fitted on the driver from at most ``sample_rows`` labelled rows (those with the
smallest hashes of doc_id), a bound that does not grow with the data; statistics and verdicts cover
every document and whole texts. Inputs of a rule are statistics of the text alone.

Null texts have no words and fail the base rules. Labels that are null or of documents that do not
exist are ignored, and of two labels of a document the lower counts; without labels all but base failures stay. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANKS, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_digits", "n_stops", "n_distinct")
_PREFIX = "__sw_"


def statistics(text: str | None, window: int = 8) -> tuple[int, ...]:
    """The numbers named in STATS of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            again += bool(line.strip(" \t\n\x0b\x0c\r"))
        else:
            seen.add(line)
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    return (
        len(words), len(text) - count(_BLANKS), count(_SYMBOLS), again, _repeated(hashes, window), len(lines),
        count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"!"), count(b"0123456789"), count(b".?"), len(set(words)),
    )


def _repeated(hashes: np.ndarray, window: int) -> int:
    """How many words lie in windows that occur twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    order = np.argsort(rolled, kind="stable")
    equal = rolled[order][1:] == rolled[order][:-1]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    edge = np.zeros(n + window, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def with_statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """``docs`` and its texts' statistics in columns ``__sw_<name>``; one pass, no shuffle."""
    at = docs.columns.index("text")

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = np.array([statistics(t.as_py(), window) for t in batch.column(at)], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[:, k]) for k in range(len(STATS)))], names=[*batch.schema.names, *(_PREFIX + s for s in STATS)])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(_PREFIX + s, T.LongType()) for s in STATS)])
    return docs.mapInArrow(read, schema)


def features() -> dict[str, Column]:
    """What rules may look at, as Spark columns over the statistics."""
    c = lambda s: F.col(_PREFIX + s).cast("double")
    per = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))
    return {
        "words": c("n_words"), "chars_per_word": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "upper_share": per("n_upper", "word_chars"),
        "bangs_per_word": per("n_bangs", "n_words"), "digit_share": per("n_digits", "word_chars"), "stops_per_word": per("n_stops", "n_words"), "distinct_share": per("n_distinct", "n_words"),
    }


def base_failed(min_words: int = 20, most_repeated: int = 30) -> Column:
    return (F.col(_PREFIX + "n_words") < min_words) | (100 * F.col(_PREFIX + "n_repeat_words") > most_repeated * F.col(_PREFIX + "n_words"))


@dataclass(frozen=True)
class Rule:
    """Conditions (feature, above, threshold), all of which hold where the rule covers."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, [x[f] > t if above else x[f] <= t for f, above, t in self.conditions])

    def column(self) -> Column:
        made = features()
        return reduce(lambda a, b: a & b, [made[f] > F.lit(t) if above else made[f] <= F.lit(t) for f, above, t in self.conditions])


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> list[tuple[str, bool, float]]:
    inside, rule = np.ones(len(bad), bool), []
    while len(rule) < most and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for f, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            at = np.searchsorted(v[order], cuts[f], "right")
            sums = np.concatenate([[0], np.cumsum(b[order])])
            for above in (False, True):
                p1 = (p - sums[at]) if above else sums[at]
                all1 = (len(v) - at) if above else at
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p1 > 0, p1 * (np.log2(p1 / all1) - np.log2(p / (p + n))), 0)
                k = int(np.argmax(g)) if len(g) else 0
                if len(g) and g[k] > gain:
                    best, gain = (f, above, float(cuts[f][k])), g[k]
        if best is None:
            break
        rule.append(best)
        inside &= Rule((best,)).covers(x)
    return rule


def fit_rules(x: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray, most_rules: int = 12, most_conditions: int = 4, min_precision: float = 0.9, min_rows: int = 3) -> list[Rule]:
    """Ordered rules for ``bad``; rows in ``held`` prune and test them."""
    cuts = {f: np.unique(np.quantile(v, np.linspace(0, 1, 129))) if len(v) else v for f, v in x.items()}
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and (left & bad & ~held).sum() >= min_rows:
        grow, prune = left & ~held, left & held
        of = lambda rows: {f: v[rows] for f, v in x.items()}  # noqa: E731, B023
        grown = _grow(of(grow), bad[grow], cuts, most_conditions)
        best, worth = None, -1.0
        for k in range(1, len(grown) + 1):  # shorter rules first: a longer one has to be better
            hit = Rule(tuple(grown[:k])).covers(of(prune))
            p, n = (hit & bad[prune]).sum(), (hit & ~bad[prune]).sum()
            w = (p - n) / (p + n) if p + n else -1.0
            if w > worth:
                best, worth = Rule(tuple(grown[:k])), w
        if best is None:
            break
        hit = best.covers(x) & left
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        if (worth + 1) / 2 < min_precision or p < min_rows or p / (p + n) < min_precision:
            break
        rules.append(best)
        left &= ~hit
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **options) -> list[Rule]:
    """Fits rules for documents labelled quality 0 that pass the base rules."""
    picked = labels.select(F.col("doc_id").cast("long").alias("__sw_id"), F.col("quality").cast("int").alias("__sw_q")).dropna().groupBy("__sw_id").agg(F.min("__sw_q").alias("__sw_q"))
    bounded = picked.orderBy(F.xxhash64("__sw_id"), "__sw_id").limit(sample_rows)
    few = docs.select(F.col("doc_id").cast("long").alias("__sw_id"), "text").join(F.broadcast(bounded), "__sw_id")  # at most sample_rows rows
    made = with_statistics(few).where(~base_failed())
    columns = features()
    rows = made.select("__sw_id", "__sw_q", *[c.alias(f) for f, c in columns.items()]).orderBy(F.xxhash64("__sw_id"), "__sw_id").limit(sample_rows).toPandas()
    x = {f: rows[f].to_numpy(float) for f in columns}
    return fit_rules(x, rows["__sw_q"].to_numpy() == 0, np.arange(len(rows)) % 3 == 0, **options)


def kept(rules: list[Rule]) -> Column:
    """False where base rules fail or a rule covers, in the list's order; else true."""
    verdict = F.when(base_failed(), F.lit(False))
    for rule in rules:
        verdict = verdict.when(rule.column(), F.lit(False))
    return verdict.otherwise(F.lit(True))


def filter_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that stay, with their own columns."""
    rules = learn_rules(docs, labels, **options)
    return with_statistics(docs).where(kept(rules)).select(*[F.col(f"`{c}`") for c in docs.columns])
