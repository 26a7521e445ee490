"""Projection of an append-only assertion log: what holds now, per target."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def live(log: DataFrame) -> DataFrame:
    """Assertions whose id no assertion supersedes, whatever their times."""
    gone = log.select(F.col("supersedes").alias("id")).where("id IS NOT NULL").distinct()
    return log.join(gone, "id", "left_anti")


def current(log: DataFrame) -> DataFrame:
    """The live assertion of each target with the greatest ``at`` (ties: later in the log), and ``position``.

    log: seq, id, at, target_id, supersedes and any more columns. ``position`` orders targets by their
    first live assertion. One aggregation with map-side combining; no window over a target's history.
    """
    alive = live(log)
    rest = [c for c in alive.columns if c not in ("target_id", "at", "seq")]
    best = alive.groupBy("target_id").agg(F.max_by(F.struct("at", "seq", *rest), F.struct("at", "seq")).alias("b"), F.min("seq").alias("position"))
    return best.select("target_id", "position", "b.at", "b.seq", *[f"b.{c}" for c in rest])


def latest(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last written row of each key, and where the key was first written (``position``)."""
    rest = [c for c in rows.columns if c != key]
    got = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("b"), F.min(order).alias("position"))
    return got.select(key, *[f"b.{c}" for c in rest], "position")


def history(log: DataFrame, target: str | None = None) -> DataFrame:
    """Raw assertions in write order."""
    return (log if target is None else log.where(F.col("target_id") == target)).orderBy("seq")


def lookup(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of the ids asked for, in that order; unknown ids give none."""
    spark = rows.sparkSession
    asked = spark.createDataFrame(list(enumerate(ids)), "nth int, id string")
    return rows.join(F.broadcast(asked), "id").orderBy("nth").drop("nth")  # the caller's own list


def missing_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows whose source_id is unknown: they are not to be written."""
    return rows.join(sources.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_anti")


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("__sw_n", F.row_number().over(w)).where("__sw_n = 1").drop("__sw_n")


def select(spark, sql: str) -> DataFrame:
    """One reading statement over registered views; anything else is refused."""
    text = sql.strip().rstrip(";").strip()
    if not text or text.split(None, 1)[0].upper() not in ("SELECT", "WITH"):
        raise ValueError("a single SELECT or WITH statement is expected")
    try:  # only a query can stand in brackets
        return spark.sql(f"SELECT * FROM ({text}\n)")
    except ParseException as e:
        raise ValueError("a single SELECT or WITH statement is expected") from e
