"""Session helpers: table loading, the shared scratch folder, written cut points."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "spanweave", master: str = "local[*]", **conf: str) -> SparkSession:
    """A local session with adaptive execution on; a cluster brings its own settings."""
    builder = SparkSession.builder.appName(app).master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where a local session names none (tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spanweave-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, label: str = "cut", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The files outlive lost executors, and later branches read them instead of computing again. ``rows``:
    about how many there are at most, where that is known; then there is a file for each 250,000, and
    eight at least, so that small tables do not fall into as many files as a shuffle has partitions.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "spanweave", f"{label}-{uuid.uuid4().hex}")
    few = df if rows is None else df.coalesce(max(8, -(-rows // 250_000)))
    few.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
