"""An assertion log as a stream: micro-batches appended, the projection made anew from what is stored.

This is an extension of ours: the log's meaning does not depend on arrival, so late assertions need
no watermark; each batch is appended under its batch id and the projection reads all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators.log import current


def follow_log(spark: SparkSession, incoming: str, schema, store: str, checkpoint: str):
    """Reads new JSON files of ``incoming`` once and stores them; a batch that is run again replaces itself."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    stream = spark.readStream.schema(schema).json(incoming)
    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def projected(spark: SparkSession, store: str) -> DataFrame:
    """What holds now by all stored batches; an assertion that arrived twice counts once."""
    return current(spark.read.parquet(store).drop("batch").dropDuplicates(["id"]))


def refresh(state: DataFrame, log: DataFrame, batch: DataFrame) -> DataFrame:
    """The projection after a batch, from the one before it: only targets that the batch touches are made anew.

    ``log`` holds all assertions, those of the batch too. Touched are the batch's targets and those of the
    assertions that it supersedes or that are superseded in it; the others' rows stay as they are.
    """
    gone = batch.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id"))
    touched = batch.select("target_id").union(log.join(gone, "id", "left_semi").select("target_id")).distinct()
    mine = log.join(touched, "target_id", "left_semi")
    # what supersedes an assertion of a touched target may stand at another target
    over = log.where("supersedes IS NOT NULL").join(mine.select(F.col("id").alias("supersedes")), "supersedes", "left_semi")
    made = current(mine.join(over.select(F.col("supersedes").alias("id")), "id", "left_anti"))
    return state.join(touched, "target_id", "left_anti").select(made.columns).unionByName(made)


def counts_per_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type per window, for streams or tables; later events than ``late`` are left out of streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
