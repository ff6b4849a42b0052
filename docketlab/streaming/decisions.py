"""Streaming extensions: the append-only logs as streams. The batch operators define the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketlab.operators.checks import latest

KEYS = ["user_id", "event_type"]


def _newest() -> list[Column]:
    return [F.col("ts").desc(), F.col("event_id").desc()]


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Status events with repeats within the lateness bound removed; state is dropped behind the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def latest_decisions(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is reduced to its latest decision per key and merged into the table at `target`, which
    is rewritten under a new version folder, so a replayed batch gives the same table."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
        if epoch > 0:
            new = new.unionByName(spark.read.parquet(f"{target}/v{epoch - 1}"))
        latest(new, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).write.mode("overwrite").parquet(f"{target}/v{epoch}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decision_deltas(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's latest decision per key, written under its own epoch: a replayed batch overwrites its own folder,
    no batch reads or rewrites what others wrote, and a gap in the epochs changes nothing. current() reads the state."""

    def write(batch: DataFrame, epoch: int) -> None:
        latest(batch, KEYS, _newest()).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The latest decision per key over all deltas: one aggregation by key, whatever order the epochs came in."""
    return latest(spark.read.parquet(target).drop("epoch"), KEYS, _newest())
