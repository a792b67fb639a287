"""Readout streams: the append-and-resume log as a stream with exactly one row an id, and drift checks on its batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.policy import check_lock


def readouts(spark: SparkSession, path: str, schema: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """A stream over a folder of JSON lines, without repeated ids. With the name of a time column an id is remembered for as
    long as repeats may be ``late``; without one it is remembered for ever, which suits runs that end."""
    stream = spark.readStream.schema(schema).json(path)
    if time is None:
        return stream.dropDuplicates(["id"])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["id"])


def append(stream: DataFrame, path: str, checkpoint: str):
    """Start writing the stream; what is available is processed once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drift_alerts(stream: DataFrame, lock: DataFrame, lock_eps: DataFrame, alert: Callable[[DataFrame, int], None], checkpoint: str, k: int | None = None):
    """Check each micro-batch of decision rows against a lock and hand the failing rows to ``alert``."""

    def check(batch: DataFrame, number: int) -> None:
        alert(check_lock(batch, lock, lock_eps, k).where("not ok"), number)

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
