"""Incremental runs: the batch operators over micro-batches, each batch written once however often it is tried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.queue import split_errors


def run(stream: DataFrame, work: Callable[[DataFrame], DataFrame], error: Column, out: str, checkpoint: str) -> None:
    """Takes what is there (availableNow), splits off rows with an error, applies `work` to the rest.

    A batch overwrites its own folder, so a batch that is tried again after a failure leaves one copy.
    """

    def batch(df: DataFrame, number: int) -> None:
        good, bad = split_errors(df, error)
        work(good).write.mode("overwrite").parquet(f"{out}/good/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/bad/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counts_by_minute(events: DataFrame, when: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts in fixed windows of a minute, for streams and tables alike."""
    return events.groupBy(F.window(when, "60 seconds").alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), *by, "n")
