"""Work queues as tables: claims, retries, watchdog, stage gates and counters, each as a rewrite of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claim(tasks: DataFrame, n: int, most_attempts: int, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The oldest n pending tasks with attempts left, as they are once claimed."""
    open_ = tasks.where((F.col("status") == "PENDING") & (F.col("attempts") < most_attempts))
    return open_.orderBy(*order).limit(n).withColumn("status", F.lit("PROCESSING")).withColumn("attempts", F.col("attempts") + 1)


def retried(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("status", F.when(F.col("status") == "FAILED", "PENDING").otherwise(F.col("status")))


def stuck(tasks: DataFrame, now: Column, after: str, most_attempts: int) -> DataFrame:
    """Running tasks that began too long ago and may run again, as RETRYABLE."""
    late = F.col("started_at") < now - F.expr(f"interval {after}")
    return tasks.where((F.col("status") == "RUNNING") & late & (F.col("attempts") < most_attempts)).withColumn("status", F.lit("RETRYABLE"))


def stage_gate(tasks: DataFrame, terminal: tuple[str, ...] = ("DONE", "FAILED", "CANCELLED")) -> DataFrame:
    """For each job its counts, derived from the tasks, and its state: open until all tasks are terminal."""
    done = F.col("status").isin(*terminal)
    out = tasks.groupBy("job").agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "DONE").alias("done"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.every(done).alias("closed"))
    return out.withColumn("state", F.when(~F.col("closed"), "RUNNING").when(F.col("failed") > 0, "PARTIAL").otherwise("SUCCEEDED")).drop("closed")


def split_errors(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and dead letters with the error as JSON."""
    marked = rows.withColumn("_error", error)
    return marked.where("_error is null").drop("_error"), marked.where("_error is not null").withColumn("_error", F.to_json(F.struct(F.col("_error").alias("message"))))
