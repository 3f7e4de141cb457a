"""Sizing of a run from a measured sample: partitions from the memory of a task, time from the sample's seconds."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plan:
    rows: int
    seconds_a_row: float
    partitions: int
    rows_a_partition: int
    projected_seconds: float


def sizes(df: DataFrame, text: str, partition_bytes: int = 128 * 2**20, factor: int = 1) -> DataFrame:
    """n_rows, n_bytes, n_partitions, bytes_a_row of a table `factor` times as large, with partitions of a bounded size."""
    found = df.agg(F.count("*").alias("r"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b"))
    partitions = F.greatest(F.lit(1), F.ceil(F.col("b") * factor / partition_bytes)).cast("long")
    return found.select((F.col("r") * factor).alias("n_rows"), (F.col("b") * factor).alias("n_bytes"), partitions.alias("n_partitions"), F.round(F.col("b") / F.greatest(F.col("r"), F.lit(1)), 4).alias("bytes_a_row"))


def measured(df: DataFrame, work: Callable[[DataFrame], DataFrame], total_rows: int, cores: int, task_bytes: int, bytes_a_row: float) -> Plan:
    """Runs the work over df, a sample, and projects it to total_rows on so many cores."""
    rows = df.count()
    began = time.perf_counter()
    work(df).write.format("noop").mode("overwrite").save()
    each = (time.perf_counter() - began) * df.sparkSession.sparkContext.defaultParallelism / max(1, rows)
    in_task = max(1, int(task_bytes / max(bytes_a_row, 1e-9)))
    return Plan(rows, each, -(-total_rows // in_task), in_task, each * total_rows / cores)
