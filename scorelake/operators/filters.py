"""Row filters, the row cap and partition sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The device modes known to the reports, the bytes one partition
# should hold and the largest payload a partition may carry.
DEVICE_MODES = ["gpu_only", "cpu_only", "hybrid"]
RESULT_MODES = ["single_gpu", "hybrid_cpu_gpu", "distributed_gpu"]
TARGET_PARTITION_BYTES = 300 * 1024 * 1024
MAX_PARTITION_BYTES = 450 * 1_000_000


def ok_runs(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNull())


def with_details(runs: DataFrame, details: str = "partition_details") -> DataFrame:
    """Runs whose task list is present and not empty."""
    return runs.where(F.size(F.coalesce(F.col(details), F.array())) > 0)


def runs_with_tasks(runs: DataFrame, tasks: DataFrame, key: str = "run_id") -> DataFrame:
    """The same for tasks kept in their own table."""
    return runs.join(tasks.select(key), key, "left_semi")


def alive_workers(df: DataFrame) -> DataFrame:
    return df.where(F.col("state") == "ALIVE")


def no_driver(df: DataFrame, col: str = "id") -> DataFrame:
    return df.where(F.col(col) != "driver")


def by_category(registry: DataFrame, category: str) -> DataFrame:
    return registry.where(F.col("category") == category)


def known_modes(df: DataFrame, modes: list[str] | None = None, col: str = "device_mode") -> DataFrame:
    return df.where(F.col(col).isin(list(modes or DEVICE_MODES)))


def cap_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``min(n, rows)`` rows in a total order; for costly baselines."""
    return df.orderBy(*order).limit(n)


def partitions_for(total_bytes: Column, executors: int, target: int = TARGET_PARTITION_BYTES) -> Column:
    return F.greatest(F.lit(executors), F.ceil(total_bytes / F.lit(float(target)))).cast("int")


def plan_partitions(payloads: DataFrame, executors: int, target: int = TARGET_PARTITION_BYTES) -> DataFrame:
    """Partition count and bytes per partition for rows of ``payload_bytes``."""
    planned = payloads.withColumn("partitions", partitions_for(F.col("payload_bytes"), executors, target))
    each = F.col("payload_bytes") / F.col("partitions")
    return planned.withColumns({"bytes_per_partition": each, "fits": each < F.lit(float(MAX_PARTITION_BYTES))})
