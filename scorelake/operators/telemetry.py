"""Metric rows, rollups, dashboard statistics and threshold alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import mb, merge_dims, safe_ratio
from ..schemas import METRICS
from .segments import with_row_index

# Metric name, source expression and unit per kind of record.
# Optional metrics (last element True) are left out where the value is null.
CLUSTER_METRICS = [
    ("TotalWorkers", "total_workers", "Count", False),
    ("ActiveWorkers", "active_workers", "Count", False),
    ("TotalCores", "total_cores", "Count", False),
    ("CoresUsed", "cores_used", "Count", False),
    ("TotalMemoryMb", "total_memory", "Megabytes", False),
    ("MemoryUsedMb", "memory_used", "Megabytes", False),
    ("ActiveApps", "active_apps", "Count", False),
    ("CompletedApps", "completed_apps", "Count", False),
]
EXECUTOR_METRICS = [
    ("ExecutorActiveTasks", "activeTasks", "Count", False),
    ("ExecutorCompletedTasks", "completedTasks", "Count", False),
    ("ExecutorFailedTasks", "failedTasks", "Count", False),
    ("ExecutorTotalDurationMs", "totalDuration", "Milliseconds", False),
    ("ExecutorMemoryUsedMb", "memoryUsed / 1e6D", "Megabytes", False),
    ("ExecutorDiskUsedMb", "diskUsed / 1e6D", "Megabytes", False),
    ("ExecutorMaxMemoryMb", "maxMemory / 1e6D", "Megabytes", False),
    ("ExecutorTotalCores", "totalCores", "Count", False),
]
DEVICE_METRICS = [
    ("GpuUtilizationPercent", "util_gpu", "Percent", False),
    ("GpuMemoryUtilizationPercent", "util_memory", "Percent", False),
    ("GpuMemoryUsedMb", "memory_used", "Megabytes", False),
    ("GpuMemoryTotalMb", "memory_total", "Megabytes", False),
    ("GpuTemperatureC", "temperature", "None", False),
    ("GpuPowerDrawWatts", "power_draw", "None", True),
]
RUN_METRICS = [
    ("ThroughputSamplesPerSec", "total_throughput", "Count/Second", False),
    ("ElapsedTimeSec", "elapsed_time", "Seconds", False),
    ("TotalSamplesProcessed", "total_samples_processed", "Count", False),
    ("NumModelsOnGpu", "num_on_gpu", "Count", True),
    ("NumModelsOnCpu", "num_on_cpu", "Count", True),
]

RECORD_METRICS = [("TotalBenchmarkTimeSec", "t", "Seconds", False)]

# Metric, comparison and limit that raise an alert.
ALERT_THRESHOLDS = [
    ("gpu_utilization", "<", 50.0),
    ("gpu_memory_pct", ">", 90.0),
    ("gpu_temperature", ">", 85.0),
    ("task_failures", ">", 0.0),
]

METRIC_BATCH = 1000


def to_metrics(df: DataFrame, spec: list[tuple[str, str, str, bool]], keep: list[str]) -> DataFrame:
    """Unfold each wide record to metric rows; a required value missing counts as 0."""
    entries = []
    for name, source, unit, optional in spec:
        value = F.expr(source).cast("double")
        value = value if optional else F.coalesce(value, F.lit(0.0))
        entries.append(F.struct(F.lit(name).alias("metric_name"), value.alias("value"), F.lit(unit).alias("unit")))
    rows = df.select(*keep, F.inline(F.array(*entries)))
    optional_names = [n for n, _, _, opt in spec if opt]
    return rows.where(F.col("value").isNotNull()) if optional_names else rows


def datapoints(rows: DataFrame, namespace: str, *dims: Column, ts: Column | None = None) -> DataFrame:
    """Metric rows as complete datapoints (``schemas.METRICS``).

    ``dims`` are maps of dimensions, merged so that a later one wins: those of
    the node, of the fleet, then of the metric itself. A missing unit is "None";
    without ``ts`` a datapoint is stamped when it is made.
    """
    unit = F.coalesce("unit", F.lit("None"))
    stamp = ts if ts is not None else F.current_timestamp()
    out = rows.select(
        F.lit(namespace).alias("namespace"), "metric_name", F.col("value").cast("double").alias("value"), unit.alias("unit"),
        merge_dims(*dims).alias("dims"), stamp.cast("timestamp").alias("ts"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(METRICS)])


def result_metrics(results: DataFrame) -> DataFrame:
    """Metric rows of per-mode results (one row per record and mode), ``mode`` null for those of the whole record.

    Modes that failed give none. The total time of a record counts once.
    """
    done = results.where(F.col("error").isNull()) if "error" in results.columns else results
    modes = to_metrics(done, RUN_METRICS, ["_source_file", F.col("result_mode").alias("mode")])
    whole = results.where(F.col("total_benchmark_time").isNotNull()).groupBy("_source_file").agg(F.max("total_benchmark_time").alias("t"))
    totals = to_metrics(whole, RECORD_METRICS, ["_source_file", F.lit(None).cast("string").alias("mode")])
    return modes.unionByName(totals)


def with_metric_batches(df: DataFrame, order: list[Column], size: int = METRIC_BATCH) -> DataFrame:
    """Number metric rows into batches of at most ``size`` for publishing."""
    indexed = with_row_index(df, order)
    return indexed.withColumn("batch_no", F.floor(F.col("row_idx") / F.lit(size)).cast("long"))


def publish_metrics(df: DataFrame, put, size: int = METRIC_BATCH) -> None:
    """Hand each partition's rows to ``put(list)`` in batches of at most ``size``.

    A retried task sends its rows again, so ``put`` should be idempotent.
    """

    def send(rows):
        batch = []
        for row in rows:
            batch.append(row.asDict(recursive=True))
            if len(batch) == size:
                put(batch)
                batch = []
        if batch:
            put(batch)

    df.foreachPartition(send)


def cluster_rollup(workers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total and alive workers, cores and memory."""
    return workers.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_workers"),
        F.count_if(F.col("state") == "ALIVE").alias("active_workers"),
        F.coalesce(F.sum("cores"), F.lit(0)).alias("total_cores"),
        F.coalesce(F.sum("coresused"), F.lit(0)).alias("cores_used"),
        F.coalesce(F.sum("memory"), F.lit(0)).alias("total_memory"),
        F.coalesce(F.sum("memoryused"), F.lit(0)).alias("memory_used"),
    )


def status_rollup(stages: DataFrame, by: list[str]) -> DataFrame:
    """Stages, tasks done or running, failures, run time, GC and spill."""
    spilled = F.coalesce("memoryBytesSpilled", F.lit(0)) + F.coalesce("diskBytesSpilled", F.lit(0))
    done = F.coalesce("numCompleteTasks", F.lit(0)) + F.coalesce("numActiveTasks", F.lit(0))
    out = stages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("stages"),
        F.sum(done).alias("tasks"),
        F.sum(F.coalesce("numFailedTasks", F.lit(0))).alias("failed_tasks"),
        (F.sum("executorRunTime") / 1000.0).alias("run_time_s"),
        F.sum("jvmGcTime").alias("gc_ms"),
        F.sum(spilled).alias("spilled_bytes"),
    )
    return out.withColumn("gc_share", safe_ratio("gc_ms", F.col("run_time_s") * 1000))


def executor_figures(executors: DataFrame) -> DataFrame:
    """Executor table of a status capture: host, seconds and decimal MB."""
    from ..functions.columns import host_of, ms_to_s
    from .filters import no_driver

    return no_driver(executors).withColumns(
        {"host": host_of("hostPort"), "duration_s": ms_to_s("totalDuration"), "memory_used_mb": mb("memoryUsed")}
    )


def dashboard(df: DataFrame, period: str, by: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Average, maximum and sum of each metric per tumbling period."""
    grouped = df.groupBy(F.window(ts, period).alias("w"), *by)
    out = grouped.agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"), F.max(value).alias("max_value"), F.sum(value).alias("sum_value")
    )
    return out.select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), *[c for c in out.columns if c != "w"])


def threshold_frame(spark, thresholds=ALERT_THRESHOLDS) -> DataFrame:
    return spark.createDataFrame(list(thresholds), "metric string, op string, threshold double")


def alerts(df: DataFrame, thresholds: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Rows beyond a limit of their metric. The equality on the metric carries
    the join and the comparison filters it, so Spark broadcasts the limits when
    they are small and still has a key to join on when they are not. The left
    side may be a stream."""
    limits = thresholds.withColumnRenamed("metric", "_metric")
    beyond = ((F.col("op") == ">") & (F.col(value) > F.col("threshold"))) | (
        (F.col("op") == "<") & (F.col(value) < F.col("threshold"))
    )
    return df.join(limits, (df[metric] == F.col("_metric")) & beyond, "inner").drop("_metric")
