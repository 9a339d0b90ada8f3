"""Captured engine status, cluster state and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CLUSTER_STATE, EVENT_LOG, STATUS


def _status(spark: SparkSession, path: str, glob: str | None, lines: bool) -> DataFrame:
    reader = spark.read.schema(STATUS).option("multiLine", str(not lines).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path).withColumn("_source_file", F.col("_metadata.file_name"))


def read_status(spark: SparkSession, path: str, glob: str | None = None, lines: bool = False) -> dict[str, DataFrame]:
    """Application, jobs, stages, tasks of stages, executors, environment and storage tables.

    ``tasks`` has the columns that run health and task quantiles read.
    """
    raw = _status(spark, path, glob, lines)
    tables = {
        name: raw.select("_source_file", F.col("application.id").alias("app_id"), F.inline(name))
        for name in ("jobs", "stages", "executors")
    }
    tables["storage"] = raw.select("_source_file", F.col("application.id").alias("app_id"), F.inline("storage_rdd"))
    details = raw.select("_source_file", F.col("application.id").alias("app_id"), F.inline("stage_details"))
    each = details.select("_source_file", "app_id", F.col("stageId").alias("stage_id"), F.explode("tasks").alias("_key", "t"))
    m = "t.taskMetrics"
    zero = F.lit(0).cast("bigint")
    read = F.coalesce(F.col(f"{m}.shuffleReadMetrics.localBytesRead"), zero) + F.coalesce(F.col(f"{m}.shuffleReadMetrics.remoteBytesRead"), zero)
    tables["tasks"] = each.select(
        "_source_file", "app_id", "stage_id", F.col("t.taskId").alias("task_id"), F.col("t.executorId").alias("executor_id"), F.col("t.host").alias("host"),
        F.col("t.duration").alias("duration"), (F.col("t.status") == "FAILED").alias("failed"), F.col(f"{m}.executorRunTime").alias("run_ms"),
        F.coalesce(F.col(f"{m}.jvmGcTime"), zero).alias("gc_time"), F.coalesce(F.col(f"{m}.inputMetrics.bytesRead"), zero).alias("input_bytes"),
        (read + F.coalesce(F.col(f"{m}.shuffleWriteMetrics.bytesWritten"), zero)).alias("shuffle_bytes"), F.col(f"{m}.peakExecutionMemory").alias("peak_memory"),
    )
    tables["application"] = raw.select("_source_file", "application.*")
    props = raw.select("_source_file", F.explode("environment.sparkProperties").alias("p"))
    tables["environment"] = props.select("_source_file", F.col("p")[0].alias("key"), F.col("p")[1].alias("value"))
    return tables


def run_status(runs: DataFrame, part: str, keep: list[str]) -> DataFrame:
    """Jobs, stages or executors embedded in run records."""
    return runs.select(*keep, F.inline(f"spark_ui_stats.{part}"))


def read_cluster_state(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(CLUSTER_STATE).option("multiLine", str(not lines).lower()).json(path)


def cluster_figures(state: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums per state record, read inside its own arrays."""
    workers = F.coalesce("workers", F.array())
    add = lambda f: F.aggregate(workers, F.lit(0).cast("long"), lambda acc, w: acc + F.coalesce(w[f], F.lit(0)))
    return state.select(
        *keep,
        F.size(workers).alias("total_workers"),
        F.size(F.filter(workers, lambda w: w["state"] == "ALIVE")).alias("active_workers"),
        add("cores").alias("total_cores"),
        add("coresused").alias("cores_used"),
        add("memory").alias("total_memory"),
        add("memoryused").alias("memory_used"),
        F.size(F.coalesce("activeapps", F.array())).alias("active_apps"),
        F.size(F.coalesce("completedapps", F.array())).alias("completed_apps"),
    )


def read_event_log(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Task, stage and executor tables of finished applications' event logs."""
    log = spark.read.schema(EVENT_LOG).json(path)

    def bytes_of(field: str):
        return F.coalesce(F.col(f"`Task Metrics`.{field}"), F.lit(0).cast("bigint"))

    read = bytes_of("`Shuffle Read Metrics`.`Local Bytes Read`") + bytes_of("`Shuffle Read Metrics`.`Remote Bytes Read`")
    written = bytes_of("`Shuffle Write Metrics`.`Shuffle Bytes Written`")
    tasks = log.where(F.col("Event") == "SparkListenerTaskEnd").select(
        F.col("`Stage ID`").alias("stage_id"),
        F.col("`Task Info`.`Task ID`").alias("task_id"),
        F.col("`Task Info`.`Executor ID`").alias("executor_id"),
        F.col("`Task Info`.Host").alias("host"),
        (F.col("`Task Info`.`Finish Time`") - F.col("`Task Info`.`Launch Time`")).alias("duration_ms"),
        F.col("`Task Info`.Failed").alias("failed"),
        F.col("`Task End Reason`.Reason").alias("reason"),
        F.col("`Task Metrics`.`Executor Run Time`").alias("run_ms"),
        F.col("`Task Metrics`.`JVM GC Time`").alias("gc_ms"),
        F.col("`Task Metrics`.`Result Size`").alias("result_size"),
        bytes_of("`Input Metrics`.`Bytes Read`").alias("input_bytes"),
        read.alias("shuffle_read_bytes"),
        written.alias("shuffle_write_bytes"),
        F.col("`Task Metrics`.`Peak Execution Memory`").alias("peak_memory"),
        # As run health and task quantiles read them.
        (F.col("`Task Info`.`Finish Time`") - F.col("`Task Info`.`Launch Time`")).alias("duration"),
        F.coalesce(F.col("`Task Metrics`.`JVM GC Time`"), F.lit(0).cast("bigint")).alias("gc_time"),
        (read + written).alias("shuffle_bytes"),
    )
    stages = log.where(F.col("Event") == "SparkListenerStageCompleted").select(
        F.col("`Stage Info`.`Stage ID`").alias("stage_id"),
        F.col("`Stage Info`.`Stage Name`").alias("name"),
        F.col("`Stage Info`.`Number of Tasks`").alias("tasks"),
        F.timestamp_millis(F.col("`Stage Info`.`Submission Time`")).alias("submitted"),
        F.timestamp_millis(F.col("`Stage Info`.`Completion Time`")).alias("completed"),
        F.col("`Stage Info`.`Failure Reason`").alias("failure"),
    )
    executors = log.where(F.col("Event") == "SparkListenerExecutorAdded").select(
        F.col("`Executor ID`").alias("executor_id"),
        F.col("`Executor Info`.Host").alias("host"),
        F.col("`Executor Info`.`Total Cores`").alias("cores"),
        F.timestamp_millis(F.col("Timestamp")).alias("added"),
    )
    return {"tasks": tasks, "stages": stages, "executors": executors}
