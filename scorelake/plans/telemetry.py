"""Queries over telemetry: rollups, dashboards, alerts; and the streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry as T
from ..session import scratch_path
from ..sinks import publish as PB
from ..streaming import jobs as ST
from .catalog import Catalog, rnd, rnd_sql
from .tables import EXECUTORS, RUNS, TASKS, TELEMETRY, executors, runs, stream_path, tasks, telemetry

catalog = Catalog()
query = catalog.query
HEAD = f"WITH {RUNS}, {TASKS}, {EXECUTORS}, {TELEMETRY}"

LIMITS = [("click", ">", 90.0), ("error", ">", 10.0), ("view", "<", 0.5), ("purchase", ">", 50.0)]
LIMITS_SQL = "limits(metric, op, threshold) AS (VALUES " + ", ".join(f"('{m}', '{o}', {v}::DOUBLE)" for m, o, v in LIMITS) + ")"
BEYOND = "(op = '>' AND value > threshold OR op = '<' AND value < threshold)"


def _workers(spark, sf_dir):
    e = executors(spark, sf_dir)
    alive = F.when(F.col("capacity") > 0, "ALIVE").otherwise("DEAD")
    return e.select("site", alive.alias("state"), (F.col("executor_id") % 8).alias("cores"), (F.col("executor_id") % 5).alias("coresused"),
                    (F.col("executor_id") * 10).alias("memory"), F.col("executor_id").alias("memoryused"))


@query("a24_cluster_rollup", f"{HEAD} SELECT site, count(*) AS total_workers, count(*) FILTER (WHERE capacity > 0) AS active_workers, sum(executor_id % 8)::BIGINT AS total_cores, "
       "sum(executor_id % 5)::BIGINT AS cores_used, sum(executor_id * 10)::BIGINT AS total_memory, sum(executor_id)::BIGINT AS memory_used FROM executors GROUP BY site")
def a24(spark, sf_dir):
    return T.cluster_rollup(_workers(spark, sf_dir), ["site"])


@query("p24_cluster_metrics", f"{HEAD}, c AS (SELECT site, count(*) AS tw, count(*) FILTER (WHERE capacity > 0) AS aw, sum(executor_id % 8) AS tc, sum(executor_id % 5) AS cu, sum(executor_id * 10) AS tm, sum(executor_id) AS mu FROM executors GROUP BY site) "
       "SELECT site, unnest(['TotalWorkers', 'ActiveWorkers', 'TotalCores', 'CoresUsed', 'TotalMemoryMb', 'MemoryUsedMb', 'ActiveApps', 'CompletedApps']) AS metric_name, "
       "unnest([tw::DOUBLE, aw, tc, cu, tm, mu, 0, tw * 2]) AS value, unnest(['Count', 'Count', 'Count', 'Count', 'Megabytes', 'Megabytes', 'Count', 'Count']) AS unit FROM c")
def p24_cluster(spark, sf_dir):
    c = T.cluster_rollup(_workers(spark, sf_dir), ["site"])
    c = c.withColumns({"active_apps": F.lit(None).cast("long"), "completed_apps": F.col("total_workers") * 2})
    return T.to_metrics(c, T.CLUSTER_METRICS, ["site"])


@query("a25_status_rollup", f"{HEAD} SELECT run_id, count(*) AS stages, sum(samples + partition_idx)::BIGINT AS tasks, count(*) FILTER (WHERE device = 'R') AS failed_tasks, "
       f"{rnd_sql('sum(round(inference_time)) / 1000.0', 3)} AS run_time_s, sum(samples)::BIGINT AS gc_ms, sum(partition_idx * 3)::BIGINT AS spilled_bytes, {rnd_sql('sum(samples) / sum(round(inference_time))', 8)} AS gc_share FROM tasks GROUP BY run_id")
def a25(spark, sf_dir):
    stages = tasks(spark, sf_dir).select(
        "run_id", F.col("samples").alias("numCompleteTasks"), F.col("partition_idx").alias("numActiveTasks"),
        F.when(F.col("device") == "R", 1).alias("numFailedTasks"), F.round("inference_time").cast("long").alias("executorRunTime"),
        F.col("samples").alias("jvmGcTime"), F.col("partition_idx").alias("memoryBytesSpilled"), (F.col("partition_idx") * 2).alias("diskBytesSpilled"),
    )
    out = T.status_rollup(stages, ["run_id"])
    return out.withColumns({"run_time_s": rnd("run_time_s", 3), "gc_share": rnd("gc_share", 8)})


DASH = (
    "SELECT time_bucket(INTERVAL '{p}', ts) AS period_start, time_bucket(INTERVAL '{p}', ts) + INTERVAL '{p}' AS period_end, metric, count(*) AS n, "
    + rnd_sql("avg(value)", 6) + " AS avg_value, max(value) AS max_value, " + rnd_sql("sum(value)") + " AS sum_value FROM telemetry GROUP BY ALL"
)


def _dash(df):
    return df.select(
        F.col("period_start").cast("timestamp_ntz").alias("period_start"), F.col("period_end").cast("timestamp_ntz").alias("period_end"),
        "metric", "n", rnd("avg_value", 6).alias("avg_value"), "max_value", rnd("sum_value").alias("sum_value"),
    )


@query("a30_dashboard_5min", f"{HEAD} " + DASH.format(p="5 minutes"))
def a30(spark, sf_dir):
    return _dash(T.dashboard(telemetry(spark, sf_dir), "5 minutes", ["metric"]))


@query("a30_dashboard_1min", f"{HEAD} " + DASH.format(p="1 minute"))
def a30_minute(spark, sf_dir):
    return _dash(T.dashboard(telemetry(spark, sf_dir), "1 minute", ["metric"]))


@query("j6_alerts", f"{HEAD}, {LIMITS_SQL} SELECT event_id, metric, value, op, threshold FROM telemetry JOIN limits USING (metric) WHERE {BEYOND}")
def j6(spark, sf_dir):
    out = T.alerts(telemetry(spark, sf_dir), T.threshold_frame(spark, LIMITS))
    return out.select("event_id", "metric", "value", "op", "threshold")


# -- streams over the events files, run until everything available is processed


def event_stream(spark, sf_dir):
    """The table as one micro-batch, however many files it has: their order must not make rows late."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    src = spark.readStream.schema(schema).parquet(stream_path(sf_dir, "events"))
    return src.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("executor_id"), F.col("event_type").alias("metric"), "value", "props"
    )


def drained(spark, df):
    out = scratch_path(spark, "out")
    ST.run_available(df, out, scratch_path(spark, "checkpoint"))
    return spark.read.schema(df.schema).parquet(out)


# A window is closed once the watermark, ten minutes behind, has reached its end.
@query("t3_dashboard_stream", f"{HEAD}, d AS ({DASH.format(p='5 minutes')}) SELECT * FROM d WHERE period_end <= (SELECT max(ts) - INTERVAL '10 minutes' FROM telemetry)")
def t3(spark, sf_dir):
    return _dash(drained(spark, ST.dashboard_stream(event_stream(spark, sf_dir), "5 minutes", ["metric"])))


@query("t4_alert_stream", f"{HEAD}, {LIMITS_SQL} SELECT event_id, metric, value, op, threshold FROM telemetry JOIN limits USING (metric) WHERE {BEYOND}")
def t4(spark, sf_dir):
    out = ST.alert_stream(event_stream(spark, sf_dir), T.threshold_frame(spark, LIMITS))
    return drained(spark, out).select("event_id", "metric", "value", "op", "threshold")


SPELLS = """b AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '60 seconds' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM telemetry WINDOW w AS (PARTITION BY executor_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY executor_id ORDER BY ts, event_id) AS spell FROM b),
s AS (SELECT executor_id, min(ts) AS spell_start, max(ts) + INTERVAL '60 seconds' AS spell_end, count(*) AS beats, max(ts) AS last_seen FROM g GROUP BY executor_id, spell)"""


@query("t5_heartbeat_stream", f"{HEAD}, {SPELLS} SELECT * FROM s WHERE spell_end <= (SELECT max(ts) - INTERVAL '10 minutes' FROM telemetry)")
def t5(spark, sf_dir):
    out = drained(spark, ST.heartbeat_stream(event_stream(spark, sf_dir)))
    return out.select("executor_id", "beats", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("spell_start", "spell_end", "last_seen")])


# -- events that arrive as files, a tenth of them one file late; the stream is stopped after three files and started again

FILES, HALT, LATE = 6, 3, "event_id % 10 = 3"
ARRIVAL = f"{HEAD}, arrived AS (SELECT *, CAST(event_id * {FILES} // (SELECT max(event_id) + 1 FROM events) AS INTEGER) + CASE WHEN {LATE} THEN 1 ELSE 0 END AS batch FROM telemetry)"


def _marks(after: str) -> str:
    """The watermark that a batch's rows are held against: a day behind all rows of the batches up to ``after``."""
    return f"marks AS (SELECT b.batch, date_trunc('milliseconds', max(a.ts)) - INTERVAL '1 day' AS mark FROM (SELECT DISTINCT batch FROM arrived) b LEFT JOIN arrived a ON a.batch <= {after} GROUP BY b.batch)"


def in_files(spark, sf_dir, make, sink=None):
    """The table that ``make`` streams from the events' files: one micro-batch for each file, and a restart in between.

    With ``sink``, called with the stream and its checkpoint, nothing is returned.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    most = events.agg(F.max("event_id") + 1).scalar()
    batch = F.floor(F.col("event_id") * FILES / most).cast("int") + F.expr(LATE).cast("int")
    events, src, out, checkpoint = events.withColumn("batch", batch), *(scratch_path(spark, n) for n in ("files", "out", "checkpoint"))
    for at in range(FILES + 1):
        # One file each, written one after the other: the source takes them in the order of their times.
        # Rows are picked by many tasks, and short row groups let many tasks read a file.
        events.where(F.col("batch") == at).drop("batch").repartition(1).write.option("parquet.block.size", 2 << 20).parquet(f"{src}/batch={at}")
        if at + 1 in (HALT, FILES + 1):
            stream = spark.readStream.schema(events.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/batch=*")
            df = make(stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("executor_id"), F.col("event_type").alias("metric"), "value", "props"))
            if sink:
                sink(df, checkpoint)
            else:
                ST.run_available(df, out, checkpoint)
    return None if sink else spark.read.schema(df.schema).parquet(out)


# A batch's late rows are those whose window was closed before it began: by the batches up to the one before the last, or to the last one before the restart.
@query("t3_late_dashboard_stream", f"{ARRIVAL}, {_marks(f'CASE WHEN b.batch = {HALT} THEN {HALT - 1} ELSE b.batch - 2 END')}, "
       "kept AS (SELECT arrived.* FROM arrived JOIN marks USING (batch) WHERE mark IS NULL OR time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' > mark) "
       + "SELECT * FROM (" + DASH.format(p="6 hours").replace("FROM telemetry", "FROM kept") + ") WHERE period_end <= (SELECT max(ts) - INTERVAL '1 day' FROM telemetry)")
def t3_late(spark, sf_dir):
    return _dash(in_files(spark, sf_dir, lambda src: ST.dashboard_stream(src, "6 hours", ["metric"], lateness="1 day")))


@query("t5_missed_heartbeats", f"{ARRIVAL}, {_marks('b.batch - 1')}, kept AS (SELECT arrived.* FROM arrived JOIN marks USING (batch) WHERE mark IS NULL OR ts > mark), "
       + SPELLS.replace("telemetry", "kept").replace("60 seconds", "12 hours") + " SELECT executor_id, spell_start, last_seen, beats, spell_end AS silent_from FROM s WHERE spell_end <= (SELECT max(ts) - INTERVAL '1 day' FROM telemetry)")
def t5_missed(spark, sf_dir):
    """Executors without a report for twelve hours, whoever reports next."""
    out = in_files(spark, sf_dir, lambda src: ST.missed_heartbeats(src, 12 * 3600.0, lateness="1 day"))
    return out.select("executor_id", "beats", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("spell_start", "last_seen", "silent_from")])


READING = [("EventValue", "value", "None", False), ("EventProperty", "CAST(get_json_object(props, '$.k') AS DOUBLE)", "Count", True)]


@query("t7_metrics_stream", f"{HEAD} SELECT metric_name, metric, count(*) AS n, {rnd_sql('sum(value)')} AS total FROM ("
       "SELECT 'EventValue' AS metric_name, metric, value FROM telemetry UNION ALL SELECT 'EventProperty', metric, CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM telemetry) GROUP BY ALL")
def t7(spark, sf_dir):
    rows = drained(spark, ST.metrics_stream(event_stream(spark, sf_dir), READING, ["metric"]))
    return rows.groupBy("metric_name", "metric").agg(F.count("*").alias("n"), rnd(F.sum("value")).alias("total"))


@query("t7_publish_stream", f"{HEAD} SELECT metric_name, metric, count(*) AS n, {rnd_sql('sum(value)')} AS total FROM ("
       "SELECT 'EventValue' AS metric_name, metric, value FROM telemetry UNION ALL SELECT 'EventProperty', metric, CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM telemetry) GROUP BY ALL")
def t7_publish(spark, sf_dir):
    """Metric rows of seven micro-batches, staged by tasks, published once for each batch, and read back."""
    out = scratch_path(spark, "metrics")

    def publish(df, checkpoint):
        PB.publish_stream(df, out, checkpoint, size=500).trigger(availableNow=True).start().awaitTermination()

    in_files(spark, sf_dir, lambda src: ST.metrics_stream(src, READING, ["metric"]), publish)
    rows = PB.read_published(spark, out, "metric string, metric_name string, value double, unit string")
    return rows.groupBy("metric_name", "metric").agg(F.count("*").alias("n"), rnd(F.sum("value")).alias("total"))
