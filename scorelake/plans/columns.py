"""Queries over scalar rules and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import filters as FL
from ..operators.telemetry import RUN_METRICS, datapoints, to_metrics
from .catalog import Catalog, rnd, rnd_sql
from .tables import EXECUTORS, MODELS, RUNS, TASKS, TELEMETRY, executors, models, runs, table, tasks, telemetry

catalog = Catalog()
query = catalog.query


@query("p13_run_tag", f"WITH {TASKS} SELECT run_id, model_id, executor_id, 'sig' || samples || '_img' || partition_idx || '_det' || executor_id || '_p' || partition_idx AS tag, "
       "'nightly_' || device || '_sig' || samples || '_img' || partition_idx || '_det' || executor_id || '_p' || partition_idx AS named_tag, "
       "format('{:,}', model_id * 1000) AS thousands FROM tasks")
def p13(spark, sf_dir):
    t = tasks(spark, sf_dir)
    numbers = ("samples", "partition_idx", "executor_id", "partition_idx")
    return t.select(
        "run_id", "model_id", "executor_id",
        C.run_tag(*numbers, run_name=F.lit("")).alias("tag"),
        C.run_tag(*numbers, mode="device", run_name=F.lit("nightly")).alias("named_tag"),
        C.thousands(F.col("model_id") * 1000).alias("thousands"),
    )


@query("k2_run_file_name", f"WITH {RUNS} SELECT run_id, 'cluster_benchmark_' || device_mode || '_' || run_id || '_' || strftime(run_ts, '%Y%m%d_%H%M%S') || '.json' AS file_name FROM runs")
def k2(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", C.run_file_name("cluster_benchmark", "device_mode", "run_id", "run_ts").alias("file_name"))


_PORT = "CASE WHEN hostname = 'NATION_3' THEN NULL ELSE hostname || ':' || (7000 + executor_id) END"


@query("p14_host_of", f"WITH {EXECUTORS} SELECT executor_id, CASE WHEN hostname = 'NATION_3' THEN 'unknown' ELSE hostname END AS host FROM executors")
def p14(spark, sf_dir):
    port = F.when(F.col("hostname") != "NATION_3", F.concat_ws(":", "hostname", (F.col("executor_id") + 7000).cast("string")))
    return executors(spark, sf_dir).select("executor_id", C.host_of(port).alias("host"))


@query("p15_short_label", f"WITH {EXECUTORS}, {TASKS} SELECT substr(executor_name, 1, 15) || ' (' || device || ')' AS label, count(*) AS tasks "
       "FROM tasks JOIN executors USING (executor_id) GROUP BY ALL")
def p15(spark, sf_dir):
    t = tasks(spark, sf_dir).join(executors(spark, sf_dir), "executor_id")
    return t.groupBy(C.short_label("executor_name", "device", 15).alias("label")).agg(F.count(F.lit(1)).alias("tasks"))


@query("p16_durations", f"WITH {RUNS}, {TASKS} SELECT run_id, model_id, executor_id, partition_idx, samples, epoch(ts) - epoch(run_ts) AS gmt_s, epoch(ts) - epoch(run_ts) AS iso_s FROM tasks JOIN runs USING (run_id)")
def p16(spark, sf_dir):
    t = tasks(spark, sf_dir).join(runs(spark, sf_dir), "run_id")
    gmt = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("GMT"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    span = lambda form: C.duration_s(C.parse_time(form("run_ts")), C.parse_time(form("ts")))
    return t.select("run_id", "model_id", "executor_id", "partition_idx", "samples", span(gmt).alias("gmt_s"), span(iso).alias("iso_s"))


@query("p17_units", f"WITH {TASKS} SELECT device, {rnd_sql('sum(inference_time) / 1000000.0')} AS mb_decimal, "
       f"{rnd_sql('sum(inference_time) / 1048576.0')} AS mb_binary, {rnd_sql('sum(inference_time) / 1000.0')} AS seconds FROM tasks GROUP BY device")
def p17(spark, sf_dir):
    t = tasks(spark, sf_dir).groupBy("device").agg(F.sum("inference_time").alias("x"))
    return t.select("device", rnd(C.mb("x")).alias("mb_decimal"), rnd(C.mb("x", binary=True)).alias("mb_binary"), rnd(C.ms_to_s("x")).alias("seconds"))


@query("p18_safe_ratio", f"WITH {TASKS} SELECT run_id, partition_idx, model_id, executor_id, samples, "
       + rnd_sql("CASE WHEN load_time > 0 THEN samples / load_time ELSE 0 END") + " AS throughput FROM tasks")
def p18(spark, sf_dir):
    t = tasks(spark, sf_dir)
    return t.select("run_id", "partition_idx", "model_id", "executor_id", "samples", rnd(C.safe_ratio("samples", "load_time")).alias("throughput"))


def _half_up(expr: str, digits: int) -> str:
    """Spark rounds a double half up from its shortest decimal text."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


@query("p19_rounding", f"SELECT o_orderkey AS run_id, {_half_up('o_totalprice / 1000', 4)} AS s, {_half_up('o_totalprice / 7', 1)} AS tp, {_half_up('o_totalprice / 9', 2)} AS ms FROM orders")
def p19(spark, sf_dir):
    x = F.col("elapsed_time")
    return runs(spark, sf_dir).select("run_id", C.round_s(x / 1000).alias("s"), C.round_tp(x / 7).alias("tp"), C.round_ms(x / 9).alias("ms"))


@query("p22_map_default", f"WITH {TASKS} SELECT run_id, coalesce(sum(samples) FILTER (WHERE device = 'A'), 0)::BIGINT AS a, "
       "coalesce(sum(samples) FILTER (WHERE device = 'Z'), 0)::BIGINT AS z FROM tasks GROUP BY run_id")
def p22(spark, sf_dir):
    per_device = tasks(spark, sf_dir).groupBy("run_id", "device").agg(F.sum("samples").alias("n"))
    # At most one entry per device, so the map of a run stays small.
    maps = per_device.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("device", "n"))).alias("m"))
    return maps.select("run_id", C.map_get("m", "A").alias("a"), C.map_get("m", "Z").alias("z"))


@query("p23_merge_dims", f"WITH {TELEMETRY} SELECT event_id, metric AS role, 'e' || executor_id AS instance, "
       "CASE WHEN executor_id % 2 = 0 THEN 'even' ELSE 'base' END AS grp, 4 AS n FROM telemetry")
def p23(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    base = F.create_map(F.lit("NodeRole"), F.lit("worker"), F.lit("InstanceId"), F.concat(F.lit("e"), "executor_id"), F.lit("Group"), F.lit("base"))
    fleet = F.create_map(F.lit("Fleet"), F.lit("f1"), F.lit("NodeRole"), F.lit("master"))
    even = F.when(F.col("executor_id") % 2 == 0, F.create_map(F.lit("Group"), F.lit("even"), F.lit("NodeRole"), F.col("metric")))
    extra = F.coalesce(even, F.create_map(F.lit("NodeRole"), F.col("metric")))
    out = e.withColumn("d", C.merge_dims(base, fleet, extra))
    return out.select("event_id", F.col("d")["NodeRole"].alias("role"), F.col("d")["InstanceId"].alias("instance"), F.col("d")["Group"].alias("grp"), F.size("d").alias("n"))


@query("p24_to_metrics", f"""WITH {RUNS}, wide AS (SELECT run_id, device_mode, elapsed_time, CASE WHEN status = 'O' THEN 3 END AS num_on_gpu FROM runs)
SELECT run_id, 'ThroughputSamplesPerSec' AS metric_name, elapsed_time * 2 AS value, 'Count/Second' AS unit FROM wide
UNION ALL SELECT run_id, 'ElapsedTimeSec', elapsed_time, 'Seconds' FROM wide
UNION ALL SELECT run_id, 'TotalSamplesProcessed', 0, 'Count' FROM wide
UNION ALL SELECT run_id, 'NumModelsOnGpu', num_on_gpu, 'Count' FROM wide WHERE num_on_gpu IS NOT NULL""")
def p24(spark, sf_dir):
    wide = runs(spark, sf_dir).select(
        "run_id", "elapsed_time", (F.col("elapsed_time") * 2).alias("total_throughput"),
        F.lit(None).cast("long").alias("total_samples_processed"),
        F.when(F.col("status") == "O", F.lit(3)).alias("num_on_gpu"), F.lit(None).cast("int").alias("num_on_cpu"),
    )
    return to_metrics(wide, RUN_METRICS, ["run_id"])


@query("p24_datapoints", f"""WITH {RUNS} SELECT run_id, 'bench' AS namespace, 'ElapsedTimeSec' AS metric_name, elapsed_time AS value, 'Seconds' AS unit,
'master' AS role, device_mode AS mode, 3 AS n_dims, run_ts AS ts FROM runs""")
def p24_points(spark, sf_dir):
    """Complete datapoints: namespace, merged dimensions and time."""
    wide = runs(spark, sf_dir)
    rows = to_metrics(wide, [m for m in RUN_METRICS if m[0] == "ElapsedTimeSec"], ["run_id", "device_mode", "run_ts"])
    node = F.create_map(F.lit("NodeRole"), F.lit("worker"), F.lit("InstanceId"), F.col("run_id").cast("string"))
    own = F.create_map(F.lit("NodeRole"), F.lit("master"), F.lit("Mode"), F.col("device_mode"))
    out = datapoints(rows, "bench", node, own, ts=F.col("run_ts"))
    return out.select(
        F.col("dims")["InstanceId"].cast("long").alias("run_id"), "namespace", "metric_name", "value", "unit", F.col("dims")["NodeRole"].alias("role"),
        F.col("dims")["Mode"].alias("mode"), F.size("dims").alias("n_dims"), F.col("ts").cast("timestamp_ntz").alias("ts"),
    )


@query("p26_json_property", f"WITH {TELEMETRY} SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS BIGINT) AS absent FROM telemetry")
def p26(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    return e.select("event_id", C.prop("props", "$.k", "bigint").alias("k"), C.prop("props", "$.absent", "bigint").alias("absent"))


@query("f1_ok_runs", f"WITH {RUNS} SELECT device_mode, count(*) AS n FROM runs WHERE error IS NULL GROUP BY device_mode")
def f1(spark, sf_dir):
    return FL.ok_runs(runs(spark, sf_dir)).groupBy("device_mode").agg(F.count(F.lit(1)).alias("n"))


@query("f2_with_details", f"WITH {RUNS}, {TASKS} SELECT run_id, device_mode FROM runs WHERE run_id IN (SELECT run_id FROM tasks)")
def f2(spark, sf_dir):
    return FL.runs_with_tasks(runs(spark, sf_dir), tasks(spark, sf_dir)).select("run_id", "device_mode")


@query("f3_alive_workers", f"WITH {EXECUTORS} SELECT executor_id, hostname, capacity FROM executors WHERE capacity > 0 AND executor_name <> 'Supplier#000000000'")
def f3(spark, sf_dir):
    w = executors(spark, sf_dir).withColumn("state", F.when(F.col("capacity") > 0, "ALIVE").otherwise("DEAD"))
    w = w.withColumn("id", F.when(F.col("executor_name") == "Supplier#000000000", "driver").otherwise(F.col("executor_name")))
    return FL.no_driver(FL.alive_workers(w)).select("executor_id", "hostname", "capacity")


@query("f4_by_category", f"WITH {MODELS} SELECT model_id, name, node FROM models WHERE category = 'ECONOMY'")
def f4(spark, sf_dir):
    return FL.by_category(models(spark, sf_dir), "ECONOMY").select("model_id", "name", "node")


@query("f5_known_modes", f"WITH {RUNS} SELECT device_mode, count(*) AS n FROM runs WHERE device_mode IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY device_mode")
def f5(spark, sf_dir):
    kept = FL.known_modes(runs(spark, sf_dir), ["1-URGENT", "2-HIGH", "5-LOW"])
    return kept.groupBy("device_mode").agg(F.count(F.lit(1)).alias("n"))


@query("f6_cap_rows", f"WITH {RUNS} SELECT run_id, elapsed_time FROM runs ORDER BY elapsed_time DESC, run_id LIMIT 1000")
def f6(spark, sf_dir):
    return FL.cap_rows(runs(spark, sf_dir).select("run_id", "elapsed_time"), [F.desc("elapsed_time"), F.asc("run_id")], 1000)


# Payloads are the stored text sizes; a small target makes several partitions.
@query("f7_plan_partitions", "WITH s AS (SELECT source, sum(strlen(text)) AS payload_bytes FROM documents GROUP BY source) "
       "SELECT source, payload_bytes::BIGINT AS payload_bytes, greatest(4, ceil(payload_bytes / 20000.0))::INTEGER AS partitions, "
       + rnd_sql("payload_bytes / greatest(4, ceil(payload_bytes / 20000.0))") + " AS bytes_per_partition, true AS fits FROM s")
def f7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes = docs.groupBy("source").agg(F.sum(F.octet_length("text").cast("long")).alias("payload_bytes"))
    return FL.plan_partitions(sizes, 4, 20_000).withColumn("bytes_per_partition", rnd("bytes_per_partition"))
