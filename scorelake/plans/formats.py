"""Queries through files: tables are written in each stored layout and read back."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vectors import to_wide, wide_names
from ..operators.filters import ok_runs
from ..operators.runs import run_health, samples_from_maps, samples_per_model
from ..operators.telemetry import DEVICE_METRICS, to_metrics
from ..schemas import RUN
from ..session import scratch_path
from ..sinks.tables import archive, write_blobs, write_runs
from ..sources.blocks import read_blocks
from ..sources import devices, runs as RS, signals as SG, status as ST
from ..streaming import jobs
from .catalog import Catalog, rnd, rnd_sql
from .tables import EXECUTORS, HALF, MODELS, RUNS, SIGNALS, TASKS, TELEMETRY, executors, models, runs, signals, table, tasks, telemetry

catalog = Catalog()
query = catalog.query
HEAD = f"WITH {RUNS}, {TASKS}, {MODELS}, {EXECUTORS}, {TELEMETRY}"


def run_records(spark, sf_dir):
    """Run records as stored. A run lists one entry per partition number (at most
    seven) and one sample count per device class (three), so records stay small
    however many tasks a run has. Runs with status P use the nested task shape."""
    t = tasks(spark, sf_dir)
    # What crosses the network are bare figures; records are put together behind it.
    cells = t.groupBy("run_id", "partition_idx", "device").agg(F.sum("samples").alias("n"), F.sum("inference_time").alias("secs"), F.min("load_time").alias("load"))
    own = cells.groupBy("run_id").agg(F.collect_list(F.struct("partition_idx", "device", "n", "secs", "load")).alias("cells"))

    def total(rows, field: str):
        """The sum, null where there is no value."""
        return F.aggregate(rows, F.lit(None).cast(cells.schema[field].dataType), lambda acc, c: F.coalesce(acc + c[field], acc, c[field]))

    def each(key: str, fold):
        """``fold`` of every value of ``key`` and the run's cells that have it."""
        distinct = F.array_distinct(F.transform("cells", lambda c: c[key]))
        return F.transform(distinct, lambda v: fold(v, F.filter("cells", lambda c: c[key].eqNullSafe(v))))

    parts = each("partition_idx", lambda v, rows: F.struct(
        v.alias("partition_idx"), total(rows, "n").alias("n"), total(rows, "secs").alias("secs"),
        F.array_min(F.transform(rows, lambda c: c["device"])).alias("device"), F.array_min(F.transform(rows, lambda c: c["load"])).alias("load"),
    ))
    maps = F.map_from_entries(each("device", lambda v, rows: F.struct(v.alias("device"), total(rows, "n").alias("n"))))
    own = own.select("run_id", parts.alias("parts"), total(F.col("cells"), "n").alias("total_samples_processed"), maps.alias("per_model_processed"))
    host = lambda p: F.concat(F.lit("host"), p["partition_idx"].cast("string"))
    flat = F.transform("parts", lambda p: F.struct(
        p["partition_idx"].alias("partition_idx"), F.concat(host(p), F.lit("_1")).alias("executor_id"), host(p).alias("hostname"), p["device"].alias("device"),
        p["load"].alias("model_load_time_sec"), p["secs"].alias("inference_time_sec"), p["n"].alias("samples_processed"),
    ))
    nested = F.transform("parts", lambda p: F.struct(
        p["partition_idx"].alias("partition_idx"), F.struct(F.concat(host(p), F.lit(":1")).alias("id"), host(p).alias("hostname"), p["device"].alias("device")).alias("executor"),
        F.struct(p["load"].alias("model_load_time_sec"), p["secs"].alias("total_inference_time_sec")).alias("timing"),
        p["n"].alias("total_samples_processed"),
    ))
    joined = runs(spark, sf_dir).join(own, "run_id")
    kind = StructType.fromDDL(RUN)["partition_details"].dataType
    wide = lambda c: F.from_json(F.to_json(c), kind)
    return joined.select(
        "run_id", F.col("device_mode").alias("mode"), "device_mode", "elapsed_time", "total_samples_processed", "per_model_processed",
        F.date_format("run_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "status", "error",
        F.when(F.col("status") == "P", wide(nested)).otherwise(wide(flat)).alias("partition_details"),
    )


def stored_runs(spark, sf_dir, **kwargs) -> str:
    path = scratch_path(spark, "runs")
    write_runs(run_records(spark, sf_dir), path, **kwargs)
    return path


@query("s5_read_runs", f"{HEAD} SELECT run_id, device_mode, elapsed_time, sum(samples)::BIGINT AS samples, count(DISTINCT partition_idx) AS parts, strftime(run_ts, '%Y-%m-%dT%H:%M:%S') AS stamp, true AS tagged "
       "FROM runs JOIN tasks USING (run_id) GROUP BY run_id, device_mode, elapsed_time, run_ts")
def s5(spark, sf_dir):
    out = RS.read_runs(spark, stored_runs(spark, sf_dir), "*.json", lines=True)
    return out.select("run_id", "device_mode", "elapsed_time", F.col("total_samples_processed").alias("samples"), F.size("partition_details").cast("long").alias("parts"),
                      F.col("timestamp").alias("stamp"), F.col("_source_file").endswith(".json").alias("tagged"))


@query("s5_damaged_runs", f"{HEAD}, r AS (SELECT run_id, run_id % 7 = 3 AS cut, run_id % 7 = 5 AS mistyped FROM runs SEMI JOIN tasks USING (run_id)) "
       "SELECT count(*) FILTER (WHERE NOT cut AND NOT mistyped) AS good, sum(run_id) FILTER (WHERE NOT cut AND NOT mistyped)::BIGINT AS ids, count(*) FILTER (WHERE cut) AS cut_short, count(*) FILTER (WHERE mistyped) AS mistyped FROM r")
def s5_damaged(spark, sf_dir):
    """A folder of records of which some are cut short and some hold text where a number belongs."""
    lines = spark.read.text(stored_runs(spark, sf_dir, compression="gzip"), pathGlobFilter="*.json.gz", recursiveFileLookup=True)
    run_id = F.get_json_object("value", "$.run_id").cast("bigint")
    value = F.when(run_id % 7 == 3, F.substring("value", 1, 60)).when(run_id % 7 == 5, F.regexp_replace("value", '"elapsed_time":[^,}]*', '"elapsed_time":"soon"'))
    path = scratch_path(spark, "damaged")
    lines.select(F.coalesce(value, "value").alias("value")).write.text(path, compression="gzip")
    good = RS.read_runs(spark, path, "*.txt.gz", lines=True, damaged="skip").agg(F.count("*").alias("good"), F.sum("run_id").alias("ids"))
    mistyped = F.col("record").contains('"soon"')
    bad = RS.damaged_runs(spark, path, "*.txt.gz", lines=True).agg(F.count_if(~mistyped).alias("cut_short"), F.count_if(mistyped).alias("mistyped"))
    return good.crossJoin(bad)


@query("k1_write_runs", f"{HEAD} SELECT device_mode, count(*) AS runs FROM runs SEMI JOIN tasks USING (run_id) GROUP BY device_mode")
def k1(spark, sf_dir):
    # The mode folder prunes the read; the record repeats the mode.
    out = spark.read.schema(f"{RUN}, mode_dir string").json(stored_runs(spark, sf_dir))
    return out.groupBy(F.col("mode_dir").alias("device_mode")).agg(F.count("*").alias("runs"))


@query("s6_read_grid", f"{HEAD} SELECT run_id, status FROM runs SEMI JOIN tasks USING (run_id) WHERE error IS NULL")
def s6(spark, sf_dir):
    return RS.read_run_grid(spark, stored_runs(spark, sf_dir), "*.json", lines=True).select("run_id", "status")


@query("p21_unify_tasks", f"{HEAD} SELECT run_id, partition_idx, 'host' || partition_idx AS hostname, min(device) AS device, {rnd_sql('min(load_time)')} AS load_time, {rnd_sql('sum(inference_time)', 2)} AS inference_time, sum(samples)::BIGINT AS samples "
       "FROM tasks SEMI JOIN runs USING (run_id) GROUP BY run_id, partition_idx")
def p21(spark, sf_dir):
    out = RS.unify_tasks(RS.read_runs(spark, stored_runs(spark, sf_dir), "*.json", lines=True), ["run_id"])
    return out.select("run_id", "partition_idx", "hostname", "device", rnd("load_time").alias("load_time"), rnd("inference_time", 2).alias("inference_time"), "samples")


@query("a1_samples_from_records", f"{HEAD} SELECT device AS model, sum(samples)::BIGINT AS samples FROM tasks JOIN runs USING (run_id) WHERE error IS NULL GROUP BY device")
def a1_records(spark, sf_dir):
    stored = ok_runs(RS.read_runs(spark, stored_runs(spark, sf_dir), "*.json", lines=True))
    return samples_per_model(samples_from_maps(stored))


@query("s7_mode_results", f"""{HEAD}, m AS (SELECT model_id, CASE WHEN device_mode IN ('1-URGENT', '3-MEDIUM') THEN 'single_gpu' WHEN device_mode IN ('2-HIGH', '4-NOT SPECIFIED') THEN 'hybrid_cpu_gpu' ELSE 'distributed_gpu' END AS result_mode, samples FROM tasks JOIN runs USING (run_id))
SELECT model_id, result_mode, sum(samples)::BIGINT AS samples FROM m GROUP BY ALL""")
def s7(spark, sf_dir):
    t = tasks(spark, sf_dir).join(runs(spark, sf_dir).select("run_id", "device_mode"), "run_id")
    per = t.groupBy("model_id").agg(*[
        F.sum(F.when(F.col("device_mode").isin(m), F.col("samples"))).alias(n)
        for n, m in (("single_gpu", ["1-URGENT", "3-MEDIUM"]), ("hybrid_cpu_gpu", ["2-HIGH", "4-NOT SPECIFIED"]), ("distributed_gpu", ["5-LOW"]))
    ])
    record = per.select(
        F.struct(F.col("model_id").cast("int").alias("partitions")).alias("config"),
        *[F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("mode"), F.col(n).alias("total_samples_processed"))).alias(n) for n in ("single_gpu", "hybrid_cpu_gpu", "distributed_gpu")],
    )
    path = scratch_path(spark, "modes")
    record.write.json(path)
    out = RS.read_mode_results(spark, path, "*.json", lines=True)
    return out.select(F.col("config.partitions").cast("long").alias("model_id"), "result_mode", F.col("total_samples_processed").alias("samples"))


@query("s8_read_status", f"{HEAD} SELECT run_id, partition_idx AS stage_id, count(*) AS tasks, sum(samples)::BIGINT AS run_ms, true AS finished FROM tasks GROUP BY run_id, partition_idx")
def s8(spark, sf_dir):
    per = tasks(spark, sf_dir).groupBy("run_id", "partition_idx").agg(F.count("*").alias("c"), F.sum("samples").alias("s"))
    stage = F.struct(F.col("partition_idx").alias("stageId"), F.col("c").cast("int").alias("numCompleteTasks"), F.col("s").alias("executorRunTime"), F.lit("COMPLETE").alias("status"))
    record = per.groupBy("run_id").agg(F.collect_list(stage).alias("stages"))
    path = scratch_path(spark, "status")
    record.select(F.struct(F.col("run_id").cast("string").alias("id")).alias("application"), "stages").write.json(path)
    out = ST.read_status(spark, path, lines=True)["stages"]
    return out.select(F.col("app_id").cast("long").alias("run_id"), F.col("stageId").alias("stage_id"), F.col("numCompleteTasks").cast("long").alias("tasks"),
                      F.col("executorRunTime").alias("run_ms"), (F.col("status") == "COMPLETE").alias("finished"))


@query("s9_cluster_state", f"""{HEAD}, slots AS (SELECT hostname, executor_id % 8 AS slot, count(*) AS cores, sum(executor_id) AS memory FROM executors GROUP BY ALL)
SELECT count(*)::INTEGER AS total_workers, count(*) FILTER (WHERE slot % 2 = 0)::INTEGER AS active_workers, sum(cores)::BIGINT AS total_cores, sum(cores // 2)::BIGINT AS cores_used,
sum(memory)::BIGINT AS total_memory, sum(memory // 2)::BIGINT AS memory_used, 1 AS active_apps, 0 AS completed_apps FROM slots GROUP BY hostname""")
def s9(spark, sf_dir):
    slots = executors(spark, sf_dir).groupBy("hostname", (F.col("executor_id") % 8).alias("slot")).agg(F.count("*").alias("cores"), F.sum("executor_id").alias("memory"))
    state = F.when(F.col("slot") % 2 == 0, "ALIVE").otherwise("DEAD")
    worker = F.struct(state.alias("state"), F.col("cores").cast("int").alias("cores"), F.floor(F.col("cores") / 2).cast("int").alias("coresused"),
                      "memory", F.floor(F.col("memory") / 2).alias("memoryused"))
    record = slots.groupBy("hostname").agg(F.collect_list(worker).alias("workers"))
    path = scratch_path(spark, "state")
    record.select("workers", F.array(F.struct(F.col("hostname").alias("id"))).alias("activeapps")).write.json(path)
    return ST.cluster_figures(ST.read_cluster_state(spark, path, lines=True))


# Lines by kind of event: too few fields, no power, a bad number, bad power, or complete.
@query("s10_device_readings", f"""{HEAD}, good AS (SELECT * FROM telemetry WHERE metric NOT IN ('error', 'view'))
SELECT metric_name, count(*) AS n, {rnd_sql('sum(value)')} AS total, unit FROM (
SELECT unnest(['GpuUtilizationPercent', 'GpuMemoryUtilizationPercent', 'GpuMemoryUsedMb', 'GpuMemoryTotalMb', 'GpuTemperatureC', 'GpuPowerDrawWatts']) AS metric_name,
unnest([value, value, value, 15360, value, CASE WHEN metric NOT IN ('click', 'purchase') THEN value END]) AS value, unnest(['Percent', 'Percent', 'Megabytes', 'Megabytes', 'None', 'None']) AS unit FROM good)
WHERE value IS NOT NULL GROUP BY metric_name, unit""")
def s10(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    value = F.col("value").cast("string")
    power = F.when(F.col("metric") == "click", "[N/A]").when(F.col("metric") == "purchase", "high").otherwise(value)
    util = F.when(F.col("metric") == "view", "x").otherwise(value)
    line = F.concat_ws(", ", F.col("executor_id").cast("string"), util, value, value, F.lit("15360"), value, power)
    lines = e.select(F.when(F.col("metric") == "error", F.lit("3, 5, 1")).otherwise(line).alias("value"))
    path = scratch_path(spark, "devices")
    lines.write.text(path)
    rows = to_metrics(devices.read_device_csv(spark, path), DEVICE_METRICS, ["gpu_index"])
    return rows.groupBy("metric_name", "unit").agg(F.count("*").alias("n"), rnd(F.sum("value")).alias("total"))


@query("s14_event_log", f"{HEAD} SELECT executor_id, count(*) AS tasks, sum(samples)::BIGINT AS duration_ms, count(*) FILTER (WHERE device = 'R') AS failed FROM tasks GROUP BY executor_id")
def s14(spark, sf_dir):
    t = tasks(spark, sf_dir)
    info = F.struct(F.col("executor_id").cast("string").alias("Executor ID"), F.lit(1000).cast("long").alias("Launch Time"),
                    (F.col("samples") + 1000).alias("Finish Time"), (F.col("device") == "R").alias("Failed"))
    ends = t.select(F.lit("SparkListenerTaskEnd").alias("Event"), F.col("run_id").cast("int").alias("Stage ID"), info.alias("Task Info"))
    others = runs(spark, sf_dir).select(F.lit("SparkListenerStageCompleted").alias("Event"), F.col("run_id").cast("int").alias("Stage ID"))
    path = scratch_path(spark, "eventlog")
    ends.unionByName(others, allowMissingColumns=True).write.json(path)
    out = ST.read_event_log(spark, path)["tasks"]
    return out.groupBy(F.col("executor_id").cast("long").alias("executor_id")).agg(
        F.count("*").alias("tasks"), F.sum("duration_ms").alias("duration_ms"), F.count_if("failed").alias("failed")
    )


@query("s14_log_health", f"{HEAD}, t AS (SELECT run_id, max(samples) AS mx, min(samples) AS mn, sum(samples % 7) AS gc, sum(samples) AS total, count(*) FILTER (WHERE device = 'R') AS failed, sum(samples * 6) AS sh FROM tasks GROUP BY run_id) "
       f"SELECT run_id, {rnd_sql('CASE WHEN mn > 0 THEN mx::DOUBLE / mn ELSE 0 END', 6)} AS skew, {rnd_sql('CASE WHEN total > 0 THEN gc::DOUBLE / total ELSE 0 END', 6)} AS gc_share, failed AS failed_tasks, sh > 0 AS has_shuffle FROM t")
def s14_health(spark, sf_dir):
    """Run health straight from an event log, shuffle and collection times included."""
    t = tasks(spark, sf_dir)
    n = F.col("samples").cast("bigint")
    info = F.struct(F.col("executor_id").cast("string").alias("Executor ID"), F.lit(1000).cast("long").alias("Launch Time"), (n + 1000).alias("Finish Time"), (F.col("device") == "R").alias("Failed"))
    shuffled = F.struct(n.alias("Local Bytes Read"), (2 * n).alias("Remote Bytes Read")).alias("Shuffle Read Metrics")
    metrics = F.struct((n % 7).alias("JVM GC Time"), shuffled, F.struct((3 * n).alias("Shuffle Bytes Written")).alias("Shuffle Write Metrics"))
    path = scratch_path(spark, "eventlog")
    t.select(F.lit("SparkListenerTaskEnd").alias("Event"), F.col("run_id").cast("int").alias("Stage ID"), info.alias("Task Info"), metrics.alias("Task Metrics")).write.json(path, compression="gzip")
    out = run_health(ST.read_event_log(spark, path)["tasks"], ["stage_id"])
    return out.select(F.col("stage_id").cast("long").alias("run_id"), rnd("skew", 6).alias("skew"), rnd("gc_share", 6).alias("gc_share"), "failed_tasks", "has_shuffle")


@query("s8_stage_tasks", f"{HEAD} SELECT run_id, executor_id, sum(samples)::BIGINT AS duration, sum(samples * 2)::BIGINT AS shuffle_bytes, count(*) FILTER (WHERE device = 'R') AS failed FROM tasks GROUP BY run_id, executor_id")
def s8_tasks(spark, sf_dir):
    """Tasks out of the stage details of a status capture."""
    t = tasks(spark, sf_dir)
    n = F.col("samples").cast("bigint")
    metrics = F.struct(F.struct(n.alias("localBytesRead")).alias("shuffleReadMetrics"), F.struct(n.alias("bytesWritten")).alias("shuffleWriteMetrics"))
    status = F.when(F.col("device") == "R", "FAILED").otherwise("SUCCESS")
    task = F.struct(n.alias("duration"), F.col("executor_id").cast("string").alias("executorId"), status.alias("status"), metrics.alias("taskMetrics"))
    # The tasks of one stage are one record in this format.
    listed = t.groupBy("run_id").agg(F.collect_list(task).alias("l"))
    numbered = F.map_from_arrays(F.transform("l", lambda x, i: i.cast("string")), "l")
    path = scratch_path(spark, "status")
    detail = F.array(F.struct(F.col("run_id").cast("int").alias("stageId"), numbered.alias("tasks")))
    listed.select(F.struct(F.col("run_id").cast("string").alias("id")).alias("application"), detail.alias("stage_details")).write.json(path)
    out = ST.read_status(spark, path, lines=True)["tasks"]
    return out.groupBy(F.col("app_id").cast("long").alias("run_id"), F.col("executor_id").cast("long").alias("executor_id")).agg(
        F.sum("duration").alias("duration"), F.sum("shuffle_bytes").alias("shuffle_bytes"), F.count_if("failed").alias("failed")
    )


def _pack(ids, vectors):
    """One ``.npy`` block as bytes."""
    buffer = io.BytesIO()
    np.save(buffer, np.stack(vectors).astype("float32"))
    return buffer.getvalue()


@query("s2_read_npy", f"WITH {SIGNALS} SELECT signal_id // 100 AS block, signal_id % 100 AS row_idx, {rnd_sql('list_sum(features::DOUBLE[])', 5)} AS total FROM signals")
def s2(spark, sf_dir):
    """Blocks of one hundred consecutive signals, packed and unpacked."""
    rows = signals(spark, sf_dir).withColumn("block", F.floor(F.col("signal_id") / 100))

    def pack(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("signal_id")
        return pd.DataFrame({"path": [f"/blocks/{key[0]}.npy"], "content": [_pack(pdf["signal_id"], list(pdf["features"]))]})

    blocks = rows.select("block", "signal_id", "features").groupBy("block").applyInPandas(pack, "path string, content binary")
    out = SG.unpack_npy(blocks, 2 * HALF)
    total = F.aggregate(F.col("values").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return out.select(F.regexp_extract("file", "/(\\d+)\\.npy$", 1).cast("long").alias("block"), "row_idx", rnd(total, 5).alias("total"))


@query("s2_read_blocks", f"WITH {SIGNALS}, r AS (SELECT signal_id // 100 AS block, row_number() OVER (PARTITION BY signal_id // 100 ORDER BY signal_id) - 1 AS row_idx, features FROM signals) "
       f"SELECT 'shelf=' || block % 3 || '/' || block || '.npy' AS file, row_idx, {rnd_sql('list_sum(features::DOUBLE[])', 5)} AS total FROM r")
def s2_blocks(spark, sf_dir):
    """A folder of blocks of a hundred signals, written by the executors and read in ranges of about twenty rows."""
    rows = signals(spark, sf_dir).withColumn("block", F.floor(F.col("signal_id") / 100))

    def pack(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("signal_id")
        return pd.DataFrame({"name": [f"shelf={key[0] % 3}/{key[0]}.npy"], "content": [_pack(pdf["signal_id"], list(pdf["features"]))]})

    path = scratch_path(spark, "blocks")
    blocks = rows.select("block", "signal_id", "features").groupBy("block").applyInPandas(pack, "name string, content binary")
    write_blobs(blocks, path).agg(F.sum("length")).collect()
    out = read_blocks(spark, path, 2 * HALF, range_bytes=20 * 4 * 2 * HALF)
    total = F.aggregate(F.col("values").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return out.select("file", "row_idx", rnd(total, 5).alias("total"))


@query("s3_read_blobs", "SELECT page_id % 8 AS shelf, sum(strlen(html) + 1)::BIGINT AS length FROM pages GROUP BY 1")
def s3(spark, sf_dir):
    """Files of many pages, on eight shelves; the text writer ends each page with a newline."""
    path = scratch_path(spark, "pages")
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 8).alias("shelf"), F.col("html").alias("value"))
    pages.repartition("shelf").write.partitionBy("shelf").text(path)
    out = SG.read_blobs(spark, path, "*.txt")
    shelf = F.regexp_extract("path", "shelf=(\\d+)/", 1).cast("long").alias("shelf")
    return out.groupBy(shelf).agg(F.sum(F.octet_length("content").cast("long")).alias("length"))


@query("s1_read_wide_csv", f"WITH {SIGNALS} SELECT signal_id, label::BIGINT AS label, {rnd_sql('list_sum(features::DOUBLE[])', 6)} AS total FROM signals")
def s1_csv(spark, sf_dir):
    wide = to_wide(signals(spark, sf_dir), "features", 2 * HALF)
    path = scratch_path(spark, "wide")
    wide.select("signal_id", *wide_names(2 * HALF), "label", F.lit("name").alias("class_name"), F.lit("cat").alias("category")).write.option("header", "true").csv(path)
    out = SG.read_wide_signals(spark, path, 2 * HALF, id_col="signal_id")
    total = F.aggregate(F.col("features").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return out.select(F.col("signal_id").cast("long").alias("signal_id"), "label", rnd(total, 6).alias("total"))


@query("s13_chunked_scan", "SELECT count(*) AS rows, true AS several_chunks FROM embeddings")
def s13(spark, sf_dir):
    """The same table in eight files, two per chunk."""
    src, out = scratch_path(spark, "src"), scratch_path(spark, "out")
    signals(spark, sf_dir).repartition(8, "signal_id").write.parquet(src)
    stream = SG.stream_signals(spark, src, spark.read.parquet(src).schema, max_files=2)

    def write(batch, batch_id):
        batch.select("signal_id").write.mode("overwrite").parquet(f"{out}/chunk={batch_id}")

    query_ = stream.writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, "checkpoint"))
    query_.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").alias("rows"), (F.count_distinct("chunk") > 1).alias("several_chunks"))


def _pickup(spark, sf_dir):
    """Whole records land in two rounds; each file is picked up once, also across restarts."""
    landing, out, checkpoint = (scratch_path(spark, n) for n in ("landing", "out", "checkpoint"))
    records = run_records(spark, sf_dir)
    for late in (False, True):
        write_runs(records.where((F.col("status") == "P") == late), landing, compression="gzip")
        src = jobs.stream_run_files(spark, landing, "*.json.gz", lines=True)
        src = src.select("run_id", "status", "_source_file", F.size("partition_details").alias("tasks"), F.size("per_model_processed").alias("models"))
        jobs.run_available(src, out, checkpoint)
    return spark.read.parquet(out)


@query("s12_watch_results", f"{HEAD}, n AS (SELECT run_id, count(DISTINCT partition_idx) AS tasks FROM tasks GROUP BY run_id) SELECT status, count(*) AS runs, sum(tasks)::BIGINT AS tasks FROM runs JOIN n USING (run_id) GROUP BY status")
def s12(spark, sf_dir):
    return _pickup(spark, sf_dir).groupBy("status").agg(F.count("*").alias("runs"), F.sum("tasks").alias("tasks"))


@query("t6_exactly_once", f"{HEAD} SELECT run_id, 1::BIGINT AS times FROM runs SEMI JOIN tasks USING (run_id)")
def t6(spark, sf_dir):
    return _pickup(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("times"))


@query("k4_archive", f"{HEAD} SELECT strftime(run_ts, '%Y%m') AS run_prefix, count(*) AS runs, {rnd_sql('sum(elapsed_time)', 2)} AS elapsed FROM runs GROUP BY 1")
def k4(spark, sf_dir):
    path = scratch_path(spark, "archive")
    archive(runs(spark, sf_dir), path, "run_ts", grain="yyyyMM")
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("run_prefix").cast("string").alias("run_prefix")).agg(F.count("*").alias("runs"), rnd(F.sum("elapsed_time"), 2).alias("elapsed"))
