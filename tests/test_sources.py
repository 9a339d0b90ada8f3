"""Readers over small files of our own in every stored shape."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import sets as S
from scorelake.operators.runs import executor_summary, latest
from scorelake.operators.telemetry import EXECUTOR_METRICS, executor_figures, status_rollup, to_metrics
from scorelake.sinks.tables import archive, write_runs
from scorelake.sources import devices, runs as R, signals as SG, status as ST
from scorelake.streaming import jobs


def task_a(k, n):
    return {"partition_idx": k, "executor_id": f"h{k % 2}_7", "hostname": f"h{k % 2}", "device": "cpu", "cuda_available": False,
            "model_load_time_sec": 0.5 + k, "inference_time_sec": 2.0, "total_task_time_sec": 2.0, "samples_processed": n,
            "per_model_processed": {"m1": n - 1, "m2": 1}, "batch_size": 64}


def task_b(k, n):
    return {"partition_idx": k, "executor": {"id": "h9:3", "hostname": "h9", "pid": 3, "device": "cuda", "gpu_name": "g", "gpu_memory_mb": 1.5, "cpu_count": 4},
            "timing": {"model_load_time_sec": 0.1, "total_inference_time_sec": 1.0, "total_task_time_sec": 1.2}, "models_run": 1,
            "total_samples_processed": n, "per_model": {"m1": {"samples_processed": n, "inference_time_sec": 1.0, "throughput": n * 1.0,
            "input_shape": [128], "output_shape": [8], "batches": 1}}}


def run(mode, stamp, details, **extra):
    return {"mode": f"distributed_{mode}", "device_mode": mode, "elapsed_time": 4.0, "total_samples_processed": 30, "total_throughput": 7.5,
            "per_model_processed": {"m1": 28, "m2": 2}, "num_partitions": 2, "num_models": 2, "batch_size": 64, "timestamp": stamp,
            "partition_details": details, **extra}


STAGE = {"stageId": 3, "attemptId": 0, "status": "COMPLETE", "numTasks": 2, "numActiveTasks": 1, "numCompleteTasks": 2, "numFailedTasks": 1,
         "executorRunTime": 1500, "jvmGcTime": 150, "memoryBytesSpilled": 5, "diskBytesSpilled": 6, "name": "collect"}
EXECUTORS = [
    {"id": "driver", "hostPort": "d:1", "totalDuration": 9, "memoryUsed": 1},
    {"id": "0", "hostPort": "w1:7", "totalDuration": 2500, "memoryUsed": 3_000_000, "completedTasks": 4, "totalCores": 2},
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    runs = root / "runs"
    runs.mkdir()
    first = run("cpu_only", "2026-07-19T10:00:00.5", [task_a(0, 10), task_a(1, 20)], spark_ui_stats={"app_id": "app-1", "stages": [STAGE], "executors": EXECUTORS})
    second = run("gpu_only", "2026-07-19T11:00:00", [])
    for name, data in (("cluster_benchmark_a_1.json", first), ("cluster_benchmark_b_2.json", second), ("other.json", second)):
        (runs / name).write_text(json.dumps(data, indent=2))
    grid = [dict(first, run_number=1), {"run_number": 2, "device_mode": "gpu_only", "status": "failed", "error": "lost"}, dict(second, run_number=3)]
    (runs / "incremental_all_modes_x.json").write_text(json.dumps(grid, indent=2))
    modes = root / "modes"
    modes.mkdir()
    wide = {"config": {"signal_samples": 5, "partitions": 4}, "models": {"m1": {"category": "signal", "memory_mb": 50}},
            "single_gpu": {"mode": "single_gpu", "error": "no device"}, "distributed_gpu": dict(run("x", "t", [task_b(0, 7)]), num_models=1),
            "total_benchmark_time": 3.5}
    (modes / "results_all.json").write_text(json.dumps(wide, indent=1))
    return root


@pytest.fixture(scope="module")
def stored(spark, folder):
    return R.read_runs(spark, str(folder / "runs"))


def test_runs_carry_their_file(stored):
    assert {(r["_source_file"], r["device_mode"]) for r in stored.collect()} == {("cluster_benchmark_a_1.json", "cpu_only"), ("cluster_benchmark_b_2.json", "gpu_only")}


def test_grid_drops_failures_and_repeats_are_counted_once(spark, folder, stored):
    grid = R.read_run_grid(spark, str(folder / "runs"))
    assert {r["run_number"] for r in grid.collect()} == {1, 3}
    both = S.all_runs(stored, grid)
    assert both.count() == 4
    assert S.distinct_runs(both, ["device_mode", "timestamp"]).count() == 2


def test_latest_detailed_run(stored):
    assert latest(stored.where(F.size("partition_details") > 0).select("_source_file", "device_mode"), ["_source_file"]).first()["device_mode"] == "cpu_only"


def test_mode_results(spark, folder):
    rows = {r["result_mode"]: r for r in R.read_mode_results(spark, str(folder / "modes")).collect()}
    assert set(rows) == {"single_gpu", "distributed_gpu"}
    assert rows["single_gpu"]["error"] == "no device" and rows["distributed_gpu"]["total_throughput"] == 7.5
    assert R.model_categories(spark, str(folder / "modes")).first().asDict() == {"model": "m1", "category": "signal", "memory_mb": 50.0}


def test_both_task_shapes(spark, folder, stored):
    a = R.unify_tasks(stored, ["device_mode"])
    b = R.unify_tasks(R.read_mode_results(spark, str(folder / "modes")), ["mode"])
    flat = a.orderBy("partition_idx").first()
    assert (flat["executor_id"], flat["hostname"], flat["samples"], flat["load_time"], flat["per_model_processed"]) == ("h0_7", "h0", 10, 0.5, {"m1": 9, "m2": 1})
    nested = b.first()
    assert (nested["executor_id"], nested["device"], nested["inference_time"], nested["per_model_processed"]) == ("h9:3", "cuda", 1.0, {"m1": 7})
    summary = executor_summary(a, ["partition_idx"]).orderBy("executor_id").first()
    assert (summary["tasks"], summary["samples"], summary["load_time"], summary["throughput"]) == (1, 10, 0.5, 5.0)


def test_embedded_status(stored):
    stages = ST.run_status(stored, "stages", ["device_mode"])
    row = status_rollup(stages, ["device_mode"]).first()
    assert (row["tasks"], row["failed_tasks"], row["run_time_s"], row["spilled_bytes"], row["gc_share"]) == (3, 1, 1.5, 11, 0.1)
    figures = executor_figures(ST.run_status(stored, "executors", ["device_mode"])).collect()
    assert [(r["host"], r["duration_s"], r["memory_used_mb"]) for r in figures] == [("w1", 2.5, 3.0)]
    metrics = to_metrics(ST.run_status(stored, "executors", ["device_mode"]), EXECUTOR_METRICS, ["id"])
    assert metrics.count() == 16
    assert metrics.where("id = '0' AND metric_name = 'ExecutorDiskUsedMb'").first()["value"] == 0.0


def test_captured_status(spark, tmp_path):
    data = {"application": {"id": "app-2", "name": "n"}, "jobs": [{"jobId": 0, "status": "SUCCEEDED", "stageIds": [3], "submissionTime": "2026-07-20T01:40:09.113GMT"}],
            "stages": [STAGE, dict(STAGE, stageId=4)], "executors": EXECUTORS, "environment": {"sparkProperties": [["spark.a", "1"]]}, "storage_rdd": [{"id": 1, "name": "r", "memoryUsed": 5, "diskUsed": 0}], "stage_details": [{"stageId": 3, "attemptId": 0, "status": "COMPLETE", "tasks": {"7": {"taskId": 7, "executorId": "1", "host": "h", "status": "SUCCESS", "duration": 40, "taskMetrics": {"executorRunTime": 30, "jvmGcTime": 2, "inputMetrics": {"bytesRead": 9}, "shuffleReadMetrics": {"localBytesRead": 1, "remoteBytesRead": 2}, "shuffleWriteMetrics": {"bytesWritten": 4}}}}}]}
    (tmp_path / "s.json").write_text(json.dumps(data, indent=1))
    t = ST.read_status(spark, str(tmp_path))
    assert {n: t[n].count() for n in t} == {"jobs": 1, "stages": 2, "executors": 2, "storage": 1, "tasks": 1, "application": 1, "environment": 1}
    task = t["tasks"].first()
    assert (task.stage_id, task.duration, task.failed, task.input_bytes, task.shuffle_bytes, task.gc_time) == (3, 40, False, 9, 7, 2)
    assert t["environment"].first()["value"] == "1" and t["stages"].first()["app_id"] == "app-2"


def test_cluster_state(spark, tmp_path):
    workers = [{"state": "ALIVE", "cores": 4, "coresused": 1, "memory": 100, "memoryused": 5}, {"state": "DEAD", "cores": 2}]
    (tmp_path / "c.json").write_text(json.dumps({"workers": workers, "activeapps": [{"id": "a"}]}))
    row = ST.cluster_figures(ST.read_cluster_state(spark, str(tmp_path))).first()
    assert tuple(row) == (2, 1, 6, 1, 100, 5, 1, 0)


def test_device_lines(spark, tmp_path):
    lines = ["0, 45, 12, 2048, 15360, 61, 27.50", "1, 97, 92, 14800, 15360, 88, [N/A]", "2, x, 1, 1, 1, 1, 1", "3, 5, 1", "4,1,2,3,4,5,", "5,1,2,3,4,5,bad", ""]
    (tmp_path / "d.csv").write_text("\n".join(lines))
    got = {r["gpu_index"]: r for r in devices.read_device_csv(spark, str(tmp_path)).collect()}
    assert set(got) == {"0", "1", "4", "5"}
    assert got["0"]["power_draw"] == 27.5 and all(got[k]["power_draw"] is None for k in "145")


def test_event_log(spark, tmp_path):
    events = [
        {"Event": "SparkListenerTaskEnd", "Stage ID": 1, "Task Info": {"Task ID": 4, "Executor ID": "2", "Host": "h", "Launch Time": 10, "Finish Time": 35, "Failed": False},
         "Task End Reason": {"Reason": "Success"}, "Task Metrics": {"Executor Run Time": 20, "JVM GC Time": 2, "Result Size": 9}},
        {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 1, "Stage Name": "map", "Number of Tasks": 1, "Submission Time": 1000, "Completion Time": 3000}},
        {"Event": "SparkListenerExecutorAdded", "Timestamp": 500, "Executor ID": "2", "Executor Info": {"Host": "h", "Total Cores": 4}},
        {"Event": "SparkListenerApplicationEnd", "Timestamp": 900},
    ]
    (tmp_path / "app-1").write_text("\n".join(map(json.dumps, events)))
    t = ST.read_event_log(spark, str(tmp_path))
    task = t["tasks"].first()
    assert (task["duration_ms"], task["run_ms"], task["reason"], task["failed"]) == (25, 20, "Success", False)
    assert t["stages"].first()["name"] == "map" and t["executors"].first()["cores"] == 4


def test_npy_blocks(spark, tmp_path):
    a, b = np.arange(12, dtype="float32").reshape(3, 4), np.ones((2, 2, 2))
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", b)
    (tmp_path / "deep").mkdir()
    np.save(tmp_path / "deep" / "a.npy", b)
    (tmp_path / "note.txt").write_text("x")
    got = {(r["file"], r["row_idx"]): list(r["values"]) for r in SG.read_npy(spark, str(tmp_path), 4).collect()}
    assert got["a.npy", 2] == [8.0, 9.0, 10.0, 11.0] and got["b.npy", 1] == [1.0] * 4 and len(got) == 5 + len(b) and got["deep/a.npy", 1] == [1.0] * 4
    with pytest.raises(Exception, match="expected 5"):
        SG.read_npy(spark, str(tmp_path), 5).count()


def test_written_runs_come_back(spark, tmp_path, stored):
    path = str(tmp_path / "out")
    write_runs(stored.drop("_source_file"), path)
    back = R.read_runs(spark, path, "*.json", lines=True).drop("_source_file")
    assert {(r["device_mode"], r["timestamp"]) for r in back.collect()} == {(r["device_mode"], r["timestamp"]) for r in stored.collect()}
    assert back.where("device_mode = 'cpu_only'").first()["partition_details"][1]["samples_processed"] == 20


def test_archive_appends_under_its_time(spark, tmp_path):
    path = str(tmp_path / "arch")
    df = spark.sql("SELECT 1 AS id, TIMESTAMP '2026-07-19 10:00:00' AS ts UNION ALL SELECT 2, TIMESTAMP '2026-07-20 10:00:00'")
    archive(df, path, "ts")
    archive(df.where("id = 2"), path, "ts")
    got = spark.read.parquet(path).groupBy("run_prefix").count().collect()
    assert {(str(r[0]), r[1]) for r in got} == {("20260719", 1), ("20260720", 2)}


def test_pickup_reads_each_file_once(spark, tmp_path):
    landing, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    landing.mkdir()
    for k in range(3):
        (landing / f"r{k}.json").write_text(json.dumps(run("hybrid", f"t{k}", []), indent=1))
        src = jobs.stream_run_files(spark, str(landing)).select("timestamp", "_source_file")
        jobs.run_available(src, out, ckpt)
    assert sorted(r["timestamp"] for r in spark.read.parquet(out).collect()) == ["t0", "t1", "t2"]


def test_good_rows_of_a_damaged_folder(spark, tmp_path):
    import pytest

    from scorelake.sources import runs as R

    (tmp_path / "a.json").write_text('{"run_id": 1, "elapsed_time": 2.0}')
    (tmp_path / "b.json").write_text('{"run_id": 2, "elapsed_')
    (tmp_path / "c.json").write_text('{"run_id": 3, "elapsed_time": "soon"}')
    (tmp_path / "d.json").write_text("null")
    (tmp_path / "e.json").write_text(" \n")
    path = str(tmp_path)
    good = R.read_runs(spark, path, "*.json", damaged="skip").collect()
    assert [(r["run_id"], r["_source_file"]) for r in good] == [(1, "a.json")]
    bad = sorted((r["_source_file"], r["record"]) for r in R.damaged_runs(spark, path, "*.json").collect())
    assert [f for f, _ in bad] == ["b.json", "c.json", "d.json"] and "soon" in bad[1][1] and bad[2][1] == "null"
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        R.read_runs(spark, path, "*.json").collect()
    with pytest.raises(ValueError):
        R.read_runs(spark, path, "*.json", damaged="maybe")


def test_run_records_cross_the_network_as_figures_and_are_stored_compressed(spark, capfd):
    import datetime as dt
    import os

    from pyspark.sql import functions as F

    from scorelake.plans import formats as P
    from scorelake.session import scratch_path

    src = scratch_path(spark, "tables")
    lines = [(r, p, s, 1, float(q), 10.0 * q + p, 0.01, 0.02 * p, "ANR"[q % 3], "O", dt.datetime(2024, 1, 1)) for r in range(12) for p in range(1, 4) for q in range(4) for s in (1, 2) if r != 5]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                          "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{src}/lineitem.parquet")  # fmt: skip
    orders = [(r, "5-LOW", "FOP"[r % 3], 10.0, dt.datetime(2024, 1, 1)) for r in range(12)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderpriority string, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{src}/orders.parquet")
    records = P.run_records(spark, src)
    rows = {r.run_id: r for r in records.collect()}
    assert sorted(rows) == [r for r in range(12) if r != 5]
    assert rows[0].total_samples_processed == 36 and dict(rows[0].per_model_processed) == {"A": 18, "N": 6, "R": 12}
    assert [(t.partition_idx, t.samples_processed, t.device, t.inference_time_sec) for t in sorted(rows[0].partition_details, key=lambda t: t.partition_idx)] == [(p, 12, "A", 120.0 + 8 * p) for p in (1, 2, 3)]
    assert [(t.executor.id, t.total_samples_processed) for t in sorted(rows[2].partition_details, key=lambda t: t.partition_idx)] == [(f"host{p}:1", 12) for p in (1, 2, 3)]
    capfd.readouterr()
    P.run_records(spark, src).explain()
    plan = capfd.readouterr().out
    # Figures once by cell and once by run, beside the runs; tasks are read once.
    assert plan.count("Exchange") <= 4 and plan.count("struct<l_orderkey") == 1
    path = P.stored_runs(spark, src, compression="gzip")
    files = [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert tuple(P.s5_damaged(spark, src).first()) == (9, 48, 2, 0)
