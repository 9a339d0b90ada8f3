"""Alerts, metric batches, dimensions and the guard on shared folders."""

import pytest
from pyspark.sql import functions as F

from scorelake.operators import telemetry as T
from scorelake.session import scratch_path


def test_alert_limits(spark):
    df = spark.createDataFrame([("gpu_utilization", 49.9), ("gpu_utilization", 50.0), ("gpu_temperature", 85.0), ("gpu_temperature", 85.1), ("task_failures", 1.0), ("other", 1.0)], "metric string, value double")
    got = T.alerts(df, T.threshold_frame(spark))
    assert sorted((r["metric"], r["value"]) for r in got.collect()) == [("gpu_temperature", 85.1), ("gpu_utilization", 49.9), ("task_failures", 1.0)]


def test_metric_batches_are_full_but_the_last(spark):
    got = T.with_metric_batches(spark.range(2500), [F.col("id").asc()]).groupBy("batch_no").count().collect()
    assert {r[0]: r[1] for r in got} == {0: 1000, 1: 1000, 2: 500}


def test_publishing_never_exceeds_the_batch(spark, tmp_path):
    folder = str(tmp_path)

    def put(batch):
        import uuid

        assert len(batch) <= 300
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(batch)))

    T.publish_metrics(spark.range(1000).repartition(2), put, size=300)
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 1000


def test_optional_metrics_are_left_out(spark):
    df = spark.createDataFrame([(1.0, None)], "util_gpu double, power_draw double").selectExpr(
        "util_gpu", "util_gpu AS util_memory", "util_gpu AS memory_used", "util_gpu AS memory_total", "CAST(NULL AS DOUBLE) AS temperature", "power_draw"
    )
    got = {r["metric_name"]: r["value"] for r in T.to_metrics(df, T.DEVICE_METRICS, []).collect()}
    assert "GpuPowerDrawWatts" not in got and got["GpuTemperatureC"] == 0.0 and len(got) == 5


def test_scratch_paths_are_fresh(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_empty_rollup(spark):
    workers = spark.createDataFrame([], "state string, cores int, coresused int, memory bigint, memoryused bigint")
    assert tuple(T.cluster_rollup(workers).first()) == (0, 0, 0, 0, 0, 0)


@pytest.mark.parametrize("period", ["1 minute", "5 minutes"])
def test_dashboard_periods(spark, period):
    df = spark.sql("SELECT 'm' AS metric, CAST(id AS DOUBLE) AS value, TIMESTAMP '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, id * 30) AS ts FROM range(20)")
    rows = T.dashboard(df, period, ["metric"]).collect()
    assert sum(r["n"] for r in rows) == 20 and len(rows) == (10 if period == "1 minute" else 2)
