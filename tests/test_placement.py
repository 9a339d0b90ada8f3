"""Placement against a direct loop, also when it takes many rounds."""

import random

import pytest

from scorelake.operators import placement as P


def loop(items, budgets, strategy):
    if strategy in ("largest_first", "balanced"):
        items = sorted(items, key=lambda m: (-m[2], m[1]))
    elif strategy == "priority":
        items = sorted(items, key=lambda m: (-(m[3] or 0), m[1]))
    free, out = {}, {}
    for node, model, size, _ in items:
        f = free.setdefault(node, list(budgets))
        order = range(len(f))
        if strategy == "balanced" and len(f) > 1:
            order = sorted(order, key=lambda d: f[d], reverse=True)
        out[node, model] = "cpu"
        for d in order:
            if f[d] >= size:
                f[d] -= size
                out[node, model] = f"cuda:{d}"
                break
    return out


@pytest.mark.parametrize("strategy", P.STRATEGIES)
@pytest.mark.parametrize("budgets", [[0.0], [60.0], [40.0, 90.0, 40.0]])
@pytest.mark.parametrize("rows_a_batch", [1, 7, 10_000])
def test_equals_loop(spark, strategy, budgets, rows_a_batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    rng = random.Random(7)
    items = [("n%d" % (0 if rng.random() < 0.4 else rng.randrange(1, 4)), k, float(rng.randrange(1, 25)), rng.choice([None, 1.0, 5.0, 9.0])) for k in range(60)]
    df = spark.createDataFrame(items, "node string, model_id bigint, memory_mb double, prio double")
    got = P.plan_placement(df, budgets, strategy, priority="prio").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["node"], r["model_id"]): r["device"] for r in got} == loop(sorted(items, key=lambda m: m[1]), budgets, strategy)
    used = {}
    for r in got:
        if r["device"] != "cpu":
            used[r["node"], r["device"]] = used.get((r["node"], r["device"]), 0) + r["memory_mb"]
    assert all(mb <= budgets[int(d.split(":")[1])] for (_, d), mb in used.items())


@pytest.mark.parametrize("strategy", P.STRATEGIES)
def test_a_node_of_a_hundred_thousand_models(spark, strategy):
    """One node, many devices: the sequential loop's result, in one job."""
    rng = random.Random(11)
    items = [("n", k, float(rng.randrange(1, 900)), rng.choice([None, 1.0, 5.0])) for k in range(100_000)]
    budgets = [float(rng.randrange(5_000, 60_000)) for _ in range(37)]
    df = spark.createDataFrame(items, "node string, model_id bigint, memory_mb double, prio double").repartition(8)
    group = f"placement-{strategy}"
    spark.sparkContext.setJobGroup(group, group)
    got = P.plan_placement(df, budgets, strategy, priority="prio").collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")
    # The shuffle is a job of its own for adaptive execution.
    assert len(jobs) <= 3
    assert {(r["node"], r["model_id"]): r["device"] for r in got} == loop(items, budgets, strategy)


def test_null_nodes_and_sizes_and_other_columns(spark):
    rows = [(None, 1, 5.0, "x"), (None, 2, None, "y"), ("a", 3, 5.0, None), ("a", 3, 5.0, None), ("a", 4, 1.0, "z")]
    df = spark.createDataFrame(rows, "node string, model_id bigint, memory_mb double, device_hint string")
    got = P.plan_placement(df, [6.0, 4.0], "greedy")
    assert got.columns == [*df.columns, "device"]
    found = sorted((r["node"] or "", r["model_id"], r["device"]) for r in got.collect())
    assert found == [("", 1, "cuda:0"), ("", 2, "cpu"), ("a", 3, "cpu"), ("a", 3, "cuda:0"), ("a", 4, "cuda:0")]


def test_no_device(spark):
    df = spark.createDataFrame([("n", 1, 5.0)], "node string, model_id bigint, memory_mb double")
    assert P.plan_placement(df, [], "greedy").first()["device"] == "cpu"


def test_known_registry_budgets(spark):
    from scorelake.operators.registry import known_models, total_memory
    from pyspark.sql import functions as F

    reg = known_models(spark)
    assert total_memory(reg).first()["memory_mb"] == 1970.0
    items = reg.select(F.lit("n").alias("node"), F.col("name").alias("model_id"), F.col("estimated_memory_mb").alias("memory_mb"))
    all_fit = P.placement_totals(P.plan_placement(items, [2500.0], "largest_first")).first()
    assert (all_fit["models_on_gpu"], all_fit["cpu_mb"]) == (10, 0.0)
    mixed = P.placement_totals(P.plan_placement(items, [1500.0], "largest_first")).first()
    assert mixed["gpu_mb"] <= 1500 and mixed["models_on_cpu"] > 0
