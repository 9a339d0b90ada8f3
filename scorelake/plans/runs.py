"""Queries over runs, tasks, executors and models: joins, aggregates, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import quantiles as Q
from ..operators import registry as G
from ..operators import runs as R
from ..operators import sets as S
from ..operators.placement import placement_totals, plan_placement
from ..session import scratch_path
from .catalog import Catalog, rnd, rnd_sql
from .tables import (
    BASELINE_MODE, DEVICES, EXECUTORS, MODELS, MODES, RUNS, TASK_ORDER, TASK_ORDER_SQL, TASKS,
    executors, models, runs, table, tasks,
)

catalog = Catalog()
query = catalog.query


def rounded(df, *cols, digits=4):
    return df.withColumns({c: rnd(c, digits) for c in cols})


def mode_tasks(spark, sf_dir):
    """Tasks with their run's mode: (device_mode, model = category)."""
    m = models(spark, sf_dir).select("model_id", F.col("category").alias("model"))
    r = runs(spark, sf_dir).select("run_id", "device_mode", "error")
    return tasks(spark, sf_dir).join(m, "model_id").join(r, "run_id")


MODE_TASKS = (
    "mode_tasks AS (SELECT tasks.*, category AS model, device_mode, error FROM tasks JOIN models USING (model_id) JOIN runs USING (run_id))"
)
HEAD = f"WITH {RUNS}, {TASKS}, {MODELS}, {EXECUTORS}, {MODE_TASKS}"
RATIO = "CASE WHEN {1} > 0 THEN {0} / {1} ELSE 0 END"


def ratio(a: str, b: str) -> str:
    return RATIO.format(f"({a})::DOUBLE", f"({b})::DOUBLE")


# -- joins


@query("s4_bind_inputs", f"{HEAD}, sizes AS (SELECT category, count(*) AS n_rows, sum(samples)::BIGINT AS samples FROM tasks JOIN models USING (model_id) GROUP BY category) "
       "SELECT model_id, category, node, n_rows, samples FROM models JOIN sizes USING (category)")
def s4(spark, sf_dir):
    m = models(spark, sf_dir)
    sizes = tasks(spark, sf_dir).join(m, "model_id").groupBy("category").agg(F.count("*").alias("n_rows"), F.sum("samples").alias("samples"))
    return J.bind_inputs(sizes, m).select("model_id", "category", "node", "n_rows", "samples")


# A task of a model that no registry has, and a registered model that no task used.
UNKNOWN, UNUSED = -1, -2
USED = f"used AS (SELECT model_id FROM tasks UNION ALL SELECT {UNKNOWN})"
REGISTERED = f"registered AS (SELECT model_id, name, category, memory_mb FROM models UNION ALL SELECT {UNUSED}, 'unused', 'none', 1.0)"


def _used(spark, sf_dir):
    return tasks(spark, sf_dir).select("model_id").unionByName(spark.range(1).select(F.lit(UNKNOWN).cast("bigint").alias("model_id")))


def _registered(spark, sf_dir):
    unused = spark.range(1).select(F.lit(UNUSED).cast("bigint").alias("model_id"), F.lit("unused").alias("name"), F.lit("none").alias("category"), F.lit(1.0).alias("memory_mb"))
    return models(spark, sf_dir).select("model_id", "name", "category", "memory_mb").unionByName(unused)


@query("j1_models_with_inputs", f"{HEAD}, {USED}, {REGISTERED}, sizes AS (SELECT model_id, count(*) AS n_rows FROM used GROUP BY model_id) SELECT model_id, memory_mb, n_rows FROM registered JOIN sizes USING (model_id)")
def j1(spark, sf_dir):
    sizes = _used(spark, sf_dir).groupBy("model_id").agg(F.count("*").alias("n_rows"))
    return J.bind_inputs(sizes, _registered(spark, sf_dir), "model_id").select("model_id", "memory_mb", "n_rows")


@query("j2_models_with_data", f"{HEAD}, {USED}, {REGISTERED} SELECT model_id, name FROM registered WHERE model_id IN (SELECT model_id FROM used)")
def j2(spark, sf_dir):
    return J.models_with_data(_registered(spark, sf_dir), _used(spark, sf_dir), "model_id").select("model_id", "name")


@query("j3_models_without_data", f"{HEAD}, {USED}, {REGISTERED} SELECT model_id, name FROM registered WHERE model_id NOT IN (SELECT model_id FROM used)")
def j3(spark, sf_dir):
    return J.models_without_data(_registered(spark, sf_dir), _used(spark, sf_dir), "model_id").select("model_id", "name")


@query("j4_registry_lookup", f"{HEAD}, {USED}, {REGISTERED} SELECT coalesce(category, 'other') AS category, coalesce(memory_mb, 0) AS memory_mb, count(*) AS tasks "
       "FROM used LEFT JOIN registered USING (model_id) GROUP BY 1, 2")
def j4(spark, sf_dir):
    out = J.with_registry(_used(spark, sf_dir), _registered(spark, sf_dir), "model_id", {"category": "other", "memory_mb": 0.0})
    return out.groupBy("category", "memory_mb").agg(F.count("*").alias("tasks"))


# The last mode isn't declared, so its tasks are the other ones.
DECLARED = MODES[:-1]


def _cells(mode: str) -> str:
    return f"sum(samples) FILTER (WHERE device_mode = '{mode}')"


@query("j5_mode_matrix", f"{HEAD} SELECT model_id, " + ", ".join(f"coalesce(CAST({_cells(m)} AS VARCHAR), '-') AS \"{m}\"" for m in DECLARED)
       + f", coalesce(CAST({_cells(MODES[-1])} AS VARCHAR), '-') AS other FROM mode_tasks GROUP BY model_id")
def j5(spark, sf_dir):
    return J.mode_matrix(mode_tasks(spark, sf_dir), "model_id", "device_mode", F.col("samples"), DECLARED)


@query("u6_pivot_modes", f"{HEAD} SELECT model, " + ", ".join(f"{_cells(m)}::BIGINT AS \"{m}\"" for m in DECLARED) + f", {_cells(MODES[-1])}::BIGINT AS other FROM mode_tasks GROUP BY model")
def u6(spark, sf_dir):
    return J.pivot_modes(mode_tasks(spark, sf_dir), "model", "device_mode", "samples", DECLARED)


BANDS = [(1000.0, "small"), (30000.0, "medium"), (60000.0, "large"), (None, "xlarge")]


@query("j6_size_bands", f"{HEAD} SELECT CASE WHEN inference_time <= 1000 THEN 'small' WHEN inference_time <= 30000 THEN 'medium' "
       "WHEN inference_time <= 60000 THEN 'large' ELSE 'xlarge' END AS band, count(*) AS tasks FROM tasks GROUP BY 1")
def j6(spark, sf_dir):
    return J.with_band(tasks(spark, sf_dir), "inference_time", BANDS).groupBy("band").agg(F.count("*").alias("tasks"))


@query("j6_band_table", f"{HEAD}, bands AS (SELECT o_orderkey AS band_id, o_totalprice / 5 AS low, o_totalprice / 5 * (1 + (o_custkey % 50) / 10000.0) AS high FROM orders) "
       f"SELECT band_id, count(*) AS tasks, {rnd_sql('sum(inference_time)', 2)} AS total_time FROM bands JOIN tasks ON inference_time >= low AND inference_time < high GROUP BY band_id")
def j6_table(spark, sf_dir):
    """Bands as a table, one for each order: overlapping, of many widths."""
    low = F.col("o_totalprice") / 5
    bands = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("band_id"), low.alias("low"), (low * (1 + (F.col("o_custkey") % 50) / F.lit(10000.0))).alias("high"))
    found = J.in_bands(tasks(spark, sf_dir).select("inference_time"), "inference_time", bands, by=["band_id"])
    return found.select("band_id", F.col("n").alias("tasks"), rnd("total", 2).alias("total_time"))


@query("j7_align_batches", f"""{HEAD}, sizes AS (SELECT model_id, sum(samples)::BIGINT AS n_rows FROM tasks GROUP BY model_id),
batches AS (SELECT model_id, n_rows, unnest(range(CAST(ceil(n_rows / 16.0) AS BIGINT))) AS batch_idx FROM sizes)
SELECT batch_idx, count(DISTINCT model_id) AS models, sum(least(16, n_rows - batch_idx * 16))::BIGINT AS rows FROM batches GROUP BY batch_idx""")
def j7(spark, sf_dir):
    sizes = tasks(spark, sf_dir).groupBy("model_id").agg(F.sum("samples").alias("n_rows"))
    return J.align_batches(sizes, 16)


@query("j8_dense_grid", f"{HEAD}, named AS (SELECT model_id, samples, CASE WHEN device_mode = '{MODES[-1]}' THEN 'other' ELSE device_mode END AS device_mode FROM mode_tasks), "
       f"grid AS (SELECT DISTINCT model_id, unnest([{', '.join(repr(m) for m in [*MODES[:-1], 'other'])}]) AS device_mode FROM named) "
       "SELECT grid.model_id, grid.device_mode, count(named.samples) AS tasks, coalesce(sum(named.samples), 0)::BIGINT AS samples "
       "FROM grid LEFT JOIN named ON grid.model_id = named.model_id AND grid.device_mode = named.device_mode GROUP BY ALL")
def j8(spark, sf_dir):
    return J.dense_grid(mode_tasks(spark, sf_dir), "model_id", "device_mode", DECLARED, {"tasks": F.count("*"), "samples": F.sum("samples")})


def run_tp(spark, sf_dir):
    ok = runs(spark, sf_dir).where(F.col("error").isNull())
    return R.run_throughput(tasks(spark, sf_dir), ok)


RUN_TP = (
    "run_tp AS (SELECT r.*, coalesce(t.samples, 0)::BIGINT AS samples, CASE WHEN elapsed_time > 0 THEN coalesce(t.samples, 0) / elapsed_time ELSE 0 END AS throughput "
    "FROM runs r LEFT JOIN (SELECT run_id, sum(samples)::BIGINT AS samples FROM tasks GROUP BY run_id) t USING (run_id) WHERE error IS NULL)"
)
TP = f"{HEAD}, {RUN_TP}"


@query("j9_vs_baseline_mode", f"{TP}, m AS (SELECT device_mode, sum(samples) / sum(elapsed_time) AS tp FROM run_tp GROUP BY device_mode) "
       f"SELECT device_mode, {rnd_sql('tp / (SELECT tp FROM m WHERE device_mode = ' + repr(BASELINE_MODE) + ')')} AS speedup FROM m")
def j9(spark, sf_dir):
    by_mode = run_tp(spark, sf_dir).groupBy("device_mode").agg((F.sum("samples") / F.sum("elapsed_time")).alias("tp"))
    return J.vs_baseline(by_mode, "device_mode", "tp", BASELINE_MODE).select("device_mode", rnd("speedup").alias("speedup"))


@query("a10_speedup_vs_baseline", f"{TP}, m AS (SELECT device_mode, max(throughput) AS tp FROM run_tp GROUP BY device_mode) "
       f"SELECT device_mode, {rnd_sql('tp')} AS peak, {rnd_sql('tp / (SELECT tp FROM m WHERE device_mode = ' + repr(BASELINE_MODE) + ')')} AS speedup FROM m")
def a10(spark, sf_dir):
    peaks = R.peak_by_mode(run_tp(spark, sf_dir), MODES)
    out = J.vs_baseline(peaks, "device_mode", "peak", BASELINE_MODE)
    return out.select("device_mode", rnd("peak").alias("peak"), rnd("speedup").alias("speedup"))


@query("j10_task_star", f"{HEAD} SELECT site, device_mode, device, count(*) AS tasks, sum(samples)::BIGINT AS samples, {rnd_sql('sum(inference_time)', 2)} AS inference_time "
       "FROM tasks JOIN runs USING (run_id) JOIN executors USING (executor_id) GROUP BY ALL")
def j10(spark, sf_dir):
    star = J.task_star(tasks(spark, sf_dir), runs(spark, sf_dir), executors(spark, sf_dir))
    out = star.groupBy("site", "device_mode", "device").agg(
        F.count("*").alias("tasks"), F.sum("samples").alias("samples"), F.sum("inference_time").alias("inference_time")
    )
    return rounded(out, "inference_time", digits=2)


# -- aggregates


@query("a1_samples_per_model", f"{HEAD} SELECT device AS model, sum(samples)::BIGINT AS samples FROM tasks GROUP BY device")
def a1(spark, sf_dir):
    # Each run carries a small map of samples per device class, as run records do.
    per = tasks(spark, sf_dir).groupBy("run_id", "device").agg(F.sum("samples").alias("n"))
    maps = per.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("device", "n"))).alias("per_model_processed"))
    return R.samples_per_model(R.samples_from_maps(maps))


@query("a2_samples_with_total", f"{HEAD} SELECT CASE WHEN grouping(model_id) = 1 THEN 'TOTAL' ELSE CAST(model_id AS VARCHAR) END AS model, sum(samples)::BIGINT AS samples "
       "FROM tasks GROUP BY ROLLUP (model_id)")
def a2(spark, sf_dir):
    return R.samples_per_model(tasks(spark, sf_dir).withColumnRenamed("model_id", "model"), total=True)


@query("a4_run_throughput", f"{TP} SELECT run_id, samples, {rnd_sql('throughput', 8)} AS throughput FROM run_tp")
def a4(spark, sf_dir):
    return run_tp(spark, sf_dir).select("run_id", "samples", rnd("throughput", 8).alias("throughput"))


@query("a5_executor_summary", f"{HEAD} SELECT executor_id, first(device ORDER BY {TASK_ORDER_SQL}) AS device, {rnd_sql(f'first(load_time ORDER BY {TASK_ORDER_SQL})')} AS load_time, count(*) AS tasks, "
       f"sum(samples)::BIGINT AS samples, {rnd_sql('sum(inference_time)', 2)} AS inference_time, {rnd_sql(ratio('sum(samples)', 'sum(inference_time)'), 8)} AS throughput FROM tasks GROUP BY executor_id")
def a5(spark, sf_dir):
    out = R.executor_summary(tasks(spark, sf_dir), TASK_ORDER)
    return rounded(rounded(rounded(out, "load_time"), "inference_time", digits=2), "throughput", digits=8)


@query("a6_host_summary", f"{HEAD} SELECT hostname, count(*) AS tasks, sum(samples)::BIGINT AS samples FROM tasks JOIN executors USING (executor_id) GROUP BY hostname")
def a6(spark, sf_dir):
    return R.host_summary(tasks(spark, sf_dir).join(executors(spark, sf_dir), "executor_id"))


@query("a7_model_throughput", f"{HEAD} SELECT model_id AS model, sum(samples)::BIGINT AS samples, {rnd_sql('sum(inference_time)', 2)} AS inference_time, "
       f"{rnd_sql(ratio('sum(samples)', 'sum(inference_time)'), 8)} AS throughput, first(cached ORDER BY {TASK_ORDER_SQL}) AS cached FROM tasks GROUP BY model_id")
def a7(spark, sf_dir):
    out = R.model_throughput(tasks(spark, sf_dir).withColumn("model", F.col("model_id")), TASK_ORDER, ["cached"])
    return rounded(rounded(out, "inference_time", digits=2), "throughput", digits=8)


LISTED = [*MODES[:3], "6-NONE"]


@query("a8_peak_by_mode", f"{TP}, listed AS (SELECT unnest([{', '.join(repr(m) for m in LISTED)}]) AS device_mode) SELECT device_mode, {rnd_sql('coalesce(max(throughput), 0)', 8)} AS peak FROM listed LEFT JOIN run_tp USING (device_mode) GROUP BY device_mode")
def a8(spark, sf_dir):
    return rounded(R.peak_by_mode(run_tp(spark, sf_dir), LISTED), "peak", digits=8)


@query("a9_peak_ratio", f"{TP}, p AS (SELECT max(throughput) FILTER (WHERE device_mode = '1-URGENT') AS a, max(throughput) FILTER (WHERE device_mode = '2-HIGH') AS b FROM run_tp) "
       f"SELECT {rnd_sql('a', 8)} AS peak_a, {rnd_sql('b', 8)} AS peak_b, {rnd_sql('a / b', 8)} AS speedup FROM p")
def a9(spark, sf_dir):
    return rounded(R.gpu_cpu_speedup(run_tp(spark, sf_dir), "1-URGENT", "2-HIGH"), "peak_a", "peak_b", "speedup", digits=8)


_MODE_TP = {n: m for n, m in zip(("candidate", "single", "batched", "loader"), MODES)}


@query("a11_best_baseline", f"{HEAD}, t AS (SELECT model_id, " + ", ".join(f"coalesce(sum(samples) FILTER (WHERE device_mode = '{m}'), 0) AS {n}" for n, m in _MODE_TP.items())
       + " FROM mode_tasks GROUP BY model_id) SELECT model_id, greatest(single, batched, loader)::BIGINT AS best_baseline, "
       + ", ".join(f"CAST(round(CAST(CAST({ratio('candidate', b)} AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) AS {n}" for n, b in
                   {"vs_best": "greatest(single, batched, loader)", "vs_single": "single", "vs_batched": "batched"}.items()) + " FROM t")
def a11(spark, sf_dir):
    per = mode_tasks(spark, sf_dir).groupBy("model_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("device_mode") == m, F.col("samples"))), F.lit(0)).alias(n) for n, m in _MODE_TP.items()]
    )
    out = R.best_baseline(per, "candidate", "single", "batched", "loader")
    return out.select("model_id", "best_baseline", "vs_best", "vs_single", "vs_batched")


@query("a12_batch_latency", f"{HEAD} SELECT device, count(*) AS n, {rnd_sql('avg(inference_time) * 1000')} AS avg_ms, {rnd_sql('quantile_cont(inference_time, 0.99) * 1000')} AS p99_ms FROM tasks GROUP BY device")
def a12(spark, sf_dir):
    return rounded(R.latency(tasks(spark, sf_dir), ["device"], "inference_time"), "avg_ms", "p99_ms")


@query("a12_batch_latency_overall", f"{HEAD} SELECT count(*) AS n, {rnd_sql('avg(inference_time) * 1000')} AS avg_ms, {rnd_sql('quantile_cont(inference_time, 0.99) * 1000')} AS p99_ms FROM tasks")
def a12_all(spark, sf_dir):
    return rounded(R.latency(tasks(spark, sf_dir), [], "inference_time"), "avg_ms", "p99_ms")


@query("a13_sample_latency", f"{HEAD} SELECT device, {rnd_sql('avg(inference_time / 64.0 * 1000)')} AS sample_ms FROM tasks GROUP BY device")
def a13(spark, sf_dir):
    out = tasks(spark, sf_dir).groupBy("device").agg(F.avg(R.sample_latency_ms("inference_time", 64)).alias("sample_ms"))
    return rounded(out, "sample_ms")


# The sketch's own promise is compared: its value's true rank is within the
# stated error. One row per device, all true.
@query("a14_latency_approx", f"{HEAD} SELECT device, true AS within_bound FROM tasks GROUP BY device")
def a14(spark, sf_dir):
    t = tasks(spark, sf_dir)
    sketch = R.latency_approx(t, ["device"], "inference_time")
    ranks = t.join(sketch, "device").groupBy("device").agg(
        F.count("*").alias("n"), F.count_if(F.col("inference_time") * 1000 < F.col("p99_ms")).alias("below"),
        F.count_if(F.col("inference_time") * 1000 <= F.col("p99_ms")).alias("upto"),
    )
    slack = F.col("n") / 10_000 + 1
    return ranks.select("device", ((F.col("below") <= 0.99 * F.col("n") + slack) & (F.col("upto") >= 0.99 * F.col("n") - slack)).alias("within_bound"))


_SKETCHED = {"p25": 0.25, "median": 0.5, "p99": 0.99}
_DAYS = "d AS (SELECT l_returnflag AS mode, l_shipdate AS day, l_extendedprice AS v FROM lineitem)"


@query("a14_stored_sketches", f"WITH {_DAYS}, r AS (SELECT mode, v, (row_number() OVER (PARTITION BY mode ORDER BY v) - 0.5) / count(*) OVER (PARTITION BY mode) AS rank FROM d) "
       "SELECT mode, count(*) AS n, " + ", ".join(f"round(min(rank) FILTER (WHERE rank >= {q}), 2) AS {n}_rank" for n, q in _SKETCHED.items()) + " FROM r GROUP BY mode")
def a14_stored(spark, sf_dir):
    """Sketches stored per day and mode, merged per mode; the exact ranks of what they say, as numbers to two digits."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_shipdate").alias("day"), F.col("l_extendedprice").alias("v"))
    path = scratch_path(spark, "sketches")
    Q.sketch_values(rows, ["mode", "day"], "v").write.parquet(path)
    said = Q.merged_percentiles(spark.read.parquet(path), ["mode"], _SKETCHED)
    ranks = rows.join(said, "mode").groupBy("mode", "n").agg(*[(F.count_if(F.col("v") <= F.col(n)) / F.col("n")).alias(n) for n in _SKETCHED])
    return ranks.select("mode", "n", *[F.round(n, 2).alias(f"{n}_rank") for n in _SKETCHED])


@query("a15_extrapolated_time", f"{TP} SELECT run_id, {rnd_sql(f'elapsed_time * ' + RATIO.format('samples::DOUBLE', 'least(samples, 20)'))} AS full_time, "
       f"{rnd_sql(RATIO.format('1000.0', 'throughput'), 2)} AS amortized_ms FROM run_tp")
def a15(spark, sf_dir):
    return run_tp(spark, sf_dir).select(
        "run_id", rnd(R.extrapolate("elapsed_time", "samples", 20)).alias("full_time"), rnd(R.amortized_ms("throughput"), 2).alias("amortized_ms")
    )


@query("a16_task_share", f"{HEAD} SELECT executor_id, device, count(*) AS tasks, {rnd_sql('count(*) / (SELECT count(*) FROM tasks)::DOUBLE', 8)} AS share FROM tasks GROUP BY executor_id, device")
def a16(spark, sf_dir):
    return rounded(R.task_share(tasks(spark, sf_dir), ["executor_id", "device"]), "share", digits=8)


@query("a17_latest_run", f"{HEAD} SELECT device_mode, run_id, run_ts, elapsed_time FROM runs SEMI JOIN tasks USING (run_id) QUALIFY row_number() OVER (PARTITION BY device_mode ORDER BY run_ts DESC, run_id DESC) = 1")
def a17(spark, sf_dir):
    r = runs(spark, sf_dir).join(tasks(spark, sf_dir), "run_id", "left_semi").select("device_mode", "run_id", "run_ts", "elapsed_time")
    return R.latest(r, ["run_ts", "run_id"], ["device_mode"])


@query("k3_latest_view", f"{HEAD} SELECT run_id, device_mode, run_ts FROM runs ORDER BY run_ts DESC, run_id DESC LIMIT 1")
def k3(spark, sf_dir):
    return R.latest(runs(spark, sf_dir).select("run_id", "device_mode", "run_ts"), ["run_ts", "run_id"])


@query("l4_latest_application", f"{HEAD} SELECT model_id, run_id, ts FROM tasks QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY ts DESC, run_id DESC) = 1")
def l4(spark, sf_dir):
    return R.latest(tasks(spark, sf_dir).select("model_id", "run_id", "ts"), ["ts", "run_id"], ["model_id"])


@query("a18_device_set", f"{HEAD} SELECT run_id, string_agg(DISTINCT device, ',' ORDER BY device) AS devices FROM tasks GROUP BY run_id")
def a18(spark, sf_dir):
    return R.device_set(tasks(spark, sf_dir))


@query("a21_registry_memory", f"{HEAD} SELECT category, count(*) AS models, sum(memory_mb) AS memory_mb FROM models GROUP BY category")
def a21(spark, sf_dir):
    return G.total_memory(models(spark, sf_dir), "category", "memory_mb")


@query("a21_registry_memory_total", f"{HEAD} SELECT count(*) AS models, sum(memory_mb) AS memory_mb FROM models")
def a21_total(spark, sf_dir):
    return G.total_memory(models(spark, sf_dir), memory="memory_mb")


@query("a22_memory_share", f"{HEAD} SELECT model_id, {rnd_sql('memory_mb * 100 / (SELECT sum(memory_mb) FROM models)', 8)} AS share_pct FROM models")
def a22(spark, sf_dir):
    return G.memory_share(models(spark, sf_dir), "memory_mb").select("model_id", rnd("share_pct", 8).alias("share_pct"))


@query("a23_memory_need", f"{HEAD} SELECT node, {rnd_sql('sum(memory_mb * 1.2) + sum(512 * 4.0) * 256 / 1048576.0 + sum(priority) * 256 / 1048576.0 + 400', 6)} AS need_mb FROM models GROUP BY node")
def a23(spark, sf_dir):
    out = G.memory_need(models(spark, sf_dir), 256, F.lit(512 * 4.0), F.col("priority"), ["node"], "memory_mb")
    return rounded(out, "need_mb", digits=6)


@query("a26_overhead", f"{HEAD}, t AS (SELECT run_id, sum(inference_time) AS i, sum(samples) AS s FROM tasks GROUP BY run_id) SELECT run_id, {rnd_sql('elapsed_time - i', 2)} AS overhead, "
       f"{rnd_sql('(elapsed_time - i) * 100 / elapsed_time')} AS overhead_pct, {rnd_sql(ratio('s', 'i'), 8)} AS executor_throughput, {rnd_sql(ratio('s', 'elapsed_time'), 8)} AS overall_throughput FROM runs JOIN t USING (run_id)")
def a26(spark, sf_dir):
    out = R.overhead(tasks(spark, sf_dir), runs(spark, sf_dir))
    out = rounded(rounded(rounded(out, "overhead", digits=2), "overhead_pct"), "executor_throughput", "overall_throughput", digits=8)
    return out.select("run_id", "overhead", "overhead_pct", "executor_throughput", "overall_throughput")


@query("a27_bottleneck", f"{HEAD}, t AS (SELECT run_id, executor_id, {rnd_sql('sum(inference_time)', 2)} AS inference_time FROM tasks GROUP BY ALL) "
       "SELECT run_id, executor_id, inference_time FROM t QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY inference_time DESC, executor_id) = 1")
def a27(spark, sf_dir):
    return rounded(R.bottleneck(tasks(spark, sf_dir)), "inference_time", digits=2)


@query("a27_bottleneck_host_ids", f"{HEAD}, t AS (SELECT run_id, 'host' || (executor_id % 7) || '_' || executor_id AS executor_id, sum(samples)::DOUBLE AS inference_time FROM tasks GROUP BY ALL) "
       "SELECT run_id, executor_id, inference_time FROM t QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY inference_time DESC, executor_id) = 1")
def a27_hosts(spark, sf_dir):
    """Executor ids as run records have them, ``<host>_<pid>``, with many ties."""
    host = F.concat(F.lit("host"), (F.col("executor_id") % 7).cast("string"), F.lit("_"), F.col("executor_id").cast("string"))
    named = tasks(spark, sf_dir).select("run_id", host.alias("executor_id"), F.col("samples").cast("double").alias("inference_time"))
    return R.bottleneck(named)


@query("a28_scaling_efficiency", f"{HEAD}, pts AS (SELECT device, partition_idx AS workers, sum(samples) / sum(load_time) AS throughput FROM tasks GROUP BY ALL), "
       f"s AS (SELECT device, workers, throughput / (SELECT throughput FROM pts b WHERE b.device = p.device AND b.workers = 1) AS speedup FROM pts p) "
       f"SELECT device, workers, {rnd_sql('speedup', 6)} AS speedup, {rnd_sql('speedup / workers', 6)} AS efficiency FROM s")
def a28(spark, sf_dir):
    points = tasks(spark, sf_dir).groupBy("device", F.col("partition_idx").alias("workers")).agg((F.sum("samples") / F.sum("load_time")).alias("throughput"))
    out = R.scaling_efficiency(points, keys=["device"])
    return rounded(out, "speedup", "efficiency", digits=6).drop("throughput")


@query("a29_evenness", f"{HEAD}, t AS (SELECT run_id, {ratio('samples', 'inference_time')} AS tp FROM tasks) SELECT run_id, {rnd_sql('min(tp)', 8)} AS min_tp, {rnd_sql('max(tp)', 8)} AS max_tp, "
       f"{rnd_sql(ratio('min(tp)', 'max(tp)'), 8)} AS evenness FROM t GROUP BY run_id")
def a29(spark, sf_dir):
    return rounded(R.evenness(tasks(spark, sf_dir), ["run_id"]), "min_tp", "max_tp", "evenness", digits=8)


@query("a31_placement_totals", f"{HEAD} SELECT node, count(*) FILTER (WHERE memory_mb <= 25) AS models_on_gpu, count(*) FILTER (WHERE memory_mb > 25) AS models_on_cpu, "
       "coalesce(sum(memory_mb) FILTER (WHERE memory_mb <= 25), 0) AS gpu_mb, coalesce(sum(memory_mb) FILTER (WHERE memory_mb > 25), 0) AS cpu_mb FROM models GROUP BY node")
def a31(spark, sf_dir):
    placed = models(spark, sf_dir).withColumn("device", F.when(F.col("memory_mb") <= 25, "cuda:0").otherwise("cpu"))
    return placement_totals(placed, ["node"])


@query("a32_failures", f"{HEAD} SELECT device_mode, status, count(*) AS runs, count(error) AS failed FROM runs GROUP BY ALL")
def a32(spark, sf_dir):
    return R.failures(runs(spark, sf_dir), ["device_mode", "status"])


_QS = {"min": 0.0, "p25": 0.25, "median": 0.5, "max": 1.0}


@query("a33_task_quantiles", f"{HEAD} SELECT run_id, " + ", ".join(
    f"{rnd_sql(f'quantile_cont({c}, {q})')} AS {c}_{n}" for c in ("inference_time", "load_time") for n, q in _QS.items()) + " FROM tasks GROUP BY run_id")
def a33(spark, sf_dir):
    out = R.task_quantiles(tasks(spark, sf_dir), ["run_id"], ["inference_time", "load_time"])
    return rounded(out, *[c for c in out.columns if c != "run_id"])


@query("a34_run_health", f"{HEAD}, t AS (SELECT run_id, max(inference_time) AS mx, min(inference_time) AS mn, sum(load_time * 10000) AS gc, sum(inference_time) AS total, max(samples * 2) AS mem, "
       "count(*) FILTER (WHERE device = 'R') AS failed, count(*) FILTER (WHERE cached = 'O') AS sh FROM tasks GROUP BY run_id) "
       f"SELECT run_id, {rnd_sql(ratio('mx', 'mn'), 6)} AS skew, {rnd_sql(ratio('gc', 'total'), 6)} AS gc_share, mem::DOUBLE AS memory_pct, failed AS failed_tasks, "
       "CASE WHEN mn > 0 THEN mx / mn ELSE 0 END > 3 AS is_skewed, CASE WHEN total > 0 THEN gc / total ELSE 0 END > 0.2 AS is_gc_bound, mem > 90 AS is_memory_bound, failed > 0 AS has_failures, sh > 0 AS has_shuffle FROM t")
def a34(spark, sf_dir):
    t = tasks(spark, sf_dir).select(
        "run_id", F.col("inference_time").alias("duration"), (F.col("load_time") * 10000).alias("gc_time"),
        (F.col("device") == "R").alias("failed"), F.when(F.col("cached") == "O", 1).otherwise(0).alias("shuffle_bytes"),
        (F.col("samples") * 2.0).alias("mem"),
    )
    out = R.run_health(t, ["run_id"], F.col("mem"))
    return rounded(out, "skew", "gc_share", digits=6)


# -- sets


@query("u1_all_runs", f"{HEAD} SELECT status, count(*) AS n, count(error) AS failed, count(run_number) AS numbered FROM (SELECT status, error, NULL AS run_number FROM runs WHERE status <> 'F' UNION ALL SELECT status, error, run_id FROM runs) GROUP BY status")
def u1(spark, sf_dir):
    r = runs(spark, sf_dir)
    single = r.where(F.col("status") != "F").drop("error")
    both = S.all_runs(single, r.withColumn("run_number", F.col("run_id")))
    return both.groupBy("status").agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.count("run_number").alias("numbered"))


@query("u2_distinct_runs", f"{HEAD} SELECT DISTINCT device_mode, run_ts FROM runs")
def u2(spark, sf_dir):
    r = runs(spark, sf_dir).select("device_mode", "run_ts")
    return S.distinct_runs(S.all_runs(r, r), ["device_mode", "run_ts"])


@query("u3_model_names", f"{HEAD} SELECT DISTINCT model_id FROM mode_tasks WHERE device_mode IN ('1-URGENT', '5-LOW')")
def u3(spark, sf_dir):
    return S.model_names(mode_tasks(spark, sf_dir), ["1-URGENT", "5-LOW"], name="model_id")


def _in_mode(m: str) -> str:
    return f"SELECT model_id FROM seen WHERE device_mode = '{m}'"


# All tasks, and a model that ran in one mode only.
SEEN = f"seen AS (SELECT model_id, device_mode FROM mode_tasks UNION ALL SELECT {UNUSED}, '{MODES[0]}')"


def _seen(spark, sf_dir):
    once = spark.range(1).select(F.lit(UNUSED).cast("bigint").alias("model_id"), F.lit(MODES[0]).alias("device_mode"))
    return mode_tasks(spark, sf_dir).select("model_id", "device_mode").unionByName(once)


@query("u4_common_models", f"{HEAD}, {SEEN} " + " INTERSECT ".join(_in_mode(m) for m in MODES))
def u4(spark, sf_dir):
    return S.common_models(_seen(spark, sf_dir), MODES, name="model_id")


@query("u4_missing_models", f"{HEAD}, {SEEN} " + " UNION ALL ".join(
    f"SELECT '{m}' AS device_mode, model_id FROM (SELECT model_id FROM seen EXCEPT {_in_mode(m)})" for m in MODES))
def u4_missing(spark, sf_dir):
    return S.missing_models(_seen(spark, sf_dir), MODES, name="model_id")


# -- placement


def _first_fit_sql(order: str, devices: int, pick: str) -> str:
    free = "[" + ", ".join(["200.0::DOUBLE"] * devices) + "]"
    return f"""WITH RECURSIVE {MODELS}, o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {order}) AS rn FROM models),
walk AS (
  SELECT node, 0::BIGINT AS rn, NULL::BIGINT AS model_id, -1 AS dev, {free} AS free FROM (SELECT DISTINCT node FROM models)
  UNION ALL
  SELECT node, rn, model_id, dev, list_transform(free, lambda f, i: CASE WHEN i = dev + 1 THEN f - memory_mb ELSE f END)
  FROM (SELECT o.node, o.rn, o.model_id, o.memory_mb, w.free, {pick} AS dev FROM walk w JOIN o ON o.node = w.node AND o.rn = w.rn + 1)
)
SELECT node, model_id, CASE WHEN dev >= 0 THEN 'cuda:' || dev ELSE 'cpu' END AS device FROM walk WHERE rn > 0"""


FIRST_ROOM = "coalesce(list_position(list_transform(w.free, lambda f: f >= o.memory_mb), true), 0) - 1"
EMPTIEST = "CASE WHEN list_max(w.free) >= o.memory_mb THEN list_position(w.free, list_max(w.free)) - 1 ELSE -1 END"


@query("w10_placement_largest_first", _first_fit_sql("memory_mb DESC, model_id", 1, FIRST_ROOM))
def w10_largest(spark, sf_dir):
    return plan_placement(models(spark, sf_dir), [200.0], "largest_first").select("node", "model_id", "device")


@query("w10_placement_priority", _first_fit_sql("priority DESC, model_id", 2, FIRST_ROOM))
def w10_priority(spark, sf_dir):
    return plan_placement(models(spark, sf_dir), [200.0, 200.0], "priority", priority="priority").select("node", "model_id", "device")


@query("w10_placement_greedy", _first_fit_sql("model_id", 2, FIRST_ROOM))
def w10_greedy(spark, sf_dir):
    return plan_placement(models(spark, sf_dir), [200.0, 200.0], "greedy").select("node", "model_id", "device")


@query("w10_placement_balanced", _first_fit_sql("memory_mb DESC, model_id", 3, EMPTIEST))
def w10_balanced(spark, sf_dir):
    return plan_placement(models(spark, sf_dir), [200.0, 200.0, 200.0], "balanced").select("node", "model_id", "device")
