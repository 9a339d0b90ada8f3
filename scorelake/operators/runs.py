"""Aggregates over runs, tasks and executors.

Expected columns: tasks(run_id, partition_idx, executor_id, hostname, device,
model, samples, inference_time, load_time); runs(run_id, device_mode, status,
error, elapsed_time, run_ts). Every aggregate combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio
from .quantiles import approx_percentiles, exact_percentiles
from .segments import null_safe_join


def samples_from_maps(tasks: DataFrame, col: str = "per_model_processed") -> DataFrame:
    """Unfold each task's model -> samples map to (model, samples) rows."""
    return tasks.select(F.explode(col).alias("model", "samples"))


def samples_per_model(tasks: DataFrame, total: bool = False) -> DataFrame:
    """Samples per model; with ``total`` a TOTAL row is added by the rollup."""
    summed = F.sum("samples").alias("samples")
    if not total:
        return tasks.groupBy("model").agg(summed)
    rolled = tasks.rollup("model").agg(summed, F.grouping("model").alias("_g"))
    return rolled.select(
        F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col("model").cast("string")).alias("model"),
        F.coalesce("samples", F.lit(0)).alias("samples"),
    )


def accuracy(preds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Correct over count, merged as sums; never a mean of means."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("n_correct")]
    out = preds.groupBy(*(keys or [])).agg(*sums)
    return out.withColumns({"n_correct": F.coalesce("n_correct", F.lit(0)), "accuracy": safe_ratio("n_correct", "n")})


def run_throughput(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Total samples over wall time per run; a run without tasks has 0 samples."""
    per_run = tasks.groupBy("run_id").agg(F.sum("samples").alias("samples"))
    joined = runs.join(per_run, "run_id", "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    return joined.withColumn("throughput", safe_ratio("samples", "elapsed_time"))


def executor_summary(tasks: DataFrame, first_by: list[str], keys: list[str] | None = None) -> DataFrame:
    """Device, tasks, samples, inference time, first load time and throughput.

    ``first_by`` orders an executor's tasks; device and load time are the first
    task's.
    """
    out = tasks.groupBy(*(keys or ["executor_id"])).agg(
        F.min_by(F.struct("device", "load_time"), F.struct(*first_by)).alias("_first"),
        F.count(F.lit(1)).alias("tasks"),
        F.sum("samples").alias("samples"),
        F.sum("inference_time").alias("inference_time"),
    )
    return out.select(
        *(keys or ["executor_id"]),
        F.col("_first.device").alias("device"),
        F.col("_first.load_time").alias("load_time"),
        "tasks",
        "samples",
        "inference_time",
        safe_ratio("samples", "inference_time").alias("throughput"),
    )


def host_summary(tasks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return tasks.groupBy(*(keys or ["hostname"])).agg(F.count(F.lit(1)).alias("tasks"), F.sum("samples").alias("samples"))


def model_throughput(tasks: DataFrame, first_by: list[str], shapes: list[str] | None = None) -> DataFrame:
    """Samples over time per model; ``shapes`` columns come from the first task."""
    firsts = [F.min_by(F.struct(*shapes), F.struct(*first_by)).alias("_first")] if shapes else []
    out = tasks.groupBy("model").agg(F.sum("samples").alias("samples"), F.sum("inference_time").alias("inference_time"), *firsts)
    out = out.withColumn("throughput", safe_ratio("samples", "inference_time"))
    return out.select("model", "samples", "inference_time", "throughput", *[f"_first.{c}" for c in shapes or []])


def peak_by_mode(run_tp: DataFrame, modes: list[str]) -> DataFrame:
    """Peak throughput of each listed mode, 0 for a mode without runs."""
    peaks = [F.coalesce(F.max(F.when(F.col("device_mode") == m, F.col("throughput"))), F.lit(0.0)) for m in modes]
    row = run_tp.agg(F.array(*[F.struct(F.lit(m).alias("device_mode"), p.alias("peak")) for m, p in zip(modes, peaks)]).alias("_m"))
    return row.select(F.inline("_m"))


def peak_ratio(run_tp: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """Ratio of two modes' peaks, 0 when the second is 0 or absent."""
    peaks = {n: F.max(F.when(F.col("device_mode") == m, F.col("throughput"))) for n, m in (("peak_a", numerator), ("peak_b", denominator))}
    out = run_tp.agg(*[F.coalesce(p, F.lit(0.0)).alias(n) for n, p in peaks.items()])
    return out.withColumn("speedup", safe_ratio("peak_a", "peak_b"))


gpu_cpu_speedup = peak_ratio


def best_baseline(df: DataFrame, candidate: str, single: str, batched: str, loader: str) -> DataFrame:
    """Best of three baselines and the candidate's speedup over each, 2 decimals."""
    out = df.withColumn("best_baseline", F.greatest(single, batched, loader))
    ratios = {"vs_best": "best_baseline", "vs_single": single, "vs_batched": batched}
    return out.withColumns({n: F.round(safe_ratio(candidate, b), 2) for n, b in ratios.items()})


def latency(df: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """Mean and exact p99 of a batch time, in ms; 0 when there are no batches."""
    means = df.groupBy(*by).agg(F.count(seconds).alias("n"), (F.avg(seconds) * 1000).alias("avg_ms"))
    p99 = exact_percentiles(df, by, seconds, {"p99": 0.99})
    if by:
        out = null_safe_join(means, p99, by, "left")
    else:
        out = means.withColumn("p99", p99.select("p99").scalar())
    return out.select(
        *by, "n", F.coalesce("avg_ms", F.lit(0.0)).alias("avg_ms"), F.coalesce(F.col("p99") * 1000, F.lit(0.0)).alias("p99_ms")
    )


def latency_approx(df: DataFrame, by: list[str], seconds: str) -> DataFrame:
    return approx_percentiles(df.withColumn("_ms", F.col(seconds) * 1000), by, "_ms", {"p99_ms": 0.99})


def sample_latency_ms(seconds: Column | str, batch_size: int) -> Column:
    """Per-sample ms of a batch; a short last batch is still divided by the size."""
    value = F.col(seconds) if isinstance(seconds, str) else seconds
    return value / F.lit(batch_size) * 1000


def extrapolate(seconds: str, n: str, cap: int) -> Column:
    """Time for all ``n`` rows, from the time of the first ``min(n, cap)``."""
    return F.col(seconds) * safe_ratio(F.col(n), F.least(F.col(n), F.lit(cap)))


def amortized_ms(throughput: str) -> Column:
    return safe_ratio(F.lit(1000.0), throughput)


def task_share(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks per key over all runs and their share of the total."""
    counts = tasks.groupBy(*keys).agg(F.count(F.lit(1)).alias("tasks"))
    total = counts.agg(F.sum("tasks")).scalar()
    return counts.withColumn("share", safe_ratio("tasks", total))


def latest(df: DataFrame, order: list[str], key: list[str] | None = None) -> DataFrame:
    """Last row in ``order`` (per key): a mergeable maximum, not a sort."""
    fields = [c for c in df.columns if c not in (key or [])]
    best = F.max_by(F.struct(*fields), F.struct(*order)).alias("_last")
    return df.groupBy(*(key or [])).agg(best).select(*(key or []), "_last.*")


def device_set(tasks: DataFrame, key: str = "run_id") -> DataFrame:
    """Distinct devices per run, sorted and comma joined."""
    devices = F.array_join(F.array_sort(F.collect_set("device")), ",")
    return tasks.select(key, "device").distinct().groupBy(key).agg(devices.alias("devices"))


def failures(runs: DataFrame, by: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def overhead(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Wall time not spent on inference, its percent, and throughput of the
    inference part against the whole run."""
    per_run = tasks.groupBy("run_id").agg(F.sum("inference_time").alias("inference_time"), F.sum("samples").alias("samples"))
    out = runs.join(per_run, "run_id", "inner").withColumn("overhead", F.col("elapsed_time") - F.col("inference_time"))
    return out.withColumns(
        {
            "overhead_pct": safe_ratio(F.col("overhead") * 100, "elapsed_time"),
            "executor_throughput": safe_ratio("samples", "inference_time"),
            "overall_throughput": safe_ratio("samples", "elapsed_time"),
        }
    )


def bottleneck(tasks: DataFrame) -> DataFrame:
    """Slowest executor of each run by summed inference time (ties: lowest id)."""
    times = tasks.groupBy("run_id", "executor_id").agg(F.sum("inference_time").alias("inference_time"))
    # Ids may be numbers or ``<host>_<pid>`` strings: only times are negated.
    worst = F.min(F.struct((-F.col("inference_time")).alias("t"), "executor_id"))
    return times.groupBy("run_id").agg(worst.alias("_w")).select("run_id", "_w.executor_id", (-F.col("_w.t")).alias("inference_time"))


def scaling_efficiency(points: DataFrame, workers: str = "workers", throughput: str = "throughput", keys: list[str] | None = None) -> DataFrame:
    """Actual speedup over the one-worker point, divided by the ideal one."""
    keys = keys or []
    base = points.where(F.col(workers) == 1)
    if keys:
        base = base.groupBy(*keys).agg(F.max(throughput).alias("_one"))
        joined = null_safe_join(points, base, keys, "left")
    else:
        joined = points.withColumn("_one", base.agg(F.max(throughput)).scalar())
    speedup = safe_ratio(throughput, "_one")
    return joined.withColumns({"speedup": speedup, "efficiency": safe_ratio(speedup, workers)}).drop("_one")


def evenness(tasks: DataFrame, by: list[str]) -> DataFrame:
    """Lowest and highest task throughput and their ratio (1 = even)."""
    tp = tasks.withColumn("_tp", safe_ratio("samples", "inference_time"))
    out = tp.groupBy(*by).agg(F.min("_tp").alias("min_tp"), F.max("_tp").alias("max_tp"))
    return out.withColumn("evenness", safe_ratio("min_tp", "max_tp"))


def task_quantiles(tasks: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Min, quartile, median and max of each column per stage."""
    wanted = {"min": 0.0, "p25": 0.25, "median": 0.5, "max": 1.0}
    # The columns become rows, so all of them share one pass.
    values = F.inline(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_value")) for c in cols]))
    found = exact_percentiles(tasks.select(*by, values), [*by, "_col"], "_value", wanted)
    return found.groupBy(*by).agg(
        *[F.max(F.when(F.col("_col") == c, F.col(n))).alias(f"{c}_{n}") for c in cols for n in wanted]
    )


def run_health(tasks: DataFrame, by: list[str], memory_pct: Column | None = None) -> DataFrame:
    """Health flags of a run: skew, GC share, memory, failures, shuffle.

    Tasks need duration, gc_time, failed and shuffle_bytes columns.
    """
    out = tasks.groupBy(*by).agg(
        F.max("duration").alias("_max"),
        F.min("duration").alias("_min"),
        F.sum("gc_time").alias("_gc"),
        F.sum("duration").alias("_sum"),
        F.sum(F.col("failed").cast("long")).alias("failed_tasks"),
        F.sum("shuffle_bytes").alias("_shuffle"),
        F.max(memory_pct if memory_pct is not None else F.lit(0.0)).alias("memory_pct"),
    )
    return out.select(
        *by,
        safe_ratio("_max", "_min").alias("skew"),
        safe_ratio("_gc", "_sum").alias("gc_share"),
        "memory_pct",
        "failed_tasks",
        (safe_ratio("_max", "_min") > 3).alias("is_skewed"),
        (safe_ratio("_gc", "_sum") > 0.2).alias("is_gc_bound"),
        (F.col("memory_pct") > 90).alias("is_memory_bound"),
        (F.col("failed_tasks") > 0).alias("has_failures"),
        (F.col("_shuffle") > 0).alias("has_shuffle"),
    )
