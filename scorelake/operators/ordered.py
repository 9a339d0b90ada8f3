"""Ordered logic over runs and tasks, safe for keys that hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import duration_s, safe_ratio
from .quantiles import exact_percentiles
from .segments import lag_over, null_safe_join, rank_values, running_before, with_row_index


def chunk_of(idx: Column | str, n: Column, p: int) -> Column:
    """Chunk of row ``idx``: even chunks, the last takes the remainder, and with
    fewer rows than chunks everything lands in the last one."""
    i = F.col(idx) if isinstance(idx, str) else idx
    size = F.floor(n / F.lit(p))
    return F.when(size > 0, F.least(F.floor(i / size), F.lit(p - 1))).otherwise(F.lit(p - 1)).cast("int")


def chunk(df: DataFrame, order: list[Column], p: int) -> DataFrame:
    """Contiguous chunks in ``order``; adds ``row_idx`` and ``chunk``."""
    indexed = with_row_index(df, order)
    n = df.agg(F.count(F.lit(1))).scalar()
    return indexed.withColumn("chunk", chunk_of("row_idx", n, p))


def cold_warm(tasks: DataFrame, first_by: list[str], key: str = "executor_id") -> DataFrame:
    """First load on each executor against the mean of its later loads.

    Only the first row and sums are needed, so this is one mergeable aggregate
    rather than a numbered window.
    """
    out = tasks.groupBy(key).agg(
        F.min_by("load_time", F.struct(*first_by)).alias("cold_load"),
        F.sum("load_time").alias("_sum"),
        F.count("load_time").alias("_n"),
    )
    # A first load that wasn't measured is none of the loads that were counted.
    measured = F.when(F.col("cold_load").isNotNull(), 1).otherwise(0)
    warm = safe_ratio(F.col("_sum") - F.coalesce("cold_load", F.lit(0.0)), F.col("_n") - measured)
    return out.select(key, "cold_load", warm.alias("warm_load"), safe_ratio("cold_load", warm).alias("cold_warm_ratio"))


def throughput_curve(points: DataFrame, order: list[str], mode: str = "device_mode", throughput: str = "throughput") -> DataFrame:
    """Points of a mode by load, with the change from the previous point."""
    out = lag_over(points, [mode], [F.col(c) for c in order], {"prev_throughput": throughput})
    return out.withColumn("change", F.col(throughput) - F.col("prev_throughput"))


def rank_runs(runs: DataFrame, mode: str = "device_mode", value: str = "throughput") -> DataFrame:
    """Rank and dense rank of every run within its mode, best first."""
    return null_safe_join(runs, rank_values(runs, [mode], value), [mode, value])


def top_runs(runs: DataFrame, k: int, order: list[Column], mode: str = "device_mode") -> DataFrame:
    """Best ``k`` runs per mode. Spark keeps only k rows per key and task before
    the shuffle, because the row number is limited right away."""
    numbered = runs.withColumn("rn", F.row_number().over(Window.partitionBy(mode).orderBy(*order)))
    return numbered.where(F.col("rn") <= k)


def number_runs(runs: DataFrame, order: list[Column]) -> DataFrame:
    return with_row_index(runs, order).withColumn("run_number", F.col("row_idx") + 1).drop("row_idx")


def heartbeat_gaps(beats: DataFrame, limit_s: float, key: str = "executor_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Reports that came more than ``limit_s`` after the previous one."""
    out = lag_over(beats, [key], [F.col(ts), F.col(tie)], {"prev_ts": ts})
    return out.withColumn("gap_s", duration_s("prev_ts", ts)).where(F.col("gap_s") > limit_s)


def stragglers(tasks: DataFrame, by: list[str], duration: str, factor: float = 1.5) -> DataFrame:
    """Tasks slower than ``factor`` times their stage's exact median."""
    medians = exact_percentiles(tasks, by, duration, {"median_time": 0.5})
    return null_safe_join(tasks, medians, by).where(F.col(duration) > F.col("median_time") * factor)


def regressions(runs: DataFrame, order: list[Column], ratio: float = 0.8, mode: str = "device_mode", value: str = "throughput") -> DataFrame:
    """Runs below ``ratio`` times the best earlier run of their mode."""
    out = running_before(runs, [mode], order, value)
    return out.where(F.col(value) < F.col("prev_max") * ratio).withColumnRenamed("prev_max", "baseline").drop("prev_n", "prev_sum")


def first_stages(stages: DataFrame, order: list[Column], n: int = 20) -> DataFrame:
    return stages.orderBy(*order).limit(n)


def sorted_by(df: DataFrame, *cols) -> DataFrame:
    return df.orderBy(*cols)
