"""Set operations over runs, models and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def distinct_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Each run once by its identity, whichever files carried it."""
    return runs.dropDuplicates(keys)


def model_names(df: DataFrame, modes: list[str], mode: str = "device_mode", name: str = "model") -> DataFrame:
    """Models seen in any of the modes."""
    return df.where(F.col(mode).isin(modes)).select(name).distinct()


def _seen(df: DataFrame, modes: list[str], mode: str, name: str) -> DataFrame:
    return df.groupBy(name).agg(
        *[F.coalesce(F.bool_or(F.col(mode) == m), F.lit(False)).alias(f"_in{i}") for i, m in enumerate(modes)]
    )


def common_models(df: DataFrame, modes: list[str], mode: str = "device_mode", name: str = "model") -> DataFrame:
    """Models seen in every mode: one aggregation instead of chained intersects."""
    out = _seen(df, modes, mode, name)
    for i in range(len(modes)):
        out = out.where(F.col(f"_in{i}"))
    return out.select(name)


def missing_models(df: DataFrame, modes: list[str], mode: str = "device_mode", name: str = "model") -> DataFrame:
    """(mode, model) cells that are empty although the model ran in another mode."""
    out = _seen(df, modes, mode, name)
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias(mode), F.col(f"_in{i}").alias("seen")) for i, m in enumerate(modes)]))
    any_seen = F.greatest(*[F.col(f"_in{i}") for i in range(len(modes))]) if len(modes) > 1 else F.col("_in0")
    rows = out.where(any_seen).select(name, cells.alias("_c"))
    return rows.where(~F.col("_c.seen")).select(F.col(f"_c.{mode}").alias(mode), name)


def prediction_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either set that the other lacks, duplicates counted.

    One aggregation: each row counts up on one side and down on the other.
    """
    cols = a.columns
    signed = a.withColumn("_n", F.lit(1)).unionAll(b.select(cols).withColumn("_n", F.lit(-1)))
    odd = signed.groupBy(*cols).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return odd.select(*cols, F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("_n"))).alias("_i")).drop("_i")


def same_predictions(a: DataFrame, b: DataFrame) -> bool:
    return prediction_differences(a, b).isEmpty()
