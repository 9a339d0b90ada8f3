"""Run records stored as JSON: single runs, run grids and per-mode results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import RESULT_MODES, ok_runs
from ..schemas import MODE_RESULTS, RUN


def _records(spark: SparkSession, path: str, schema: str, glob: str | None, lines: bool = False) -> DataFrame:
    """Records of whole-file JSON documents, or with ``lines`` one per line: the
    layout to prefer at scale, since a file of lines can be split over tasks."""
    reader = spark.read.schema(schema).option("multiLine", str(not lines).lower()).option("mode", "FAILFAST")
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.json(path).withColumn("_source_file", F.col("_metadata.file_name"))


#: Where what is no record is kept, as it stands in its file.
_DAMAGED = "_damaged"


def _judged(spark: SparkSession, path: str, glob: str | None, lines: bool) -> DataFrame:
    """``_source_file``, ``r`` (a run record) and ``record`` (the text of what is none). Whole records are parsed, whichever fields are read later."""
    reader = spark.read.option("wholetext", str(not lines).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    rows = reader.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _DAMAGED}
    record = F.from_json("value", f"{RUN}, {_DAMAGED} string", options)
    judged = rows.select(F.col("_metadata.file_name").alias("_source_file"), "value", record.alias("r"))
    # A JSON null is no record either.
    damaged = F.when(F.col("r").isNull(), F.col("value")).otherwise(F.col(f"r.{_DAMAGED}"))
    return judged.select("_source_file", "r", damaged.alias("record"))


def read_runs(spark: SparkSession, path: str, glob: str | None = "cluster_benchmark_*.json", lines: bool = False, damaged: str = "fail") -> DataFrame:
    """Run records tagged with the name of their file.

    A damaged record ends the read. With ``damaged="skip"`` the good ones of a
    folder are read (one to a file, or to a line); :func:`damaged_runs` has the others.
    """
    if damaged == "fail":
        return _records(spark, path, RUN, glob, lines)
    if damaged != "skip":
        raise ValueError(f"damaged records fail or skip, not {damaged!r}")
    good = _judged(spark, path, glob, lines).where(F.col("record").isNull())
    return good.select("r.*", "_source_file").drop(_DAMAGED)


def damaged_runs(spark: SparkSession, path: str, glob: str | None = "cluster_benchmark_*.json", lines: bool = False) -> DataFrame:
    """``_source_file, record``: what in a folder is no run record, or has a value of another type, as its text."""
    return _judged(spark, path, glob, lines).where(F.col("record").isNotNull()).select("_source_file", "record")


def read_run_grid(spark: SparkSession, path: str, glob: str | None = "incremental_all_modes_*.json", lines: bool = False) -> DataFrame:
    """Files holding an array of records; failed ones are left out."""
    return ok_runs(_records(spark, path, RUN, glob, lines))


def read_mode_results(spark: SparkSession, path: str, glob: str | None = None, lines: bool = False) -> DataFrame:
    """One row per (record, mode) of the per-mode result files; absent modes drop out."""
    wide = _records(spark, path, MODE_RESULTS, glob, lines)
    modes = [F.struct(F.lit(m).alias("result_mode"), F.col(m).alias("r")) for m in RESULT_MODES]
    rows = wide.select("_source_file", "config", "total_benchmark_time", F.inline(F.array(*modes)))
    return rows.where(F.col("r").isNotNull()).select("_source_file", "config", "total_benchmark_time", "result_mode", "r.*")


def model_categories(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Models named in the per-mode result files with category and memory."""
    rows = _records(spark, path, MODE_RESULTS, glob).select(F.explode("models").alias("model", "m"))
    return rows.select("model", "m.*").distinct()


def unify_tasks(runs: DataFrame, keep: list[str]) -> DataFrame:
    """Task rows of run records, whichever of the two shapes a file used."""
    t = runs.select(*keep, F.explode("partition_details").alias("t"))
    first = lambda flat, nested: F.coalesce(F.col(f"t.{flat}"), F.col(f"t.{nested}"))
    by_model = F.coalesce(
        F.col("t.per_model_processed"), F.transform_values("t.per_model", lambda _k, v: v["samples_processed"])
    )
    return t.select(
        *keep,
        F.col("t.partition_idx").alias("partition_idx"),
        first("executor_id", "executor.id").alias("executor_id"),
        first("hostname", "executor.hostname").alias("hostname"),
        first("device", "executor.device").alias("device"),
        first("model_load_time_sec", "timing.model_load_time_sec").alias("load_time"),
        first("inference_time_sec", "timing.total_inference_time_sec").alias("inference_time"),
        first("total_task_time_sec", "timing.total_task_time_sec").alias("task_time"),
        first("samples_processed", "total_samples_processed").alias("samples"),
        by_model.alias("per_model_processed"),
        F.col("t.per_model").alias("per_model"),
    )
