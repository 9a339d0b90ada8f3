"""Device readings stored as seven-field CSV lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a reading in order, and texts that mean "no power reading".
FIELDS = ["gpu_index", "util_gpu", "util_memory", "memory_used", "memory_total", "temperature", "power_draw"]
NO_POWER = ["", "[N/A]", "N/A"]
REQUIRED = FIELDS[1:6]


def parse_device_lines(lines: DataFrame, col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed readings. Lines with another field count are dropped, then rows whose
    required fields are not numbers. A power value that is absent or not a number
    becomes null and the row's other metrics are kept."""
    parts = lines.select(*keep, F.transform(F.split(F.trim(col), ",", -1), lambda p: F.trim(p)).alias("p"))
    fields = parts.where(F.size("p") == len(FIELDS))
    named = fields.select(*keep, *[F.col("p")[i].alias(n) for i, n in enumerate(FIELDS)])
    power = F.when(~F.col("power_draw").isin(NO_POWER), F.col("power_draw").try_cast("double"))
    typed = named.select(*keep, "gpu_index", *[F.col(c).try_cast("double").alias(c) for c in REQUIRED], power.alias("power_draw"))
    return typed.where(" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED))


def read_device_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_device_lines(spark.read.text(path))


def stream_device_csv(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    return parse_device_lines(lines)
