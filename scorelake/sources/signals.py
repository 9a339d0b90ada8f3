"""Signal tables, array blocks and stored blobs as DataFrames or streams."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import to_array, wide_names
from ..schemas import SIGNALS

_BLOCK_ROWS = 4096


def read_signals(spark: SparkSession, path: str, schema: str = SIGNALS, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def wide_schema(n: int, id_col: str = "sample_id") -> str:
    """Schema of the wide layout: id, ``i_*``, ``q_*``, label and names."""
    values = ", ".join(f"{c} float" for c in wide_names(n))
    return f"{id_col} int, {values}, label bigint, class_name string, category string"


def read_wide_signals(spark: SparkSession, path: str, n: int = 128, fmt: str = "csv", id_col: str = "sample_id") -> DataFrame:
    reader = spark.read.schema(wide_schema(n, id_col)).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return to_array(reader.load(path), wide_names(n))


def unpack_npy(files: DataFrame, dims: int) -> DataFrame:
    """Rows of ``.npy`` blocks held in (path, content): (file, row_idx, values), ``file`` being the path.
    One block is at most 2 GB; its rows leave the task a slice at a time."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                block = block.reshape(len(block), -1).astype("float32")
                if block.shape[1] != dims:
                    raise ValueError(f"{name}: rows have {block.shape[1]} values, expected {dims}")
                for at in range(0, len(block), _BLOCK_ROWS):
                    part = block[at : at + _BLOCK_ROWS]
                    offsets = pa.array(np.arange(0, (len(part) + 1) * dims, dims, dtype="int32"))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(part)),
                            pa.array(np.arange(at, at + len(part), dtype="int64")),
                            pa.ListArray.from_arrays(offsets, pa.array(part.ravel())),
                        ],
                        ["file", "row_idx", "values"],
                    )

    return files.select("path", "content").mapInArrow(unpack, "file string, row_idx bigint, values array<float>")


def read_npy(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """A folder of ``.npy`` blocks, and those below it, as rows; ``file`` is the path from the folder on."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    root = path.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    rows = unpack_npy(files, dims)
    after = F.substring_index("file", root, -1)
    return rows.withColumn("file", F.when(F.instr("file", root) > 0, after).otherwise(F.col("file")))


def read_blobs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Stored files as (path, length, content); decode in the scoring batch."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return files.load(path).select("path", "length", "content")


def stream_signals(spark: SparkSession, path: str, schema: str = SIGNALS, max_files: int = 100, fmt: str = "parquet", glob: str | None = None) -> DataFrame:
    """Signals arriving as files, at most ``max_files`` per micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, schema: str = SIGNALS) -> DataFrame:
    """Signals as JSON messages on a topic; needs the Kafka connector on the classpath."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def stream_socket(spark: SparkSession, host: str, port: int, schema: str = SIGNALS) -> DataFrame:
    """Signals as JSON lines on a socket; for trials, the source cannot replay."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.from_json("value", schema).alias("m")).select("m.*")
