"""Writers: run records, archives, metric batches and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_runs(df: DataFrame, path: str, mode_col: str = "device_mode", compression: str = "none") -> None:
    """Append run records as JSON, one folder per mode. The mode stays in the
    record too, so a file can be read on its own. Compressed files' names end
    as their codec's do (``.json.gz``)."""
    df.withColumn("mode_dir", F.col(mode_col)).write.mode("append").partitionBy("mode_dir").option("compression", compression).json(path)


def archive(df: DataFrame, path: str, ts: str | Column, fmt: str = "parquet", grain: str = "yyyyMMdd") -> None:
    """Append under a time folder, so old data can be pruned by path."""
    when = F.col(ts) if isinstance(ts, str) else ts
    df.withColumn("run_prefix", F.date_format(when, grain)).write.mode("append").partitionBy("run_prefix").format(fmt).save(path)


def write_predictions(df: DataFrame, path: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    """Write from the executors; nothing comes back to the driver."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_blobs(df: DataFrame, path: str, name_col: str = "name", content_col: str = "content") -> DataFrame:
    """Write each row's bytes as a file of its own under ``path``; ``name, length`` of what was written.

    Executors write to any file system that pyarrow opens by the folder's URI.
    Names set the files apart, so a task that runs again writes the same files.
    The rows are written when the result is read; ask for it once.
    """
    import pyarrow as pa

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        for batch in batches:
            for folder in {f"{root}/{n}".rpartition("/")[0] for n in batch.column(0).to_pylist()}:
                store.create_dir(folder, recursive=True)
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in batch.column(1).to_pylist()], pa.int64())], names=["name", "length"])

    return df.select(F.col(name_col).cast("string").alias("name"), F.col(content_col).alias("content")).mapInArrow(run, "name string, length bigint")
