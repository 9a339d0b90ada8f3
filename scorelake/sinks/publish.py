"""Metric batches published once: a data source writer that stages, then commits.

Tasks write their batches under a name of this write, where nothing else looks.
Only when all tasks of the write (or micro-batch) are done does the driver move
the batches of the attempts that counted to the published folder and set the
batch's mark. A task that fails and runs again leaves staged files that are never
moved; a micro-batch that is replayed after its mark was set adds nothing; one
whose commit was cut short starts its moves again. The driver moves names only.

Tasks that are killed late can leave staged files; nothing reads them, and the
usual retention of the folder may delete them.

The folder can be on any file system that pyarrow opens by its URI.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter

from ..operators.telemetry import METRIC_BATCH

FORMAT = "metric_batches"
_STAGED, PUBLISHED, _MARKS = "_staged", "published", "_marks"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _plain(value):
    return value.isoformat() if isinstance(value, (dt.datetime, dt.date)) else value


@dataclass
class Staged(WriterCommitMessage):
    """The files of a task's successful attempt."""

    write_id: str
    partition: int
    files: list[str]
    rows: int


class _Stage:
    """What both writers share; ``name`` sets the files of a batch apart from those of others."""

    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"].rstrip("/"), int(options.get("batch_size", METRIC_BATCH))
        self.write_id = uuid.uuid4().hex

    def stage(self, rows: Iterator) -> Staged:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = _open(self.path)
        folder = f"{root}/{_STAGED}/{self.write_id}/{context.partitionId()}-{context.taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        files, held, total = [], [], 0

        def send() -> None:
            nonlocal held
            files.append(f"{folder}/{len(files)}.json")
            with store.open_output_stream(files[-1]) as out:
                out.write("".join(json.dumps(r) + "\n" for r in held).encode())
            held = []

        for row in rows:
            held.append({k: _plain(v) for k, v in row.asDict(recursive=True).items()})
            total += 1
            if len(held) == self.size:
                send()
        if held:
            send()
        return Staged(self.write_id, context.partitionId(), files, total)

    def publish(self, messages: list[Staged | None], name: str) -> None:
        from pyarrow import fs

        store, root = _open(self.path)
        mark, folder = f"{root}/{_MARKS}/{name}", f"{root}/{PUBLISHED}/batch={name}"
        if store.get_file_info(mark).type == fs.FileType.NotFound:
            # What an interrupted commit of this batch has moved is moved anew.
            if store.get_file_info(folder).type != fs.FileType.NotFound:
                store.delete_dir(folder)
            store.create_dir(folder, recursive=True)
            for message in messages:
                for i, file in enumerate(message.files if message else ()):
                    store.move(file, f"{folder}/{message.partition}-{i}.json")
            store.create_dir(f"{root}/{_MARKS}", recursive=True)
            with store.open_output_stream(mark) as out:
                out.write(str(sum(m.rows for m in messages if m)).encode())
        self.discard(messages)

    def discard(self, messages: list[Staged | None]) -> None:
        """Delete what attempts that don't count have staged. Tasks can have got another copy of the writer than the driver."""
        from pyarrow import fs

        store, root = _open(self.path)
        for write_id in {self.write_id, *[m.write_id for m in messages if m]}:
            if store.get_file_info(f"{root}/{_STAGED}/{write_id}").type != fs.FileType.NotFound:
                store.delete_dir(f"{root}/{_STAGED}/{write_id}")


class _BatchWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.stage = _Stage(options)

    def write(self, iterator: Iterator) -> Staged:
        return self.stage.stage(iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        self.stage.publish(messages, self.stage.write_id)

    def abort(self, messages: list[Staged | None]) -> None:
        self.stage.discard(messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict) -> None:
        self.stage = _Stage(options)

    def write(self, iterator: Iterator) -> Staged:
        return self.stage.stage(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self.stage.publish(messages, str(batchId))

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self.stage.discard(messages)


class MetricBatches(DataSource):
    """``format("metric_batches")`` with options ``path`` and ``batch_size`` (rows of a batch at most)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(dict(self.options))


def publish(df: DataFrame, path: str, size: int = METRIC_BATCH) -> None:
    """Publish all rows of ``df`` under ``path`` in batches of at most ``size`` rows, all of them or none."""
    df.sparkSession.dataSource.register(MetricBatches)
    df.write.format(FORMAT).option("path", path).option("batch_size", size).mode("append").save()


def publish_stream(df: DataFrame, path: str, checkpoint: str, size: int = METRIC_BATCH) -> DataStreamWriter:
    """Publish each micro-batch once, whatever fails and is run again. One checkpoint belongs to one ``path``."""
    df.sparkSession.dataSource.register(MetricBatches)
    writer = df.writeStream.format(FORMAT).option("path", path).option("batch_size", size)
    return writer.option("checkpointLocation", checkpoint)


def read_published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all published batches, with their file's place in the batch left out."""
    return spark.read.schema(schema).json(f"{path}/{PUBLISHED}")
