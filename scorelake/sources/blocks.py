"""Array blocks of any size: a data source that splits ``.npy`` files into row ranges.

Only headers are read to plan the scan: shape and type say where each row starts,
so a block of any number of gigabytes is read by many tasks, each seeking to its
own rows and holding a slice of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "npy_blocks"
#: Bytes of a task's range, and of what it holds at a time.
RANGE_BYTES, SLICE_BYTES = 64 << 20, 4 << 20
SCHEMA = "file string, row_idx bigint, values array<float>"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class RowRange(InputPartition):
    """Rows ``first`` to ``first + rows`` of a file whose data begin at byte ``offset``."""

    path: str
    name: str
    dtype: str
    width: int
    offset: int
    first: int
    rows: int

    def __post_init__(self) -> None:
        super().__init__((self.path, self.first))


class _Header:
    """Bytes of a file as far as they were asked for, for numpy's own header reader."""

    def __init__(self, stream) -> None:
        self.stream, self.read_bytes = stream, 0

    def read(self, n: int) -> bytes:
        out = self.stream.read(n)
        self.read_bytes += len(out)
        return bytes(out)


def read_header(stream, name: str) -> tuple[np.dtype, int, int, int]:
    """Type, rows, values of a row, and where the data begin."""
    head = _Header(stream)
    version = np.lib.format.read_magic(head)
    reader = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = reader(head)
    if dtype.hasobject or dtype.kind not in "fiub":
        raise ValueError(f"{name}: values of type {dtype} are no numbers")
    if not shape:
        raise ValueError(f"{name}: a single value has no rows")
    width = int(np.prod(shape[1:], dtype=np.int64))
    if by_column and width > 1 and shape[0] > 1:
        raise ValueError(f"{name}: stored by columns, rows are not in one piece")
    return dtype, int(shape[0]), width, head.read_bytes


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.dims = options["path"].rstrip("/"), int(options["dims"])
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[RowRange]:
        from pyarrow import fs

        store, root = _open(self.path)
        out = []
        for info in sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            name = info.path.removeprefix(root).lstrip("/")
            if info.type != fs.FileType.File or not name.endswith(".npy") or name.rpartition("/")[2].startswith(("_", ".")):
                continue
            with store.open_input_stream(info.path) as stream:
                dtype, rows, width, offset = read_header(stream, name)
            if width != self.dims:
                raise ValueError(f"{name}: rows have {width} values, expected {self.dims}")
            if info.size < offset + rows * width * dtype.itemsize:
                raise ValueError(f"{name}: ends before its last row")
            step = max(1, self.range_bytes // max(1, width * dtype.itemsize))
            out += [RowRange(info.path, name, dtype.str, width, offset, at, min(step, rows - at)) for at in range(0, rows, step)]
        # A folder without blocks is a table without rows.
        return out or [RowRange("", "", "<f4", self.dims, 0, 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        store, _ = _open(self.path)
        dtype = np.dtype(partition.dtype)
        row_bytes = partition.width * dtype.itemsize
        step = max(1, SLICE_BYTES // max(1, row_bytes))
        with store.open_input_file(partition.path) as file:
            for at in range(partition.first, partition.first + partition.rows, step):
                n = min(step, partition.first + partition.rows - at)
                raw = file.read_at(n * row_bytes, partition.offset + at * row_bytes)
                values = np.frombuffer(raw, dtype=dtype).astype("float32")
                offsets = pa.array(np.arange(0, (n + 1) * partition.width, partition.width or 1, dtype="int32")[: n + 1] if partition.width else np.zeros(n + 1, dtype="int32"))
                arrays = [pa.array([partition.name] * n), pa.array(np.arange(at, at + n, dtype="int64")), pa.ListArray.from_arrays(offsets, pa.array(values))]
                yield pa.RecordBatch.from_arrays(arrays, names=["file", "row_idx", "values"])


class NpyBlocks(DataSource):
    """``format("npy_blocks")`` with options ``path``, ``dims`` and ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_blocks(spark: SparkSession, path: str, dims: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, row_idx, values`` of all ``.npy`` files below a folder, on any file system that pyarrow opens by its URI.

    ``file`` is the path from the folder on. Files of any size are read in ranges
    of about ``range_bytes``; each row has ``dims`` numbers, of whatever shape.
    """
    spark.dataSource.register(NpyBlocks)
    return spark.read.format(FORMAT).option("path", path).option("dims", dims).option("range_bytes", range_bytes).load()
