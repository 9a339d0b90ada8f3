"""Token ids in directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level k of a segment holds the
k-th chunk of every id that has one, in order, and a bitmap with a bit for each
that says whether the id goes on in level k+1. A rank directory counts the bits
before every 512th one, so the place of an id's next chunk is one directory
entry and at most 64 bytes away: any token is read without decoding others.

One segment is one file image: a header, then for each level the chunks, the
bitmap and the directory. It holds whole documents. Images are written by Spark
as rows of a Parquet table beside the documents they hold, because that is what
every store takes, what is committed whole when executors are lost, and what a
reader can prune by document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoder, prepare, slices, text_or_empty

MAGIC = b"DAC1"
CHUNK_BITS, RANK_BITS = 8, 512
#: A segment is closed by the document with which it reaches so many tokens.
SEGMENT_TOKENS = 1 << 18

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint32)


def pack_segment(ids: np.ndarray) -> bytes:
    """The file image of a sequence of unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % (RANK_BITS // 8)))
        ones = _POPCOUNT[bitmap].reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint64)
        before = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else np.empty(0)
        levels.append(((rest & 0xFF).astype(np.uint8).tobytes(), bitmap.tobytes(), before.astype("<u8").tobytes()))
        rest = more[goes_on]
        if not len(rest):
            break
    head = MAGIC + struct.pack("<QI", len(ids), len(levels))
    sizes = b"".join(struct.pack("<QQQ", *map(len, level)) for level in levels)
    return head + sizes + b"".join(part for level in levels for part in level)


class Segment:
    """A file image opened for reading; nothing is decoded before it is asked for."""

    def __init__(self, image: bytes) -> None:
        if image[:4] != MAGIC:
            raise ValueError("not a segment")
        self.n, count = struct.unpack_from("<QI", image, 4)
        at = 16 + 24 * count
        self.levels = []
        for k in range(count):
            parts = []
            for size, kind in zip(struct.unpack_from("<QQQ", image, 16 + 24 * k), ("u1", "u1", "<u8"), strict=True):
                parts.append(np.frombuffer(image, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
                at += size
            self.levels.append(parts)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """Token ``i``, by one step per level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, before) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            full = bitmap[block * RANK_BITS // 8 : i >> 3]
            last = int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(before[block]) + int(_POPCOUNT[full].sum()) + int(_POPCOUNT[last])
        return value

    def ids(self) -> np.ndarray:
        """All tokens at once."""
        value = np.zeros(self.n, dtype="<u4")
        at = np.arange(self.n)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value[at] |= chunks.astype("<u4") << np.uint32(CHUNK_BITS * k)
            at = at[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return value


def write_token_files(
    docs: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    segment_tokens: int = SEGMENT_TOKENS,
) -> None:
    """Encode every text, append ``end_id`` to each, and write segments in ascending order of ``id_col``.

    A null text is an empty one (just the end id); a null document id comes
    first; rows that share an id are ordered by a hash of their text. Columns of
    the written table: ``part`` and ``seg`` give the order of the images,
    ``doc_ids`` and ``doc_tokens`` what an image holds, ``image`` its bytes.
    One range exchange; an image grows past ``segment_tokens`` only by its last document.
    """
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    by = ["doc_id", "_tie"]
    ordered = narrow.withColumn("_tie", F.xxhash64("text")).repartitionByRange(*by).sortWithinPartitions(*by)
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"part int, seg int, first_doc {id_type}, doc_ids array<{id_type}>, doc_tokens array<bigint>, image binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seg = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(4, "little")
        names: list = []
        pieces: list[bytes] = []
        held, id_arrow = 0, None

        def close() -> pa.RecordBatch:
            sizes = [len(p) // 4 for p in pieces]
            image = pack_segment(np.frombuffer(b"".join(pieces), dtype="<u4"))
            ids = pa.array(names, id_arrow)
            columns = [[part], [seg], ids[:1], pa.array([ids.to_pylist()], pa.list_(id_arrow)), [sizes], [image]]
            kinds = [pa.int32(), pa.int32(), id_arrow, None, pa.list_(pa.int64()), pa.binary()]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            id_arrow = batch.column(0).type
            for few in slices(batch):
                for name, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                    names.append(name)
                    pieces.append(encode(text) + end)
                    held += len(pieces[-1]) // 4
                    if held >= segment_tokens:
                        yield close()
                        seg, held = seg + 1, 0
                        names.clear()
                        pieces.clear()
        if names:
            yield close()

    ordered.select("doc_id", "text").mapInArrow(run, schema).write.parquet(out)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the written images: ``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit).

    ``start`` is the number of ids of all documents before it. Totals of the
    parts (as many as the writer had tasks) give each part's offset; within a
    part, segments are summed in order.
    """
    return _read(spark, path, "ids binary", lambda raw: raw)


def digest_token_files(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_token_files`, with the unsigned CRC-32 of the ids in place of them."""
    return _read(spark, path, "ids_crc32 bigint", zlib.crc32)


def _read(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    prepare(spark)
    stored = spark.read.parquet(path)
    id_type = stored.schema["first_doc"].dataType.simpleString()
    sizes = stored.select("part", "seg", F.aggregate("doc_tokens", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n"))
    within = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    # As many rows as the writing job had tasks, two integers each.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_part_start"))
    starts = sizes.withColumn("_seg_start", F.coalesce(F.sum("n").over(within), F.lit(0)))
    starts = starts.join(parts, "part").select("part", "seg", (F.col("_seg_start") + F.col("_part_start")).alias("_start"))
    schema = f"part int, seg int, doc_id {id_type}, _local bigint, n_tokens bigint, {column}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch, 1):
                part, seg, ids, tokens = (few.column(k)[0] for k in range(4))
                raw = Segment(few.column(4)[0].as_py()).ids().tobytes()
                ends = np.cumsum(tokens.values.to_numpy(zero_copy_only=False))
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                values = [value(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(values)
                made = pa.array(values, pa.binary() if column.endswith("binary") else pa.int64())
                arrays = [pa.repeat(part, n), pa.repeat(seg, n), ids.values, pa.array(begins), tokens.values, made]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    opened = stored.select("part", "seg", "doc_ids", "doc_tokens", "image").mapInArrow(run, schema)
    value_name = column.split()[0]
    return opened.join(starts, ["part", "seg"]).select("doc_id", (F.col("_local") + F.col("_start")).alias("start"), "n_tokens", value_name)
