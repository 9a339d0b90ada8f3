"""Concatenate and cut.

All documents' ids, one after another, are cut into windows of equal length. The
first pass encodes each document once, stores its ids with the place it has
among its partition's tokens, and so gives each partition's total; the prefix
sums of the totals (one row per partition) turn local places into global ones.
The second pass cuts: a document that crosses a window border leaves a boundary
record, one piece on either side. No exchange of tokens: the order is that of
the stored partitions. Only the last sequence can be short.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import encoder, prepare, slices, text_or_empty

SEQUENCE_TOKENS = 4096


def encode_partitions(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: ``part, local_start, doc_id, n_tokens, ids``, stored in the shared folder.

    Written once, because a document's place must not change between the passes
    even when an executor is lost.
    """
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"part int, local_start bigint, doc_id {id_type}, n_tokens bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, before = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for few in slices(batch):
                starts, sizes, ids = [], [], []
                for text in few.column(1).to_pylist():
                    ids.append(encode(text) + end)
                    starts.append(before)
                    sizes.append(len(ids[-1]) // 4)
                    before += sizes[-1]
                arrays = [pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), few.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    return cut_lineage(narrow.mapInArrow(run, schema))


def cut_windows(encoded: DataFrame, length: int = SEQUENCE_TOKENS, with_ids: bool = True) -> DataFrame:
    """Second pass: one row per piece, ``doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32`` and ``ids``.

    ``start`` counts within the document, ``offset`` within the sequence; both are gapless from 0.
    """
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # As many rows as the first pass had tasks, two integers each.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"))
    placed = encoded.join(F.broadcast(offsets), "part").withColumn("_first", F.col("local_start") + F.col("_offset"))
    size = F.lit(length)
    last = F.col("_first") + F.col("n_tokens") - 1

    def piece(window):
        begin = F.greatest(window * size, F.col("_first"))
        end = F.least((window + 1) * size, last + 1)
        start = begin - F.col("_first")
        ids = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((end - begin) * 4).cast("int"))
        fields = {"start": start, "length": end - begin, "sequence_id": window, "offset": begin - window * size, "ids_crc32": F.crc32(ids)}
        return F.struct(*[c.alias(n) for n, c in ({**fields, "ids": ids} if with_ids else fields).items()])

    windows = F.sequence(F.floor(F.col("_first") / size), F.floor(last / size))
    pieces = placed.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p"))
    return pieces.select("doc_id", "doc_tokens", "p.*")


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = SEQUENCE_TOKENS, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of ``length`` tokens; see :func:`cut_windows`.

    A null or empty text is just its end id. Rows that repeat are packed each;
    a null document id stays null; other columns are not returned.
    """
    return cut_windows(encode_partitions(docs, tokenizer, end_id, id_col, text_col), length, with_ids)
