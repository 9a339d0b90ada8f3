"""SpotSigs document fingerprints.

Common words spread evenly through natural text and hardly occur in what frames
it. Each occurrence of one anchors a signature: the anchor and the chain of the
next content words after it. A document's fingerprint is its bag of signatures,
as sorted 32-bit hashes; likeness is the Jaccard similarity of two bags.

Bags of similar documents have similar sizes: with a wanted likeness, a pair from
size classes that are not neighbours is never compared, and the merge of two
sorted bags is given up as soon as that likeness is out of reach.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices

#: Common words of four languages, the default anchors.
ANCHORS = frozenset(
    "a an and are as at be but by for from had has have he his in is it not of on or she that the their they this to was were which with you"
    " au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous par pas pour que qui sa se ses son sont sur un une vous"
    " als am auch auf aus bei das dem den der die ein eine einem einen einer er es für hat ich im ist mit nach nicht noch sich sie sind über um und von war wie wir zu zum"
    " al con como del el ella ellos era esta este han las lo los mas más no o para pero por se ser sin sobre su sus todo una y ya".split()
)
#: Content words of a chain.
CHAIN = 2

# Words, line breaks, and symbols that stand alone: as common as common words, the latter two anchor as well.
_TOKEN = re.compile(r"[^\W_]+|\n\s*|(?<!\S)[^\w\s]+(?!\S)")


def signatures(text: str, anchors: frozenset[str] = ANCHORS, chain: int = CHAIN) -> np.ndarray:
    """Sorted 32-bit hashes of a text's signatures, repeats included.

    The text's start anchors like a line break. A chain is cut short at the
    text's end, and no signature is without content words. A text of common
    words only has runs of ``chain + 1`` of them; one without words is the digest
    of its characters; an empty one has no signature.
    """
    words = ["\n", *_TOKEN.findall(text.lower())] if text else []
    anchored = [w in anchors or not w[0].isalnum() for w in words]
    content = [w for w, common in zip(words, anchored, strict=True) if not common]
    found, ahead = [], 0
    for w, common in zip(words, anchored, strict=True):
        if not common:
            ahead += 1
        elif ahead < len(content):
            found.append(" ".join([w if w[0] != "\n" else "\n", *content[ahead : ahead + chain]]))
    if not found:
        words = [w for w in words if w[0].isalnum()]
    if not found and words:
        found = [" ".join(words[i : i + chain + 1]) for i in range(max(1, len(words) - chain))]
    if not found and text:
        found = [text]
    return np.sort(np.array([_hash(s) for s in found], dtype=np.uint32))


def _hash(signature: str) -> int:
    from xxhash import xxh32_intdigest

    return xxh32_intdigest(signature.encode("utf-8", "surrogatepass"))


def fingerprint(bag: np.ndarray) -> str:
    """Eight hexadecimal digits for each signature, in order."""
    return bag.astype(">u4").tobytes().hex()


def bag_of(fingerprint_: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint_), dtype=">u4").astype(np.uint32)


def size_class(size: int, at_least: float) -> int:
    """Sizes of bags that are as alike as ``at_least`` fall into the same class or neighbouring ones."""
    return int(math.floor(math.log(max(1, size)) / -math.log(at_least) + 1e-9)) if 0 < at_least < 1 else 0


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard similarity of two sorted bags; 1 for two empty ones.

    With ``at_least``, 0 as soon as sizes, or the ranges of values seen in
    common, show that it can't be reached.
    """
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if at_least and abs(size_class(small, at_least) - size_class(large, at_least)) > 1:
        return 0.0
    if small < at_least * large or not small:
        return 0.0
    # Common values up to a quarter of the way bound what the rest can add.
    if at_least and small > 64:
        pivot = a[len(a) // 4]
        i, j = int(np.searchsorted(a, pivot)), int(np.searchsorted(b, pivot))
        most = _common(a[:i], b[:j]) + min(len(a) - i, len(b) - j)
        if most < at_least * (len(a) + len(b) - most):
            return 0.0
    both = _common(a, b)
    found = both / (len(a) + len(b) - both)
    return float(found) if found >= at_least else 0.0


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted bags: each value as often as both have it."""
    values, n = np.unique(a, return_counts=True)
    others, m = np.unique(b, return_counts=True)
    at = np.searchsorted(others, values)
    inside = at < len(others)
    same = np.zeros(len(values), dtype=bool)
    same[inside] = others[at[inside]] == values[inside]
    return int(np.minimum(n[same], m[at[same]]).sum())


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows sorted by id within buckets of consecutive ids, each bucket followed by the first row of the next one.

    ``_bucket, _extra, doc_id, text``; the last bucket is followed by the first
    row of all. Only the first id of each bucket goes to the driver, so rows can
    look at their successor without a window over everything. Rows that share an
    id (or have none; they come first) are ordered by a hash of their text.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # As many buckets as an exchange has partitions: a column of ids is small, and without
    # a number adaptive execution would fold its ranges, and with them the texts, into one.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("doc_id").where("doc_id is not null").repartitionByRange(parts, "doc_id")
    firsts = sorted(r[0] for r in ids.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("m")).select("m").collect())
    kind = rows.schema["doc_id"].dataType
    bounds = F.array(*[F.lit(x).cast(kind) for x in firsts[1:]]) if len(firsts) > 1 else F.array().cast(f"array<{kind.simpleString()}>")
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda x: x <= F.col("doc_id"))))
    n = max(1, len(firsts))
    is_first = F.array_contains(bounds, F.col("doc_id")) if len(firsts) > 1 else F.lit(False)
    placed = rows.withColumn("_own", own)
    # Before the first id come rows without one; either may be the very first.
    head = F.col("doc_id").isNull() | (F.col("doc_id") == F.lit(firsts[0]).cast(kind)) if firsts else F.lit(True)
    copies = F.array(F.struct(F.col("_own").alias("b"), F.lit(0).alias("x")), F.when(is_first, F.struct((F.col("_own") - 1).alias("b"), F.lit(1).alias("x"))), F.when(head, F.struct(F.lit(n - 1).alias("b"), F.lit(2).alias("x"))))
    dealt = placed.withColumn("_c", F.explode(F.filter(copies, lambda c: c.isNotNull())))
    dealt = dealt.select(F.col("_c.b").alias("_bucket"), F.col("_c.x").alias("_extra"), "doc_id", "text", F.xxhash64("text").alias("_tie"))
    by = ["_bucket", "_extra", "doc_id", "_tie"]
    return dealt.repartitionByRange(parts, "_bucket").sortWithinPartitions(*by).drop("_tie")


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of an edited text and its likeness to that and to the next document's.

    The edited text has the last quarter of the code points (rounded down)
    replaced by the first as many of the next document, in ascending order of
    ids; after the last comes the first. A null text is an empty one.
    """
    prepare(docs.sparkSession)
    ordered = in_order(docs, id_col, text_col)
    kind = ordered.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # bucket, id, text, bag: a row that waits for its successor
        done: list[tuple] = []
        id_type = None

        def compared(name, text: str, bag: np.ndarray, after: str, after_bag: np.ndarray) -> tuple:
            quarter = len(text) // 4
            edited = text[: len(text) - quarter] + after[:quarter]
            edited_bag = signatures(edited)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return (name, len(text), digest, fingerprint(bag), fingerprint(edited_bag), likeness(bag, edited_bag), likeness(bag, after_bag))

        def out() -> pa.RecordBatch:
            names, *rest = zip(*done, strict=True)
            done.clear()
            arrays = [pa.array(names, id_type), pa.array(rest[0], pa.int64()), *[pa.array(c, pa.string()) for c in rest[1:4]], *[pa.array(c, pa.float64()) for c in rest[4:]]]
            return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            id_type = batch.column(2).type
            for few in slices(batch):
                for bucket, extra, name, text in zip(*[c.to_pylist() for c in few.columns], strict=True):
                    if held is None and extra:
                        continue  # a further candidate for the bucket's successor
                    bag = signatures(text)
                    if held is not None:
                        done.append(compared(held[1], held[2], held[3], text, bag))
                    held = None if extra else (bucket, name, text, bag)
                if done:
                    yield out()

    return ordered.mapInArrow(run, schema)
