"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Each segment
is decoded to the indices of its near codewords; two segments that differ in at
most two bits share an index (:mod:`.golay`). Four wrong bits over three
segments leave, by the pigeonhole principle, either one segment without any and
another with two at most, or three segments with two at most. So fingerprints
within four bits share one of these keys, and no other scheme is needed:

- one segment as it is, with an index of another (six ordered pairs);
- an index of each of the three.

Equal fingerprints are folded first, so a group of copies is one row. Rows that
share a key are met in sorted order; a run of equal keys yields the edges of a
spanning forest of its links, never all pairs. A long run is cut into blocks,
and pairs of blocks meet in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_stored, shuffles_freed
from . import golay
from .common import extend, marked, prepare, slices
from .graph import connected_components

SEED = 42
MAX_BITS = 4
#: Rows that a task looks at together, and the longest run that it handles whole.
WINDOW_ROWS, RUN_ROWS = 100_000, 8192
#: Runs up to this length emit each link; longer ones a spanning forest.
SHORT_RUN = 16


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, repeats included; of all words where there are fewer.

    ``A-Z`` is lowered, words are what stands between ASCII white space.
    """
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    last = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]) - 1
    spans = zip(starts[:n].tolist(), last.tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the ``(n, words)`` 64-bit hashes whether over half have it; lowest bit first."""
    ones = np.zeros(64 * hashes.shape[1], dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.ascontiguousarray(hashes[at : at + 8192]).view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones * 2 > len(hashes)


def fingerprint(text: str, shingle: int = 4) -> int:
    """The 64-bit SimHash; zero for a text without words."""
    return print_of(shingle_hashes(text, shingle))


def print_of(hashes: np.ndarray) -> int:
    """The SimHash of a text's shingle hashes."""
    return int.from_bytes(np.packbits(majority_bits(hashes[:, None]), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``id_col, fp`` (signed 64 bits) of every row; a null text is an empty one."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    fields = extend(narrow.select(id_col).schema, "fp bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch):
                found = np.array([fingerprint(t, shingle) for t in few.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(found.view(np.int64))], names=fields.fieldNames())

    return narrow.mapInArrow(run, fields)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 64-bit fingerprints and, for each, the row that it belongs to."""
    widths, shifts = (23, 23, 18), (0, 23, 46)
    parts = [(fps >> np.uint64(s)) & np.uint64((1 << w) - 1) for w, s in zip(widths, shifts, strict=True)]
    near = [golay.keys(p) for p in parts]
    used = [np.arange(golay.KEYS) < count[:, None] for _, count in near]
    index = [k.astype(np.uint64) for k, _ in near]
    keys, rows = [], []
    for scheme, (i, j) in enumerate([(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]):
        key = (np.uint64(scheme) << np.uint64(60)) | (parts[i][:, None] << np.uint64(12)) | index[j]
        at = np.nonzero(used[j])
        keys.append(key[at])
        rows.append(at[0])
    triple = (np.uint64(6) << np.uint64(60)) | (index[0][:, :, None, None] << np.uint64(24)) | (index[1][:, None, :, None] << np.uint64(12)) | index[2][:, None, None, :]
    at = np.nonzero(used[0][:, :, None, None] & used[1][:, None, :, None] & used[2][:, None, None, :])
    keys.append(triple[at])
    rows.append(at[0])
    return np.concatenate(keys), np.concatenate(rows)


def _spread_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for few in slices(batch, 512):
            fps = few.column(0).to_numpy().view(np.uint64)
            keys, rows = fuzzy_keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps[rows].view(np.int64))], names=["key", "fp"])


def _forest(fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among distinct fingerprints: each is expanded once against those not yet reached."""
    left = np.ones(len(fps), dtype=bool)
    for first in range(len(fps)):
        if not left[first]:
            continue
        left[first] = False
        stack = [first]
        while stack:
            at = stack.pop()
            open_ = np.flatnonzero(left)
            if not len(open_):
                return
            hit = open_[np.bitwise_count(fps[open_] ^ fps[at]) <= most]
            if len(hit):
                left[hit] = False
                stack.extend(hit.tolist())
                yield np.full(len(hit), fps[at]), fps[hit]


def _link_runs(most: int, longest: int | None):
    """Links within runs of equal keys of rows sorted by (key, fp); runs beyond ``longest`` are passed on in blocks."""

    def emit(kind: int, key, a, b) -> pa.RecordBatch:
        n = len(a)
        arrays = [np.full(n, kind, dtype=np.int32), np.broadcast_to(key, n).astype(np.int64), np.asarray(a).astype(np.uint64).view(np.int64), np.asarray(b).astype(np.uint64).view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["kind", "key", "a", "b"])

    def whole_runs(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        short = np.repeat(sizes <= SHORT_RUN, sizes)
        k, f = keys[short], fps[short]
        for apart in range(1, SHORT_RUN):
            same = np.flatnonzero(k[apart:] == k[:-apart]) if apart < len(k) else []
            if not len(same):
                break
            a, b = f[same], f[same + apart]
            hit = (np.bitwise_count(a ^ b) <= most) & (a != b)
            if hit.any():
                yield emit(0, 0, a[hit], b[hit])
        for s, n in zip(starts[sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist(), strict=True):
            if longest and n > longest:
                blocks = np.arange(n) // longest
                yield emit(1, keys[s], fps[s : s + n], blocks)
            else:
                for a, b in _forest(np.unique(fps[s : s + n]), most):
                    yield emit(0, 0, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        passed: list = [None, 0]  # a run that is longer than the window: its key, and rows that went on in blocks
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            rows += batch.num_rows
            if rows < WINDOW_ROWS:
                continue
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            # The last run may go on in the next window.
            begin = int(np.searchsorted(keys, keys[-1]))
            if passed[0] is not None:
                end = int(np.searchsorted(keys, passed[0], side="right"))
                yield emit(1, passed[0], fps[:end], (passed[1] + np.arange(end)) // longest)
                passed[1] += end
                if end == len(keys):
                    held, rows = [], 0
                    continue
                keys, fps, begin, passed = keys[end:], fps[end:], begin - end, [None, 0]
            if begin:
                yield from whole_runs(keys[:begin], fps[:begin])
                keys, fps = keys[begin:], fps[begin:]
            if longest and len(keys) > longest:
                yield emit(1, keys[0], fps, np.arange(len(fps)) // longest)
                passed = [keys[0], len(keys)]
                keys, fps = keys[:0], fps[:0]
            held, rows = [(keys, fps)], len(keys)
        if rows:
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            if passed[0] is not None:
                end = int(np.searchsorted(keys, passed[0], side="right"))
                yield emit(1, passed[0], fps[:end], (passed[1] + np.arange(end)) // longest)
                keys, fps = keys[end:], fps[end:]
            if len(keys):
                yield from whole_runs(keys, fps)

    return run


_MET = "kind int, key bigint, a bigint, b bigint"


def link_fingerprints(distinct: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """``a, b``: enough of the links of at most ``most`` (up to four) differing bits to connect all that are linked.

    ``distinct`` has one column ``fp`` without repeats.
    """
    if most > MAX_BITS:
        raise ValueError(f"keys are shared up to {MAX_BITS} wrong bits only")
    prepare(distinct.sparkSession)
    keyed = distinct.mapInArrow(_spread_keys, "key bigint, fp bigint")
    met = cut_lineage(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_runs(most, RUN_ROWS), _MET))
    # Blocks of long runs: every pair of blocks (and each with itself) is a run of its own.
    long_runs = met.where("kind = 1")
    blocks = long_runs.groupBy("key").agg(F.max("b").alias("last"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), "last"))
    paired = long_runs.join(blocks, "key").select("key", "a", "b", other.alias("c"))
    pair = F.xxhash64("key", F.least("b", "c"), F.greatest("b", "c"))
    in_blocks = paired.select(pair.alias("key"), F.col("a").alias("fp")).repartition("key").sortWithinPartitions("key", "fp")
    edges = met.where("kind = 0").unionByName(in_blocks.mapInArrow(_link_runs(most, None), _MET))
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = MAX_BITS) -> DataFrame:
    """``id_col, fp, component_id`` of every row: the smallest id that links of at most ``most`` bits reach.

    Texts without words have the fingerprint zero and link like any other. A null
    id is never the smallest; a component of null ids only has a null id.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    distinct = prints.groupBy("fp").agg(F.min(id_col).alias("_first"))
    roots = connected_components(link_fingerprints(distinct.select("fp"), most))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    by_print = rooted.join(smallest, "root").select("fp", "component_id")
    # A fingerprint that a third of all rows share is a skewed side of this join, which Spark splits.
    return prints.join(by_print, "fp").select(id_col, "fp", "component_id")


# Near-duplicates by similarity of shingle sets.

SIMILARITY, SHINGLE = 0.8, 5
#: Documents (about) whose shingles are counted for the order of prefixes, sightings that make one common, and most common ones kept.
ORDER_DOCS, COMMON, MOST_COMMON = 20_000, 4, 100_000
#: Rounds in which the rows of a key meet a few of them only, before all that are still apart do.
PIVOT_ROUNDS = 2
#: Rows of a key that meet each other in one task; keys with more are cut into blocks, and pairs of blocks meet.
MEET_ROWS = 2048


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted XXH64 of a text's shingles, without repeats."""
    return np.unique(shingle_hashes(text, shingle))


def common_shingles(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles of a bounded sample, and in how many of its texts each stands."""
    fraction = min(1.0, ORDER_DOCS / max(1, docs.count()))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    some = docs.select(text.alias("_text")).where(F.pmod(F.xxhash64("_text", F.lit(SEED)), F.lit(1_000_000)) < int(fraction * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch):
                sets = [shingle_set(t, shingle) for t in few.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    counts = some.mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    with shuffles_freed(docs.sparkSession):
        found = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    hashes, n = np.array([r.h for r in found], dtype=np.int64).view(np.uint64), np.array([r.n for r in found], dtype=np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def sightings(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In how many texts of the sample each hash stands; 0 for those that aren't common."""
    if not len(common[0]) or not len(hashes):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
    return np.where(common[0][at] == hashes, common[1][at], 0)


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The rarest of a set's hashes, so many that two sets of at least that similarity share one.

    Rarer ones stand before common ones, then smaller before greater. Which are
    common is the same for all sets, and any such order finds all pairs.
    """
    seen = sightings(hashes, common)
    shared = int(np.ceil(similarity * len(hashes) - 1e-9))
    return hashes[np.lexsort((hashes, seen))][: len(hashes) - shared + 1]


def set_prefixes(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """``doc_id, th, fp, node, n, seen, keys``: a hash of the text, its SimHash, and of its shingle set a digest, the size and the prefix, with the sightings of its last hash."""
    prepare(docs.sparkSession)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col, shingle))
    narrow = _keyed_texts(docs, id_col, text_col)
    fields = extend(narrow.select("doc_id", "th").schema, "fp bigint, node bigint, n int, seen bigint, keys array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for few in slices(batch):
                every = [shingle_hashes(t, shingle) for t in few.column(2).to_pylist()]
                fps = np.array([print_of(h) for h in every], dtype=np.uint64).view(np.int64)
                sets = [np.unique(h) for h in every]
                digests = pa.array([xxh64_intdigest(s.tobytes()) >> 1 for s in sets], pa.int64())
                prefixes = [prefix(s, common.value, similarity) for s in sets]
                seen = pa.array([int(sightings(p[-1:], common.value).sum()) for p in prefixes], pa.int64())
                keys = pa.array([p.view(np.int64) for p in prefixes], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(fps), digests, pa.array([len(s) for s in sets], pa.int32()), seen, keys], names=fields.fieldNames())

    return narrow.mapInArrow(run, fields)


def _keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("_text"))


def _shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``node, shingles``: sets of shingle hashes of the ``wanted`` (node, doc_id, th) only, a stored table."""
    narrow = marked(_keyed_texts(docs, id_col, text_col), "th", wanted.select("th"))
    keys = wanted.select("node", F.col("doc_id").alias("_i"), F.col("th").alias("_t"))
    found = narrow.join(keys, narrow["doc_id"].eqNullSafe(keys["_i"]) & (narrow["th"] == keys["_t"])).select("node", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch):
                sets = [shingle_set(t, shingle).view(np.int64) for t in few.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    # Repeated rows are one node.
    return found.mapInArrow(run, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def _may_be_similar(pairs: DataFrame, prefixes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose prefixes leave room for that similarity.

    What the prefix that ends first in the order has in common with the other
    set stands in the other prefix too. So two sets share no more than their
    prefixes do and what is behind that end; no similar pair is ruled out.
    Both inputs are stored tables.
    """
    few = marked(prefixes, "node", pairs.select("a").union(pairs.select("b")))
    side = lambda x: few.select(F.col("node").alias(x), F.struct("n", "seen", "keys").alias(f"_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    # Hashes are ordered as unsigned numbers.
    end = lambda x: F.struct(F.col(f"{x}.seen"), F.try_element_at(f"{x}.keys", F.lit(-1)).bitwiseXOR(F.lit(-(1 << 63))))
    behind = lambda x: F.col(f"{x}.n") - F.size(f"{x}.keys")
    most = F.size(F.array_intersect("_a.keys", "_b.keys")) + F.when(end("_a") <= end("_b"), behind("_a")).otherwise(behind("_b"))
    return joined.where(most >= similarity / (1 + similarity) * (F.col("_a.n") + F.col("_b.n")) - 1e-9).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have at least that Jaccard similarity."""
    joined = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "_a"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "_b"}), "b")
    both = F.size(F.array_intersect("_a", "_b"))
    return joined.where(both >= similarity * (F.size("_a") + F.size("_b") - both) - 1e-9).select("a", "b")


def _may_link(x: str, y: str, similarity: float):
    """Whether sizes, and what stands behind the shared key in both orders, leave room for that similarity."""
    n, m, p, q = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    fit = F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9
    return fit & (F.least(n - p, m - q) >= similarity / (1 + similarity) * (n + m) - 1e-9)


def _ordered(x: str, y: str) -> list:
    return [F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")]


def _meet_pivots(rows: DataFrame, turn: int, similarity: float) -> DataFrame:
    """``a, b``: rows of a key beside the least and greatest of it, and one that differs from turn to turn, where roots differ."""
    me = F.struct("node", "n", "pos", "root")
    pivots = rows.groupBy("key").agg(F.min(me).alias("x"), F.max(me).alias("y"), F.min_by(me, F.xxhash64("node", F.lit(turn))).alias("z"))
    met = rows.select("key", me.alias("r")).join(pivots, "key").select("r", F.explode(F.array("x", "y", "z")).alias("p"))
    return met.where((F.col("r.root") != F.col("p.root")) & _may_link("r", "p", similarity)).select(*_ordered("r", "p")).distinct()


def _in_blocks(rows: DataFrame) -> DataFrame:
    """``key, low, high, r``: a key's rows in blocks; each pair of blocks (and each with itself) is a run of its own."""
    blocks = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / MEET_ROWS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("b")
    placed = rows.join(blocks, "key").select("key", F.struct("node", "n", "pos", "root", own).alias("r"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"))
    return placed.select("key", F.least("r.b", "c").alias("low"), F.greatest("r.b", "c").alias("high"), "r")


def _meet_all(rows: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: all rows of a key where roots differ."""
    dealt = _in_blocks(rows)
    met = dealt.withColumnRenamed("r", "x").join(dealt.withColumnRenamed("r", "y"), ["key", "low", "high"])
    # Rows of one block meet where it is beside itself only.
    once = (F.col("x.b") != F.col("y.b")) | (F.col("low") == F.col("high"))
    apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    return met.where(once & apart & _may_link("x", "y", similarity)).select(*_ordered("x", "y")).distinct()


def _near_prints(nodes: DataFrame) -> DataFrame:
    """``a, b``: nodes of equal fingerprints beside the least of them, and such least ones whose fingerprints :func:`link_fingerprints` links."""
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    equal = nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    linked = link_fingerprints(heads.select("fp"))
    linked = linked.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("_x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("_y")), "b")
    return equal.unionByName(linked.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, th, first_id, first_th``: each row's id and text hash beside those of the first document of its group.

    A group is what links of at least ``similarity`` between sets of
    ``shingle``-word shingles connect. Fingerprints within four bits are found
    by their Golay keys first, and their documents' sets verified. No pair that
    they leave is missed: both sets share a hash of their prefixes, and all
    pairs that share one and aren't connected yet are verified on the sets,
    which are made for documents of pairs that their prefixes don't rule out.
    The first is the smallest id, then the smallest text hash; null ids come last.
    """
    prints = cut_lineage(set_prefixes(docs, id_col, text_col, shingle, similarity))
    # Texts with equal shingles are one node, so copies of a text are.
    nodes = cut_lineage(prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "fp")).alias("f")))
    prefixes = cut_lineage(prints.select("node", "n", "seen", "keys").dropDuplicates(["node"]))
    prints, whole = cut_lineage(prints.select("doc_id", "th", "node")), prints
    drop_stored(whole)
    keyed = prefixes.select("node", "n", F.posexplode("keys").alias("pos", "key"))
    several = cut_lineage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    shared = cut_lineage(marked(keyed, "key", several.select("key")).join(several, "key"))
    drop_stored(several)

    def verified(met: DataFrame) -> DataFrame:
        pairs = cut_lineage(_may_be_similar(met, prefixes, similarity))
        paired = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        # Stored first, so that Spark knows how small it is when it plans the join with the texts.
        wanted = cut_lineage(nodes.join(paired, "node").select("node", "f.doc_id", "f.th"))
        sets = cut_lineage(_shingle_sets(docs, wanted, id_col, text_col, shingle))
        found = cut_lineage(_similar(pairs, sets, similarity))
        drop_stored(pairs, wanted, sets)
        return found

    def still_apart(rows: DataFrame) -> DataFrame:
        """The rows with their roots, of keys whose rows aren't all connected."""
        rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = rooted.groupBy("key").agg(F.min("root").alias("_x"), F.max("root").alias("_y")).where("_x < _y").select("key")
        return cut_lineage(rooted.join(several, "key"))

    near = cut_lineage(_near_prints(nodes.select("node", "f.fp")))
    links = verified(near)
    drop_stored(near)
    roots = cut_lineage(connected_components(links))
    left = still_apart(shared)
    for turn in range(PIVOT_ROUNDS + 1):
        met = cut_lineage(_meet_pivots(left, turn, similarity) if turn < PIVOT_ROUNDS else _meet_all(left, similarity))
        found = verified(met)
        drop_stored(met)
        links = links.unionByName(found)
        roots, before = cut_lineage(connected_components(links)), roots
        drop_stored(left, before)
        if turn < PIVOT_ROUNDS:
            # Up to three rows of a key have all met.
            left = still_apart(shared.where("m > 3"))
    drop_stored(shared, prefixes)
    grouped = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = grouped.groupBy("root").agg(F.min("f").alias("first"))
    heads = grouped.join(first, "root").select("node", "first")
    return prints.join(heads, "node").select("doc_id", "th", F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of :func:`near_duplicates`, all columns; of repeated rows one stays.

    What goes is stored and taken out by an anti-join; texts are exchanged for
    it only where a bitmap of that list doesn't tell that they stay.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, similarity)
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))
    counted = found.groupBy(F.col("doc_id").alias("_i"), F.col("th").alias("_t")).agg(F.bool_or(stays).alias("_stays"), F.count(F.lit(1)).alias("_n"))
    odd = cut_lineage(counted.where("not _stays or _n > 1"))
    th = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("_id"), th.alias("_th"))
    same = lambda keys: packed["_id"].eqNullSafe(keys["_i"]) & (packed["_th"] == keys["_t"])
    repeated = odd.where("_stays")
    listed = odd.select("_t")
    some = marked(packed, "_th", listed)
    single = marked(packed, "_th", listed, others=True).unionByName(some.join(odd, same(odd), "left_anti"))
    once = some.join(repeated, same(repeated), "left_semi").dropDuplicates(["_id", "_th"])
    return single.unionByName(once).select(*[F.col(f"doc.`{c}`") for c in docs.columns])
