"""Near-duplicate vectors by an inverted multi-index.

Both halves of the vectors get a codebook of their own, learned on a bounded
sample; their product is a grid of cells. A vector visits cells from the nearest
on, in the order of the sum of the squared distances to the two half cells (the
two sorted lists are walked together), until that sum passes the value within
which a target share of neighbours was found to lie: of random ones at the
threshold itself, and of all real ones of a bounded sample of queries. Every
visited vector is then compared exactly, in double precision. A pair that only
one side visits counts for both.

Equal vectors are folded first. A cell with many vectors is cut into blocks of a
fixed size, and a visit goes to each block, so no task holds a whole hot cell.
Pairs are counted and reduced to a spanning forest where they meet.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import extend, prepare, slices
from .graph import connected_components

#: Rows that the codebooks and the reach of the traversal are learned from.
SAMPLE_ROWS = 8192
#: Vectors of a cell on average, greatest size of a codebook, and vectors of a block.
CELL_ROWS, MAX_CODES, BLOCK_ROWS = 128, 256, 2048
TARGET_RECALL = 0.99
#: Vectors whose real neighbours are all found by brute force, for the reach.
QUERY_ROWS = 256


def is_usable(vector: Column) -> Column:
    """Not null, not zero, and neither null nor non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    codes = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        own = _squared(rows, codes).argmin(axis=1)
        for c in range(k):
            if (own == c).any():
                codes[c] = rows[own == c].mean(axis=0)
    return codes


def _squared(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum(0, (rows**2).sum(axis=1)[:, None] - 2 * rows @ codes.T + (codes**2).sum(axis=1))


def unit_rows(vectors: list, width: int) -> np.ndarray:
    """Unit vectors in double precision, shorter ones padded with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        # Scaled by the greatest component first, so squares neither overflow nor vanish.
        v = np.asarray(v, dtype=np.float64)
        out[i, : len(v)] = v / np.abs(v).max()
    return out / np.linalg.norm(out, axis=1)[:, None]


class MultiIndex:
    """Two codebooks and how far the traversal has to go."""

    def __init__(self, sample: np.ndarray, cells: int, threshold: float, recall: float) -> None:
        rng = np.random.default_rng(0)
        self.middle = max(1, sample.shape[1] // 2)
        k = max(1, min(cells, len(sample)))
        self.codes = [_k_means(h, k, rng) for h in self.halves(sample)]
        self.apart = [np.sqrt(_squared(c, c)) for c in self.codes]
        self.k = k
        # Neighbours at the very threshold, in random directions from the sample's vectors.
        away = rng.normal(size=sample.shape)
        away -= (away * sample).sum(axis=1)[:, None] * sample
        away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
        near = threshold * sample + np.sqrt(max(0.0, 1 - threshold**2)) * away
        (first, second), (a, b) = self.distances(sample), self.home(near)
        rows = np.arange(len(sample))
        self.reach = float(np.quantile(first[rows, a] + second[rows, b], recall))

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows[:, : self.middle], rows[:, self.middle :]

    def home(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (_squared(h, c).argmin(axis=1) for h, c in zip(self.halves(rows), self.codes, strict=True))
        return a, b

    def distances(self, rows: np.ndarray) -> list[np.ndarray]:
        """Squared distance of each half to each half cell: to the plane halfway to its code, 0 for the own one."""
        out = []
        for half, codes, apart in zip(self.halves(rows), self.codes, self.apart, strict=True):
            squared = _squared(half, codes)
            own = squared.argmin(axis=1)
            beyond = squared - squared[np.arange(len(half)), own][:, None]
            gap = 2 * apart[own]
            out.append(np.divide(beyond, gap, out=np.zeros_like(beyond), where=gap > 0) ** 2)
        return out

    def widen(self, distances: np.ndarray, pairs: np.ndarray, recall: float) -> None:
        """Reach at least so far that queries with that share of all ``pairs`` reach their farthest neighbour."""
        order = np.argsort(distances)
        if len(order):
            upto = np.cumsum(pairs[order])
            self.reach = max(self.reach, float(distances[order][np.searchsorted(upto, recall * upto[-1])]) * (1 + 1e-9))

    def visits(self, first: np.ndarray, second: np.ndarray) -> list[int]:
        """Cells of one vector by the multi-sequence algorithm: a heap holds the border of what was visited."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        x, y = first[a].tolist(), second[b].tolist()
        heap, seen, cells = [(x[0] + y[0], 0, 0)], {(0, 0)}, []
        while heap:
            distance, i, j = heapq.heappop(heap)
            if distance > self.reach:
                break
            cells.append(int(a[i]) * self.k + int(b[j]))
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < self.k and q < self.k and (p, q) not in seen:
                    seen.add((p, q))
                    heapq.heappush(heap, (x[p] + y[q], p, q))
        return cells


def _real_pairs(nodes: DataFrame, queries: list, index: MultiIndex, threshold: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the queries with neighbours: the greatest distance to a neighbour's home cell, and the number of neighbours."""
    asked, sizes = unit_rows(queries, width), np.array([len(q) for q in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = index.distances(asked)
        farthest, pairs = np.full(len(asked), -1.0), np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            for few in slices(batch, 256):
                vectors = few.column(0).to_pylist()
                rows = unit_rows(vectors, width)
                a, b = index.home(rows)
                likeness = asked @ rows.T
                hits = (likeness >= threshold) & (sizes[:, None] == np.array([len(v) for v in vectors])[None])
                farthest = np.maximum(farthest, np.where(hits, first[:, a] + second[:, b], -1.0).max(axis=1, initial=-1.0))
                pairs += hits.sum(axis=1)
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(farthest[some]), pa.array(pairs[some])], names=["q", "far", "pairs"])

    rows = nodes.select("_v").mapInArrow(run, "q int, far double, pairs bigint").groupBy("q").agg(F.max("far"), F.sum("pairs") - 1)
    found = [r for r in rows.collect() if r[2] > 0]  # each query is its own neighbour
    return np.array([r[1] for r in found], dtype=np.float64), np.array([r[2] for r in found], dtype=np.int64)


def _search(threshold: float, width: int, cells: int):
    """Over rows sorted by (cell, block, visitor): each visitor against the block's vectors.

    ``visits`` are those of a block's own vectors; ``home`` is a visitor's cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            cell, part, visitor, node, weight, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            vectors = unit_rows([v.values.to_numpy(zero_copy_only=False) for v in batch.column(6)], width)
            home, visits = batch.column(7).to_numpy(zero_copy_only=False), batch.column(8)
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(visitor) != 0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
                if key != (cell[s], part[s]):
                    key, parts, block = (cell[s], part[s]), [], None
                if not visitor[s]:
                    own = visits.slice(s, e - s)
                    before = sum(len(p[1]) for p in parts)
                    lengths = np.array([len(v) for v in own], dtype=np.int64)
                    seen = np.repeat(np.arange(before, before + e - s), lengths) * cells + own.flatten().to_numpy(zero_copy_only=False)
                    parts.append((vectors[s:e], node[s:e], weight[s:e], size[s:e], seen))
                    continue
                if not parts:
                    continue
                if block is None:
                    block = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    labels = np.arange(len(block[1]))
                    block[4].sort()
                rows, nodes, weights, sizes, seen = block
                hits = (vectors[s:e] @ rows.T >= threshold) & (nodes[None] != node[s:e, None]) & (sizes[None] == size[s:e, None])
                found = hits.any(axis=1)
                if not found.any():
                    continue
                links = hits[found] @ weights
                # A vector that doesn't visit its visitor's cell gets the link here.
                v, u = np.nonzero(hits)
                wanted = u * np.int64(cells) + home[s:e][v]
                at = np.searchsorted(seen, wanted)
                back = seen[np.minimum(at, len(seen) - 1)] == wanted if len(seen) else np.zeros(len(wanted), dtype=bool)
                given = np.zeros(len(nodes), dtype=np.int64)
                np.add.at(given, u[~back], weight[s:e][v[~back]])
                got = np.flatnonzero(given)
                edges = []
                for v, row in zip(node[s:e][found].tolist(), hits[found], strict=True):
                    at = np.flatnonzero(row)
                    kinds, one = np.unique(labels[at], return_index=True)
                    edges += [(v, int(nodes[at[i]])) for i in one]
                    if len(kinds) > 1:
                        labels[np.isin(labels, kinds)] = kinds[0]
                a = np.concatenate([node[s:e][found], nodes[got], [x for x, _ in edges]]).astype(np.int64)
                b = np.concatenate([links, given[got], [y for _, y in edges]]).astype(np.int64)
                counted = np.arange(len(a)) < len(links) + len(got)
                yield pa.RecordBatch.from_arrays([pa.array(counted), pa.array(a), pa.array(b)], names=["counted", "a", "b"])

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = TARGET_RECALL
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` of every row.

    Unusable vectors (see :func:`is_usable`) have no link and stand for
    themselves, as do null ids; vectors of different lengths don't link. Repeated
    rows are copies of each other. Links found are exact: none is below the
    threshold.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).withColumn("_ok", is_usable(F.col("_v")))
    folded = rows.where("_ok").groupBy("_v").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("weight"))
    # Numbered and stored: a node's number must not change when an executor is lost.
    nodes = cut_lineage(folded.withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.size("_v")))
    many, width = nodes.agg(F.count(F.lit(1)), F.max("size")).first()
    if not many:
        return rows.select(F.col("_id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = [r[0] for r in nodes.orderBy(F.xxhash64("_v"), "node").limit(SAMPLE_ROWS).select("_v").collect()]
    codes = int(min(MAX_CODES, max(1, np.sqrt(many / CELL_ROWS))))
    index = MultiIndex(unit_rows(sample, width), codes, threshold, recall)
    index.widen(*_real_pairs(nodes, sample[:QUERY_ROWS], index, threshold, width), recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch, 256):
                units = unit_rows([v.values.to_numpy(zero_copy_only=False) for v in few.column(3)], width)
                a, b = index.home(units)
                visits = [index.visits(x, y) for x, y in zip(*index.distances(units), strict=True)]
                arrays = [*[few.column(i) for i in range(4)], pa.array((a * index.k + b).astype(np.int32)), pa.array(visits, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "weight", "size", "_v", "cell", "visits"])

    narrow = nodes.select("node", "weight", "size", "_v")
    placed = cut_lineage(narrow.mapInArrow(place, extend(narrow.schema, "cell int, visits array<int>")))
    # One row for each cell that is used: at most MAX_CODES squared.
    blocks = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")))
    common = ["node", "weight", "size", "_v"]
    at_home = placed.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.lit(False).alias("visitor"), *common, F.col("cell").alias("home"), "visits")
    visiting = placed.select(F.explode("visits").alias("cell"), *common, F.col("cell").alias("home")).join(blocks, "cell")
    visiting = visiting.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visitor"), *common, "home", F.array().cast("array<int>").alias("visits"))
    met = at_home.unionByName(visiting).repartition("cell", "block").sortWithinPartitions("cell", "block", "visitor")
    found = cut_lineage(met.mapInArrow(_search(threshold, width, index.k * index.k), "counted boolean, a bigint, b bigint"))

    links = found.where("counted").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    roots = connected_components(found.where("not counted").select("a", "b"))
    known = nodes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("first").alias("least"))
    known = known.join(least, "root").select("_v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "least")
    # Unusable vectors match no node; a hot vector is a skewed side of this join, which Spark splits.
    out = rows.join(known.withColumn("_ok", F.lit(True)), ["_v", "_ok"], "left")
    component = F.when(F.col("_id").isNull(), None).otherwise(F.coalesce("least", "_id"))
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"),
    )
