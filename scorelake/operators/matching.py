"""Emitter matching: the most similar gallery embeddings of each embedding.

Similarity is the cosine, so for unit vectors the nearest gallery rows are the
most similar ones. Queries and gallery are packed into tiles and blocks of
bounded size, each stored once; a task holds the tiles of its queries, reads the
gallery's blocks one after the other, and keeps the ``k`` best of each query. So
what is stored and sent grows with the rows, and only products grow with their
square. Rows of a block stand by their nearest pivot, and a run of them is
multiplied only with queries that the triangle inequality cannot rule it out for.
The answer is exact, and found the same way, at every size. A higher
``min_similarity`` lets more be ruled out; without one, vectors of many
dimensions have nothing near, and most runs stay open.

For galleries of any size there is :func:`match_near` beside it: multi-probe
locality-sensitive hashing with exact similarities of what it finds. What a query
costs is set by its tables, probes and the rows of a bucket, not by the gallery.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio
from ..session import cut_lineage, drop_stored
from .scoring import _matrix

# Pivots for each root of the gallery's rows: so many that cells and their runs grow alike.
PIVOT_SHARE = 1 / 16
BLOCK_ROWS = 4096
#: Rows sorted by cell before they are cut into blocks.
_SORTED_ROWS = 65536
_STEP = 512  # queries multiplied at a time inside a task
# Slack for rounding when a bound decides whether a run can be skipped.
_SLACK = 1e-6
#: Pairs whose similarities are computed one by one at a time.
_PAIRS = 1 << 15
#: A missing id among numbers.
_NO_ID = np.iinfo("int64").min
#: Runs of a block that a pass over the gallery looks at: of the query's own cell, of other cells, or all.
_HOME, _AWAY, _ALL = 0, 1, 2
_RUN = np.dtype([("first", "i8"), ("end", "i8"), ("cell", "i8"), ("near", "f8"), ("far", "f8")])


def _numbers(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _id_array(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers, pa.int64(), mask=numbers == _NO_ID)


def _top(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the k best columns per row, ties to the lowest id."""
    k = min(k, sims.shape[1])
    if k < sims.shape[1]:
        # Only what reaches a row's k-th value is sorted: the k best, and what ties with the last of them.
        floor = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k]
        rows, cols = np.nonzero(sims >= floor[:, None])
        value, found = sims[rows, cols], ids[cols]
        order = np.lexsort((found, -value, rows))
        starts = np.searchsorted(rows, np.arange(len(sims)))
        best = order[(starts[:, None] + np.arange(k)[None, :]).ravel()].reshape(-1, k)
        return found[best], value[best]
    order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]
    return ids[order], np.take_along_axis(sims, order, axis=1)


def match_embeddings(
    queries: DataFrame,
    gallery: DataFrame,
    k: int = 1,
    query_id: str = "signal_id",
    gallery_id: str = "gallery_id",
    col: str = "features",
    skip_self: bool = False,
    min_similarity: float = -1.0,
) -> DataFrame:
    """(query id, gallery id, similarity) of the ``k`` most similar gallery rows of at least ``min_similarity``.

    Vectors of any length are compared by direction; zero vectors, and those with
    a value that is missing or not finite, match nothing. With ``skip_self`` a row
    never matches its own id. Ids are integers, and ties go to the lowest.
    """
    spark, context = queries.sparkSession, queries.sparkSession.sparkContext
    # A repeatable choice of pivots, the root of the rows in number; any choice gives the exact answer.
    n_pivots = max(1, round(math.sqrt(gallery.count()) * PIVOT_SHARE))
    chosen = _directions(gallery, gallery_id, col).orderBy(F.xxhash64(gallery_id), gallery_id).limit(n_pivots).select(col).toArrow()
    if not len(chosen):
        return queries.select(query_id).limit(0).selectExpr(query_id, f"CAST(NULL AS BIGINT) {gallery_id}", "CAST(NULL AS DOUBLE) similarity")
    column = chosen.column(0).combine_chunks()
    pivots = context.broadcast(_matrix(column, len(column[0]), "float64"))
    cores = context.defaultParallelism
    tile_rows = min(2 * BLOCK_ROWS, max(256, -(-queries.count() // (3 * cores))))
    tiles = cut_lineage(_packed(queries, query_id, col, pivots, tile_rows))
    blocks = cut_lineage(_packed(gallery, gallery_id, col, pivots, BLOCK_ROWS, k, k * (1 + bool(skip_self))))
    n_tiles = tiles.count()
    # Queries of few files are dealt out; where even their tiles are few, so is the gallery.
    left = tiles if tiles.rdd.getNumPartitions() >= 2 * cores else tiles.repartitionByRange(max(1, n_tiles), "tile")
    splits = -(-2 * cores // max(1, n_tiles))
    if splits > 1:
        right = blocks.withColumn("runs_of", F.lit(_ALL))
    else:
        # The own cells of the queries first: what they find there rules out most of the rest.
        right = blocks.withColumn("runs_of", F.lit(_HOME)).unionByName(blocks.withColumn("runs_of", F.lit(_AWAY)))
    wide = _is_float(queries, col), _is_float(gallery, col)
    # Spark reads the blocks again for each batch of tiles, a batch at a time; nothing of it is exchanged or held.
    pairs = left.rdd.cartesian(right.coalesce(splits).rdd)
    found = pairs.mapPartitions(lambda rows: _walk(rows, pivots.value, wide, k, skip_self, min_similarity))
    packed = spark.createDataFrame(found, "q binary, g binary, s binary", verifySchema=False)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, g, s = (np.frombuffer(row[c], t) for c, t in zip("qgs", ("i8", "i8", "f8"), strict=True))
                yield pa.RecordBatch.from_arrays([_id_array(q), _id_array(g), pa.array(s)], [query_id, gallery_id, "similarity"])

    merged = packed.mapInArrow(unpacked, f"{query_id} bigint, {gallery_id} bigint, similarity double")
    # The limit on the row number is applied before the exchange as well.
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("similarity"), gallery_id))
    best = cut_lineage(merged.withColumn("_rank", rank).where(F.col("_rank") <= k).select(query_id, gallery_id, "similarity"))
    drop_stored(tiles, blocks)
    pivots.unpersist()
    return best


def _is_float(df: DataFrame, col: str) -> bool:
    return df.select(col).dtypes[0][1] == "array<float>"


def _slim(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """Ids as long; values as they are if floats, else as doubles."""
    values = F.col(col) if _is_float(df, col) else F.col(col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias(id_col), values.alias(col))


def _whole(column: pa.ListArray) -> tuple[np.ndarray, pa.ListArray, np.ndarray]:
    """Which rows have a direction, these rows, and their lengths, added up in order."""
    values = column.flatten()
    # A missing list has no values.
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    at, numbers = np.repeat(np.arange(len(column)), sizes), values.to_numpy(zero_copy_only=False).astype("float64")
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt(np.bincount(at, numbers * numbers, minlength=len(column)))
    # A missing value is no number here.
    kept = np.isfinite(norms) & (norms > 0)
    return kept, column.filter(pa.array(kept)), norms[kept]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype("float64")
    at = np.repeat(np.arange(len(x)), x.shape[1])
    return x / np.sqrt(np.bincount(at, (x * x).ravel(), minlength=len(x)))[:, None]


def _directions(df: DataFrame, id_col: str, col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows, norms = _whole(batch.column(1))
            sizes = np.diff(rows.offsets.to_numpy())
            units = rows.flatten().to_numpy(zero_copy_only=False).astype("float64") / np.repeat(norms, sizes)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(units))], [id_col, col])

    return _slim(df, id_col, col).mapInArrow(run, f"{id_col} bigint, {col} array<double>")


def _gaps(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from all pivots."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T, 0))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gaps = _gaps(x, pivots)
    cell = gaps.argmin(axis=1)
    return cell, gaps[np.arange(len(x)), cell]


def _folded(ids: np.ndarray, x: np.ndarray, k: int, most: int) -> np.ndarray:
    """Rows without those that equal vectors with lower ids leave no place: ``most`` of a vector, ``k`` of an id among them."""
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, same))
    for limit, also in ((k, ids), (most, same)):
        a, b = same[order], also[order]
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        order = order[np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order)))) < limit]
    return order


def _packed(df: DataFrame, id_col: str, col: str, pivots: Broadcast, rows: int, k: int = 0, most: int = 0) -> DataFrame:
    """Ids and vectors in tiles of up to ``rows`` rows, by cell and by distance from its pivot, and the runs of a cell in a tile.

    Tiles are cut from what a task reads, so nothing is exchanged. Of equal vectors that
    stand together, no more stay than ``most``, and ``k`` of an id, where ``k`` is given.
    """
    number = "float32" if _is_float(df, col) else "float64"

    def tile(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        if k:
            kept = _folded(ids, x, k, most)
            ids, x = ids[kept], x[kept]
        cell, gap = (np.concatenate(n) for n in zip(*(_nearest(_unit(x[at : at + _STEP]), pivots.value) for at in range(0, len(x), _STEP)), strict=True))
        order = np.lexsort((gap, cell))
        for at in range(0, len(order), rows):
            part = order[at : at + rows]
            first = np.flatnonzero(np.concatenate([[True], cell[part][1:] != cell[part][:-1]]))
            runs = np.empty(len(first), _RUN)
            runs["first"], runs["end"], runs["cell"] = first, np.append(first[1:], len(part)), cell[part][first]
            runs["near"], runs["far"] = gap[part][first], gap[part][runs["end"] - 1]
            yield ids[part].tobytes(), x[part].tobytes(), runs.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, width = TaskContext.get().partitionId() << 32, 0, [], pivots.value.shape[1]

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal made
            if held:
                for ids, vectors, runs in tile(*map(np.concatenate, zip(*held, strict=True))):
                    yield pa.RecordBatch.from_arrays([pa.array([task + made], pa.int64()), pa.array([ids], pa.binary()), pa.array([vectors], pa.binary()), pa.array([runs], pa.binary())], ["tile", "ids", "vectors", "runs"])
                    made += 1
                held.clear()

        for batch in batches:
            kept, vectors, _ = _whole(batch.column(1))
            if len(vectors):
                held.append((_numbers(batch.column(0).filter(pa.array(kept))), _matrix(vectors, width, number)))
            if sum(len(ids) for ids, _ in held) >= _SORTED_ROWS:
                yield from sent()
        yield from sent()

    return _slim(df, id_col, col).mapInArrow(run, "tile bigint, ids binary, vectors binary, runs binary")


def _opened(row, is_float: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, unit vectors in double and in float, and runs of a tile."""
    ids, runs = np.frombuffer(row.ids, "int64"), np.frombuffer(row.runs, _RUN)
    x = _unit(np.frombuffer(row.vectors, "float32" if is_float else "float64").reshape(len(ids), -1))
    return ids, x, x.astype("float32"), runs


class _Tile:
    """Queries of a tile and the best matches that they have met so far."""

    def __init__(self, row, is_float: bool, pivots: np.ndarray, k: int, skip_self: bool, floor: float):
        self.ids, self.x, self.slim, _ = _opened(row, is_float)
        self.gaps = _gaps(self.x, pivots)
        self.cell = self.gaps.argmin(axis=1)
        self.k, self.skip_self, self.floor = k, skip_self, floor
        self.found, self.value = np.zeros((len(self.ids), k), "int64"), np.full((len(self.ids), k), -np.inf)
        # Products of unit vectors in float are off by less than this.
        self.off = (self.x.shape[1] + 8) * 2.0**-23

    def meet(self, block: tuple, runs_of: int) -> None:
        """Take the best of a block's rows in, run by run."""
        for run in block[3]:
            # Unit vectors: distance^2 = 2 - 2 * similarity. Fewer than k so far: no bound but the floor.
            reach = np.sqrt(np.maximum(2 - 2 * np.maximum(self.value[:, -1], self.floor), 0)) + _SLACK
            gap = self.gaps[:, run["cell"]]
            open_q = (run["near"] <= gap + reach) & (run["far"] >= gap - reach)
            if runs_of != _ALL:
                open_q &= (self.cell == run["cell"]) == (runs_of == _HOME)
            rows = np.flatnonzero(open_q)
            if not len(rows):
                continue
            known, matrix, slim = (x[run["first"] : run["end"]] for x in block[:3])
            order = np.argsort(known, kind="stable") if self.skip_self else None
            for at in range(0, len(rows), _STEP):
                self._take(rows[at : at + _STEP], known, matrix, slim, order)

    def _take(self, rows: np.ndarray, known: np.ndarray, matrix: np.ndarray, slim: np.ndarray, order: np.ndarray | None) -> None:
        sims = self.slim[rows] @ slim.T
        if order is not None:
            low, high = (np.searchsorted(known, self.ids[rows], side, sorter=order) for side in ("left", "right"))
            own = np.where(self.ids[rows] == _NO_ID, 0, high - low)
            at, among = _spans(low, own)
            sims[at, order[among]] = -np.inf
        # What can be among the best by its product in float; only that is computed in double.
        least = np.maximum(self.value[rows, -1], self.floor) - self.off
        new = np.flatnonzero(np.isneginf(self.value[rows, -1]))
        if len(new) and self.k < sims.shape[1]:
            place = sims.shape[1] - self.k
            least[new] = np.maximum(least[new], np.partition(sims[new], place, axis=1)[:, place] - 2 * self.off)
        least = np.maximum(least, -2).astype("float32")
        q, g = np.divmod(np.flatnonzero(sims >= least[:, None]), sims.shape[1])
        if not len(q):
            return
        value = _products(self.x, rows[q], matrix, g)
        kept = value >= np.maximum(self.value[rows[q], -1], self.floor)
        q, found, value = rows[q[kept]], known[g[kept]], value[kept]
        changed = np.unique(q)
        q = np.concatenate([np.repeat(changed, self.k), q])
        found, value = np.concatenate([self.found[changed].ravel(), found]), np.concatenate([self.value[changed].ravel(), value])
        order = np.lexsort((found, -value, q))
        best = order[np.searchsorted(q[order], changed)[:, None] + np.arange(self.k)[None, :]]
        self.found[changed], self.value[changed] = found[best], value[best]

    def rows(self) -> tuple[bytes, bytes, bytes]:
        at, place = np.nonzero(np.isfinite(self.value))
        return self.ids[at].tobytes(), self.found[at, place].tobytes(), self.value[at, place].tobytes()


def _spans(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number from ``first`` on, ``sizes`` of them, the span it is of and the number."""
    span = np.repeat(np.arange(len(sizes)), sizes)
    return span, first[span] + np.arange(len(span)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows of ``a`` and ``b``, each by itself: equal rows give equal ones."""
    parts = [np.einsum("ij,ij->i", a[i[at : at + _PAIRS]], b[j[at : at + _PAIRS]]) for at in range(0, len(i), _PAIRS)]
    return np.concatenate(parts) if parts else np.empty(0)


def _walk(pairs, pivots: np.ndarray, wide: tuple[bool, bool], k: int, skip_self: bool, floor: float) -> Iterator[tuple]:
    """What the queries of a task's tiles find in the blocks that pass by."""
    tiles: dict[int, _Tile] = {}
    last, block = None, None
    for asked, row in pairs:
        if asked.tile not in tiles:
            tiles[asked.tile] = _Tile(asked, wide[0], pivots, k, skip_self, floor)
        if row.tile != last:
            last, block = row.tile, _opened(row, wide[1])
        tiles[asked.tile].meet(block, row.runs_of)
    for tile in tiles.values():
        yield tile.rows()


#: Hash tables, buckets that a query looks into in each, and gallery rows of a bucket on average.
TABLES, PROBES, BUCKET_ROWS = 6, 32, 256
#: Bits of a hash at most; a table's number stands above them in a bucket's number.
_MAX_BITS = 40
#: Parts of the buckets at least, and gallery rows of a part at most, on average.
_PARTS, _PART_ROWS = 128, 65536
#: Rows of both sides times the tables that they are sent to at once.
_COPIES = 1 << 18
#: Rows hashed at a time, and rows (some with their vectors) sent on at a time.
_HASHED_ROWS, _SENT_ROWS = 256, 2048


def _planes(width: int, tables: int, bits: int) -> np.ndarray:
    """Random directions; the sign of a vector along each is one bit of its hash."""
    return np.random.default_rng(17).normal(size=(width, tables * bits))


def probe_order(margins: np.ndarray, probes: int) -> list[int]:
    """Masks of the bits to flip, least likely borders last: in the order of the sum of squared margins.

    The masks are subsets of the bits sorted by margin; a heap makes them one by
    one, as each subset's successors shift its last bit or add the next one.
    """
    order, cost = np.argsort(margins, kind="stable").tolist(), np.sort(margins**2).tolist()
    masks, heap = [0], [(cost[0], 0, 1 << order[0])]
    while heap and len(masks) < probes:
        total, last, mask = heapq.heappop(heap)
        masks.append(mask)
        if last + 1 < len(order):
            after = 1 << order[last + 1]
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], last + 1, mask ^ (1 << order[last]) | after))
            heapq.heappush(heap, (total + cost[last + 1], last + 1, mask | after))
    return masks


def _hashed(
    df: DataFrame, id_col: str, col: str, width: int, tables: int, bits: int, probes: int,
    only: range | None = None, large: tuple[np.ndarray, np.ndarray] | None = None, borders: np.ndarray | None = None, sent: str = "first",
) -> DataFrame:
    """Each row once for each bucket: its own one of every table, and for more ``probes`` also the nearest others.

    ``only`` some of the tables. ``large``: buckets, in order, and their blocks; a row goes
    to one of them, and for more probes to all. ``borders`` cut the buckets into parts, and
    a row's vector is sent (``sent``) with ``every`` bucket, with the ``first`` one of each
    part and block, in the order of ``_row``, or with ``none``.
    """
    context = df.sparkSession.sparkContext
    planes, only = context.broadcast(_planes(width, tables, bits)), only or range(tables)
    big, blocks = (np.empty(0, "int64"),) * 2 if large is None else large
    big, blocks, borders = context.broadcast(big), context.broadcast(blocks), context.broadcast(np.empty(0, "int64") if borders is None else borders)
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        done = (context.partitionId() if context else 0) << 40
        chosen = planes.value[:, only[0] * bits : (only[-1] + 1) * bits]
        for batch in (whole.slice(at, _HASHED_ROWS) for whole in batches for at in range(0, whole.num_rows, _HASHED_ROWS)):
            x = _matrix(batch.column(1), width, "float64")
            along = (x @ chosen).reshape(len(x), len(only), bits)
            codes = (along > 0) @ weights + (np.array(only, dtype=np.int64) << _MAX_BITS)
            if probes == 1:
                rows, cells = np.repeat(np.arange(len(x)), len(only)), codes.ravel()
            else:
                found = [[c ^ m for m in probe_order(a, probes)] for code, near in zip(codes.tolist(), np.abs(along), strict=True) for c, a in zip(code, near, strict=True)]
                rows = np.repeat(np.repeat(np.arange(len(x)), len(only)), [len(f) for f in found])
                cells = np.array([c for f in found for c in f], dtype=np.int64)
            block = np.zeros(len(cells), "int64")
            if len(big.value):
                at = np.minimum(np.searchsorted(big.value, cells), len(big.value) - 1)
                parts = np.where(big.value[at] == cells, blocks.value[at], 1)
                if probes == 1:
                    block = (done + rows) % parts
                else:
                    at, block = _spans(np.zeros(len(cells), "int64"), parts)
                    rows, cells = rows[at], cells[at]
            part = np.searchsorted(borders.value, cells, side="right").astype("int64")
            order = np.lexsort((block, part, rows))
            rows, cells, part, block = rows[order], cells[order], part[order], block[order]
            new = np.ones(len(rows), bool)
            if sent == "first":
                new[1:] = (rows[1:] != rows[:-1]) | (part[1:] != part[:-1]) | (block[1:] != block[:-1])
            elif sent == "none":
                new[:] = False
            # A few of a batch's buckets at a time.
            for first in range(0, len(rows), _SENT_ROWS):
                some = slice(first, first + _SENT_ROWS)
                at = pa.array(rows[some])
                vectors = batch.column(1).take(pa.array(rows[some], mask=~new[some]))
                numbers = (cells[some], block[some], part[some], done + np.arange(first, first + len(at)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), vectors, *(pa.array(n, pa.int64()) for n in numbers)], [id_col, col, "cell", "block", "_part", "_row"])
            done += len(rows)

    return df.mapInArrow(run, f"{id_col} bigint, {col} array<double>, cell bigint, block bigint, _part bigint, _row bigint")


def _visit(asked: DataFrame, stock: DataFrame, k: int, query_id: str, gallery_id: str, col: str, parts: int) -> DataFrame:
    """Best ``k`` of the buckets' blocks that each query is sent to, once for each part and block at least.

    A task holds the gallery's rows of one part and block; queries pass by, and their
    vectors come before the other buckets that they are asked in.
    """
    sides = [df.select(F.col(i).alias("_id"), col, "cell", "block", "_part", row.alias("_row")) for df, i, row in ((stock, gallery_id, F.lit(-1).cast("bigint")), (asked, query_id, F.col("_row")))]
    dealt = sides[0].unionByName(sides[1]).repartitionById(parts, F.pmod(F.col("_part") + F.col("block"), F.lit(parts)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, shelf, asking, vector = None, [], None, None, None
        for batch in batches:
            cells, block, part, row = (batch.column(i).to_numpy() for i in (2, 3, 4, 5))
            ids = _numbers(batch.column(0))
            starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (block[1:] != block[:-1])]))
            for first, end in zip(starts, np.append(starts[1:], len(row)), strict=True):
                if where != (here := (part[first], block[first])):
                    where, held, shelf, asking, vector = here, [], None, None, None
                split = first + int(np.searchsorted(row[first:end], 0))
                if split > first:
                    vectors = batch.column(1).slice(first, split - first)
                    held.append((cells[first:split], ids[first:split], _matrix(vectors, len(vectors[0]), "float64")))
                if split == end or not held:
                    continue
                if shelf is None:
                    shelf = [np.concatenate(x) for x in zip(*held, strict=True)]
                    order = np.argsort(shelf[0], kind="stable")
                    shelf = [x[order] for x in shelf]
                    held = held[:1]
                vectors = batch.column(1).slice(split, end - split)
                begins = vectors.is_valid().to_numpy(zero_copy_only=False)
                at = np.cumsum(begins) - begins[0]
                names, x = ids[split:end][begins], vectors.drop_null()
                x = _matrix(x, shelf[2].shape[1], "float64") if len(x) else np.empty((0, shelf[2].shape[1]))
                if not begins[0]:  # the first ones' vector was in the batch before
                    names, x = np.concatenate([[asking], names]), np.concatenate([vector[None, :], x])
                asking, vector = names[-1], x[-1]
                for q, found, value in _best(x, at, cells[split:end], *shelf, k):
                    yield pa.RecordBatch.from_arrays([_id_array(names[q]), _id_array(found), pa.array(value)], [query_id, gallery_id, "similarity"])

    return dealt.sortWithinPartitions("_part", "block", "_row").mapInArrow(run, f"{query_id} bigint, {gallery_id} bigint, similarity double")


def _best(x: np.ndarray, at: np.ndarray, cells: np.ndarray, stocked: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, id, similarity) of the best of the rows in ``cells`` that the queries ``at`` look into."""
    order = np.argsort(cells, kind="stable")
    at, cells = at[order], cells[order]
    low, high = (np.searchsorted(stocked, cells, side) for side in ("left", "right"))
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    ends = np.append(starts[1:], len(cells))
    # Cells where much meets much are multiplied as matrices, pairs of the others one by one.
    dense = ((ends - starts) >= 8) & ((high - low)[starts] >= 64)
    for first, end in zip(starts[dense], ends[dense], strict=True):
        rows = slice(low[first], high[first])
        for s in range(first, end, _STEP):
            asking = at[s : min(end, s + _STEP)]
            found, value = _top(x[asking] @ matrix[rows].T, ids[rows], k)
            yield np.repeat(asking, found.shape[1]), found.ravel(), value.ravel()
    sparse = np.flatnonzero(~np.repeat(dense, ends - starts) & (high > low))
    sparse = sparse[np.argsort(at[sparse], kind="stable")]
    sums = np.cumsum((high - low)[sparse])
    cut = 0
    while cut < len(sparse):
        # So many pairs at a time, but the pairs of one cell at least.
        end = max(cut + 1, int(np.searchsorted(sums, (sums[cut - 1] if cut else 0) + _PAIRS, side="right")))
        some = sparse[cut:end]
        span, row = _spans(low[some], (high - low)[some])
        q = at[some][span]
        value, found = _products(x, q, matrix, row), ids[row]
        order = np.lexsort((found, -value, q))
        q, found, value = q[order], found[order], value[order]
        new = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        kept = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q)))) < k
        yield q[kept], found[kept], value[kept]
        cut = end


def match_near(
    queries: DataFrame,
    gallery: DataFrame,
    k: int = 1,
    query_id: str = "signal_id",
    gallery_id: str = "gallery_id",
    col: str = "features",
    skip_self: bool = False,
    min_similarity: float = -1.0,
    tables: int = TABLES,
    probes: int = PROBES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Like :func:`match_embeddings`, but only the buckets nearest to a query are looked into.

    The hash gets a bit more each time the gallery doubles, so a bucket keeps
    ``bucket_rows`` rows on average and a query meets ``tables * probes`` buckets,
    whatever the gallery's size. Similarities are exact; a neighbour can be
    missed, the farther the likelier. Equal gallery vectors are one row for the
    search and give their lowest ids; a bucket that is large all the same is cut
    into blocks, which are all looked into. Vectors of another length than the
    gallery's first match nothing.
    """
    more = k + bool(skip_self)
    asked, stock = _directions(queries, query_id, col), _directions(gallery, gallery_id, col)
    lowest = F.row_number().over(Window.partitionBy(col).orderBy(gallery_id))
    kept = stock.withColumn("_at", lowest).where(F.col("_at") <= more)
    # The first of equal ones stands for all; it is numbered by its own id.
    folded = cut_lineage(kept.groupBy(col).agg(F.min(gallery_id).alias(gallery_id), F.sort_array(F.collect_list(gallery_id)).alias("_ids")))
    many, width = folded.agg(F.count(F.lit(1)), F.max(F.size(col))).first()
    if not many:
        return asked.select(query_id).limit(0).selectExpr(query_id, f"CAST(NULL AS BIGINT) {gallery_id}", "CAST(NULL AS DOUBLE) similarity")
    bits = min(_MAX_BITS, max(1, math.ceil(math.log2(max(2.0, many / bucket_rows)))))
    own = folded.where((F.size(col) == width) & F.col(gallery_id).isNotNull()).select(gallery_id, col)
    asked = cut_lineage(asked.where(F.size(col) == width))
    # Buckets over BLOCK_ROWS are cut into blocks; parts are of about as many rows each.
    cells = cut_lineage(_hashed(own, gallery_id, col, width, tables, bits, 1, sent="none").select("cell"))
    large = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("n")).where("n > 1").orderBy("cell").toArrow()
    large = tuple(large.column(c).to_numpy().astype("int64") for c in ("cell", "n"))
    parts = max(1, round(many * tables / min(_PART_ROWS, max(BLOCK_ROWS, many * tables / _PARTS))))
    borders = cells.agg(F.percentile_approx("cell", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts))).first()[0] or []
    borders = np.unique(np.array(borders if parts > 1 else [], dtype="int64"))
    # Few rows are sent to all tables at once, many to one after the other: their copies go before the next ones come.
    at_once = max(1, min(tables, _COPIES // (many + asked.count())))
    rounds = []
    for first in range(0, tables, at_once):
        only = range(first, min(tables, first + at_once))
        placed = _hashed(own, gallery_id, col, width, tables, bits, 1, only, large, borders, "every")
        visits = _hashed(asked, query_id, col, width, tables, bits, min(probes, 1 << bits), only, large, borders, "first")
        # Parts are in the order of the tables.
        dealt = max(1, -(-parts * len(only) // tables))
        rounds.append(cut_lineage(_visit(visits, placed, more, query_id, gallery_id, col, dealt)))
    # Ids of equal rows are unfolded after the visits, so a row's own id is skipped then.
    found = functools.reduce(DataFrame.unionByName, rounds).groupBy(query_id, gallery_id).agg(F.max("similarity").alias("similarity"))
    found = found.where(F.col("similarity") >= min_similarity).join(folded.select(gallery_id, "_ids"), gallery_id)
    found = found.select(query_id, F.explode("_ids").alias(gallery_id), "similarity")
    if skip_self:
        found = found.where(F.col(query_id) != F.col(gallery_id))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("similarity"), gallery_id))
    best = cut_lineage(found.withColumn("_rank", rank).where(F.col("_rank") <= k).select(query_id, gallery_id, "similarity"))
    drop_stored(folded, asked, cells, *rounds)
    return best


def match_recall(found: DataFrame, exact: DataFrame, query_id: str = "signal_id", gallery_id: str = "gallery_id") -> DataFrame:
    """How many of the ``exact`` matches were ``found``: ``n, n_found, recall``."""
    hits = exact.select(query_id, gallery_id).join(found.select(query_id, gallery_id, F.lit(1).alias("_hit")), [query_id, gallery_id], "left")
    out = hits.agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("n_found"))
    return out.withColumn("recall", safe_ratio(F.col("n_found"), F.col("n")))
