"""Exact top-k inner products of integer vectors by pivot-table elimination.

Inner products become distances: with M the greatest length of a candidate, each
candidate x gets one more component, the root of M² - |x|², and each query q a
zero. Then |q'-x'|² = |q|² + M² - 2<q,x>, so the greatest products are the
nearest points, and the triangle inequality holds. Every candidate's distances to
many pivots are computed once; the greatest difference between a query's and a
candidate's distances to a pivot bounds their distance from below, and so the
product from above.

Candidates that lie together, by their nearest pivot, form blocks of a fixed
size, whose row holds the vectors, the pivot table and its ranges. A query first
evaluates its home block; then the blocks whose bound can still beat its k-th
product, in rounds in the order of the bounds, until the next bound can't. In a
block, rows are evaluated in the order of their own bounds, until the same.
Bounds only order and rule out: products are computed exactly.

Equal vectors are folded first, to the k + 1 smallest ids of each (more can't be
among the results). Pivots come from a bounded sample: they decide how much is
ruled out, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_stored
from .common import prepare

#: Rows that the pivots are chosen from, and pivots.
SAMPLE_ROWS, PIVOTS = 4096, 32
#: Candidates of a block; blocks whose ranges are looked at in one task; queries that visit a block in one task.
BLOCK_ROWS, GROUP_BLOCKS, VISITORS = 1024, 1024, 1024
#: Rows of a block that are evaluated between two looks at the bound.
STEP = 64
#: Blocks that a query visits in the first round; each later round has this many times more.
GROWTH = 4
#: Bounds are widened by this share of the squared lengths, far above the rounding of doubles.
SLACK = 1e-9
#: Sums of products up to here are exact in doubles; beyond, Python's integers are used.
_EXACT = 2**53
_LEAST, _MOST = -(2**63), 2**63 - 1


def is_finite(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, as doubles that are whole numbers."""
    # floor() would end at the range of long integers.
    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y) + F.lit(0.0)

    return F.transform(vector, whole)


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of doubles, shorter ones padded with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Pivots:
    """Pivots far from each other, and distances to them from rescaled vectors.

    Lengths are taken in units of ``longest``, so squares neither overflow nor vanish.
    """

    def __init__(self, sample: np.ndarray, longest: float, count: int) -> None:
        self.longest = longest or 1.0
        rows = self._lifted(sample)
        chosen, nearest = [0], np.linalg.norm(rows - rows[0], axis=1)
        while len(chosen) < min(count, len(rows)) and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, np.linalg.norm(rows - rows[chosen[-1]], axis=1))
        self.rows = rows[chosen]

    def _lifted(self, vectors: np.ndarray) -> np.ndarray:
        rows = vectors / self.longest
        return np.column_stack([rows, np.sqrt(np.maximum(0, 1 - (rows**2).sum(axis=1)))])

    def _to(self, rows: np.ndarray) -> np.ndarray:
        squared = (rows**2).sum(axis=1)[:, None] - 2 * rows @ self.rows.T + (self.rows**2).sum(axis=1)
        return np.sqrt(np.maximum(0, squared))

    def of_candidates(self, vectors: np.ndarray) -> np.ndarray:
        return self._to(self._lifted(vectors))

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        return self._to(np.column_stack([vectors / self.longest, np.zeros(len(vectors))]))

    def limit(self, gaps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Greatest product (in units of longest²) at a distance of ``gaps`` or more, for queries of squared ``lengths``."""
        # A distance near zero is a root of rounding errors, so the slack is taken off before squaring as well.
        gaps = np.maximum(0, gaps - np.sqrt(SLACK) * 1e-2 * (1 + np.sqrt(lengths)))
        return (lengths + 1 - gaps**2) / 2 + SLACK * (1 + lengths)


def products(rows: np.ndarray, query: np.ndarray, reach: float) -> list[int]:
    """Exact inner products, kept within long integers; ``reach`` is at least every sum of absolute products."""
    if reach < _EXACT:
        return (rows @ query).astype(np.int64).tolist()
    whole = [int(x) for x in query.tolist()]
    sums = (sum(int(x) * y for x, y in zip(r, whole, strict=True)) for r in rows.tolist())
    return [min(max(x, _LEAST), _MOST) for x in sums]


def _best(found: list[tuple[int, int | None, bool]], k: int) -> list[tuple[int, int | None, bool]]:
    """The ``k`` best of (score, id, same): greater scores first, then smaller ids, null ids last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]


def _place(pivots: Pivots, width: int):
    """Rows get their cell (the nearest pivot) and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix([v.values.to_numpy(zero_copy_only=False) for v in batch.column("v")], width)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            table = np.where(asks[:, None], pivots.of_queries(own), pivots.of_candidates(own))
            cell = table.argmin(axis=1)
            arrays = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(table[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "cell", "far"])

    return run


_BLOCK = "asks boolean, block bigint, node bigint, v array<double>, ids array<bigint>, vectors binary, id_lists array<array<bigint>>, low array<double>, high array<double>, n int"


def _pack(pivots: Pivots, width: int):
    """Over rows sorted by (cell, distance): blocks of candidates, and each query with the block that it falls into."""
    names = [f.split()[0] for f in _BLOCK.split(", ")]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32()]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, vectors, ids = TaskContext.get().partitionId() << 32, [], []

        def block() -> pa.RecordBatch:
            own = np.array(vectors).reshape(len(vectors), width)
            table = pivots.of_candidates(own)
            return rows([(False, number, None, None, None, own.tobytes(), ids, table.min(axis=0), table.max(axis=0), len(ids))])

        for batch in batches:
            own, asking = _matrix([v.values.to_numpy(zero_copy_only=False) for v in batch.column("v")], width), []
            for i, (v, asks, node, kept) in enumerate(zip(own, *(batch.column(c).to_pylist() for c in ("asks", "node", "ids")), strict=True)):
                if asks:
                    asking.append((True, number, node, batch.column("v")[i].as_py(), None, None, None, None, None, None))
                    continue
                vectors.append(v)
                ids.append(kept)
                if len(ids) == BLOCK_ROWS:
                    yield block()
                    number, vectors, ids = number + 1, [], []
            if asking:
                yield rows(asking)
        if ids:
            yield block()

    return run


def _bounds(pivots: Pivots, width: int, scale2: float):
    """Over rows sorted by (group, part, kind): queries against the ranges of the group's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, ranges = None, [], None
        for batch in batches:
            for at, end, now in _stretches(batch, ("grp", "part", "asks")):
                if key != now[:2]:
                    key, parts, ranges = now[:2], [], None
                few = batch.slice(at, end - at)
                if not now[2]:
                    parts.append([few.column("block").to_numpy(), *(np.array(few.column(c).to_pylist()) for c in ("low", "high"))])
                    continue
                if not parts:
                    continue
                if ranges is None:
                    ranges = [np.concatenate(x) for x in zip(*parts, strict=True)]
                blocks, low, high = ranges
                own = _matrix([v.values.to_numpy(zero_copy_only=False) for v in few.column("v")], width)
                table, lengths = pivots.of_queries(own), ((own / pivots.longest) ** 2).sum(axis=1)
                need = few.column("need").to_numpy(zero_copy_only=False)
                home = few.column("block").to_numpy()
                out = []
                for i in range(len(own)):
                    gaps = np.maximum(0, np.maximum(low - table[i], table[i] - high)).max(axis=1)
                    limit = pivots.limit(gaps, lengths[i]) * scale2
                    open_ = ~(limit < need[i]) & (blocks != home[i])
                    out.append((np.full(open_.sum(), i), blocks[open_], limit[open_]))
                rows, visited, limits = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([few.column("node").take(pa.array(rows)), pa.array(visited), pa.array(limits)], names=["node", "block", "most"])

    return run


def _evaluate(pivots: Pivots, width: int, scale2: float, k: int):
    """Over rows sorted by (block, part, asks): visiting queries against the block's candidates, in the order of their bounds."""
    names = ["node", "score", "id", "same"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            for at, end, now in _stretches(batch, ("block", "part", "asks")):
                few = batch.slice(at, end - at)
                if key != now[:2]:
                    key, block = now[:2], None
                if not now[2]:
                    own = np.frombuffer(few.column("vectors")[0].as_py()).reshape(-1, width)
                    block = own, few.column("id_lists")[0].as_py(), pivots.of_candidates(own), np.abs(own).sum(axis=1).max()
                    continue
                if block is None:
                    continue
                vectors, ids, table, widest = block
                own = _matrix([v.values.to_numpy(zero_copy_only=False) for v in few.column("v")], width)
                mine, lengths = pivots.of_queries(own), ((own / pivots.longest) ** 2).sum(axis=1)
                need, out = few.column("need").to_numpy(zero_copy_only=False), []
                for i, node in enumerate(few.column("node").to_pylist()):
                    limit = pivots.limit(np.abs(table - mine[i]).max(axis=1), lengths[i]) * scale2
                    order, reach = np.argsort(-limit, kind="stable"), float(widest * np.abs(own[i]).max(initial=0.0))
                    best, least = [], need[i]
                    for s in range(0, len(order), STEP):
                        step = order[s : s + STEP]
                        if limit[step[0]] < least:
                            break
                        step = step[~(limit[step] < least)]
                        rows = vectors[step]
                        same = (rows == own[i]).all(axis=1).tolist()
                        scores = zip(products(rows, own[i], reach), step.tolist(), same, strict=True)
                        worth = [(x, y, alike) for x, j, alike in scores if not x < least for y in ids[j]]
                        best = _best(best + worth, k) if worth else best
                        # Scores at the end of the long integers stand for smaller ones too.
                        if len(best) == k and best[-1][0] > _LEAST:
                            least = best[-1][0] if least != least else max(least, best[-1][0])
                    out += [(node, *x) for x in best]
                if out:
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _stretches(batch: pa.RecordBatch, keys: tuple[str, ...]) -> Iterator[tuple[int, int, tuple]]:
    """Stretches of rows that are equal in ``keys``; a block's row is a stretch of its own."""
    columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
    if not batch.num_rows:
        return
    changed = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        yield s, e, tuple(c[s] for c in columns)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each node; Spark limits them before the shuffle."""
    best = Window.partitionBy("node").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def top_products(
    queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 256, pivots: int = PIVOTS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every query the ``k`` candidates of the greatest inner product.

    Components are ``floor(scale * x)``. Ranks start at 1; equal scores go to the
    smaller id, null ids last. A candidate with the query's id and vector is the
    query's own row and left out, once for each query. Vectors that are null or
    hold null or non-finite components take no part; zero and empty ones score 0.
    Shorter vectors are padded with zeros. Repeated query rows each get their
    results; fewer candidates than ``k`` are all returned; none give no rows. A
    score beyond the long integers counts as their end, and components whose
    scaled value is not finite count as non-finite. Extra columns are not read.
    """
    spark = queries.sparkSession
    prepare(spark)
    q, c = (
        df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
        .where(is_finite(F.col("v")))
        .select("id", scaled(F.col("v"), scale).alias("v"))
        .where(is_finite(F.col("v")))
        for df in (queries, candidates)
    )
    # One more than k, as a query's own row may be among them.
    first = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    kept = c.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    # Null ids are written as no id behind the others.
    folded = kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count(F.lit(1)).alias("rows"))
    padded = F.concat("ids", F.array_repeat(F.lit(None).cast("bigint"), (F.col("rows") - F.size("ids")).cast("int")))
    points = folded.select("v", padded.alias("ids"), F.lit(False).alias("asks"))
    asked = q.select("v").distinct().select("v", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(True).alias("asks"))
    # Numbered and stored: a node's number must not change when an executor is lost.
    nodes = cut_lineage(points.unionByName(asked).withColumn("node", F.monotonically_increasing_id()))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("unit")) * (x / F.col("unit")))
    here = ~F.col("asks")
    greatest = F.max(F.when(here, F.array_max(F.transform("v", F.abs))))
    width, unit, many, n_asking = nodes.agg(F.max(F.size("v")), greatest, F.count_if(here), F.count_if("asks")).first()
    if not many or not n_asking:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width, unit = max(1, width), unit or 1.0
    longest = unit * float(np.sqrt(nodes.where("not asks").withColumn("unit", F.lit(unit)).agg(F.max(squares)).first()[0])) * (1 + 1e-12)
    scale2 = (longest or 1.0) * (longest or 1.0)  # infinite where nothing smaller holds it
    sample = [r[0] for r in nodes.where("not asks").orderBy(F.xxhash64("v"), "node").limit(SAMPLE_ROWS).select("v").collect()]
    table = Pivots(_matrix(sample, width), longest, pivots)

    placed = nodes.mapInArrow(_place(table, width), "v array<double>, ids array<bigint>, asks boolean, node bigint, cell int, far double")
    ranged = placed.repartitionByRange("cell", "far", "node").sortWithinPartitions("cell", "far", "node")
    packed = cut_lineage(ranged.mapInArrow(_pack(table, width), _BLOCK))
    drop_stored(nodes)
    blocks = packed.where("not asks").select("block", "vectors", "id_lists")
    ranges = packed.where("not asks").select("block", "low", "high")
    # A query in a partition whose candidates ended before it has no home; it starts without one.
    asking = cut_lineage(packed.where("asks").select("node", "v", "block"))
    n_blocks = ranges.count()

    def visit(visits: DataFrame) -> DataFrame:
        """Tops of ``visits`` (node, v, need, block). Each part of a block's visitors gets a copy of the block."""
        per_block = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("parts"))
        copies = blocks.join(per_block, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        dealt = visits.join(per_block, "block").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")).drop("parts")
        met = copies.withColumn("asks", F.lit(False)).unionByName(dealt.withColumn("asks", F.lit(True)), allowMissingColumns=True)
        met = met.repartition("block", "part").sortWithinPartitions("block", "part", "asks")
        return met.mapInArrow(_evaluate(table, width, scale2, k + 1), "node bigint, score bigint, id bigint, same boolean")

    tops = cut_lineage(_top(visit(asking.withColumn("need", F.lit(None).cast("double"))), k + 1))

    def needs(best: DataFrame) -> DataFrame:
        """Each query's k-th product so far, rounded down; none before it has k + 1 rows."""
        worst = best.groupBy("node").agg(F.min(F.col("score").cast("double")).alias("worst"), F.count(F.lit(1)).alias("n"))
        down = F.col("worst") - F.abs("worst") * 1e-14
        bound = (F.col("n") > k) & (F.col("worst") > float(_LEAST))
        return worst.select("node", F.when(bound, down).alias("need"))

    def waiting(best: DataFrame) -> DataFrame:
        return asking.join(needs(best), "node", "left")

    # Ranges of GROUP_BLOCKS blocks meet queries, of which each task gets a part.
    groups, shares = -(-n_blocks // GROUP_BLOCKS), -(-n_asking // (8 * VISITORS)) or 1
    grouped = ranges.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    spread = waiting(tops).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(shares)).cast("int"))
    met = grouped.withColumn("asks", F.lit(False)).unionByName(spread.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    met = met.repartition("grp", "part").sortWithinPartitions("grp", "part", "asks")
    bounded = met.mapInArrow(_bounds(table, width, scale2), "node bigint, block bigint, most double")
    turn = Window.partitionBy("node").orderBy(F.col("most").desc(), "block")
    visits = cut_lineage(bounded.withColumn("turn", F.row_number().over(turn)))

    done, step = 0, GROWTH
    while True:
        pending = visits.where(F.col("turn") > done).join(waiting(tops).drop("block"), "node")
        # A bound that is not a number is greater than any in Spark, so nothing is ruled out by it.
        pending = pending.where(F.col("need").isNull() | (F.col("most") >= F.col("need")))
        now = pending.where(F.col("turn") <= done + step).select("node", "v", "need", "block")
        if pending.limit(1).count() == 0:
            break
        merged = cut_lineage(_top(tops.unionByName(visit(now)), k + 1))
        drop_stored(tops)
        tops, done, step = merged, done + step, step * GROWTH
    drop_stored(visits)
    drop_stored(packed)
    return _results(q, asking, tops, k)


def _results(queries: DataFrame, asked: DataFrame, tops: DataFrame, k: int) -> DataFrame:
    """Rows of the queries themselves: without one occurrence of their own row, ranked from 1."""
    # The complement of the score sorts like its negative and can't overflow.
    row = F.struct(F.bitwise_not("score").alias("less"), F.col("id").isNull().alias("none"), "id", "same", "score")
    lists = tops.groupBy("node").agg(F.sort_array(F.collect_list(row)).alias("found"))
    known = asked.join(lists, "node").select("v", "found")
    own = F.array_position(F.transform("found", lambda x: x["same"] & x["id"].eqNullSafe(F.col("id"))), F.lit(True))
    others = F.slice(F.filter("found", lambda x, i: i + 1 != F.col("own")), 1, k)
    rows = queries.join(known, "v").withColumn("own", own).select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "row"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("row.id").alias("vec_id"), F.col("row.score").alias("score"))
