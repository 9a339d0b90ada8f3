"""Ordered logic that survives hot keys.

A plain window puts every row of a key in one task. Here rows are range
partitioned on (keys, order) instead, so one key may span many segments. Each
segment is walked once, in order, and written with its local counts, sums and
previous values; what earlier segments add to its first key comes from one small
row per segment. So the table crosses the network once, and never again. The
walked segments are written out because their numbers must not change between
the two passes, even when an executor is lost. Select the columns you need
first: everything that is passed in gets written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..session import cut_lineage

#: Segment, whether a row is of the segment's first key, and whether it is the segment's first (1) or last (2) row.
SEG, LEAD, EDGE = "_seg", "_lead", "_edge"


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` where null matches null; right keys are dropped."""
    if how in ("left_semi", "left_anti"):
        right = right.select(*keys)
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def _differs(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Where two arrays differ, as grouping sees it: null equals null, and NaN equals NaN."""
    unequal = pc.fill_null(pc.not_equal(left, right), False)
    if pa.types.is_floating(left.type):
        both = pc.fill_null(pc.and_(pc.is_nan(left), pc.is_nan(right)), False)
        unequal = pc.and_(unequal, pc.invert(both))
    return pc.or_(unequal, pc.xor(pc.is_null(left), pc.is_null(right))).to_numpy(zero_copy_only=False)


def _shifted(column: pa.Array, before: pa.Array) -> pa.Array:
    return pa.concat_arrays([before, column.slice(0, len(column) - 1)])


def _rows(batch: pa.RecordBatch, names: list[str], at: int, n: int) -> dict[str, pa.Array]:
    return {c: batch.column(c).slice(at, n) for c in names}


class _Walk:
    """Local results of one segment, in order, with the state of the key that is open."""

    def __init__(self, keys: list[str], lags: dict[str, str], count: bool, total: str | None, xors: list[str]) -> None:
        self.keys, self.lags, self.count, self.total, self.xors = keys, lags, count, total, xors
        self.folded = [np.int64(0)] * len(xors)
        self.previous: dict[str, pa.Array] | None = None
        self.n, self.leading = 0, True
        self.parts: tuple[int, float | int, float | int | None] = (0, 0, None)

    def step(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
        """Whether each row is of the first key, and the local columns."""
        wanted = list(dict.fromkeys([*self.keys, *self.lags.values()]))
        before = self.previous or {c: pa.nulls(1, batch.column(c).type) for c in wanted}
        new = np.zeros(batch.num_rows, dtype=bool)
        for k in self.keys:
            new |= _differs(batch.column(k), _shifted(batch.column(k), before[k]))
        if self.previous is None:
            new[0] = False
        lead = np.full(batch.num_rows, self.leading) & ~np.logical_or.accumulate(new)
        starts = new.copy()
        starts[0] |= self.previous is None
        out = [pc.if_else(pa.array(starts), pa.nulls(len(starts), batch.column(c).type), _shifted(batch.column(c), before[c])) for c in self.lags.values()]
        index = np.arange(batch.num_rows)
        opened = np.maximum.accumulate(np.where(new, index, -1))
        place = np.where(opened >= 0, index - opened, self.n + index)
        if self.count:
            out.append(pa.array(place))
        if self.total:
            out += self._running(batch.column(self.total), np.cumsum(new))
        for i, c in enumerate(self.xors):
            upto = np.concatenate([[self.folded[i]], batch.column(c).to_numpy()])
            upto = np.bitwise_xor.accumulate(upto.astype(np.int64))
            # What was folded before the key's first row folds away again.
            base = np.where(opened >= 0, upto[np.maximum(opened, 0)], 0)
            out.append(pa.array(upto[:-1] ^ base))
            self.folded[i] = upto[-1] ^ base[-1]
        self.n, self.leading = int(place[-1]) + 1, bool(lead[-1])
        self.previous = _rows(batch, wanted, batch.num_rows - 1, 1)
        return lead, out

    def _running(self, column: pa.Array, run: np.ndarray) -> list[pa.Array]:
        """Count, sum and greatest of the values before each row of its key."""
        values = column.to_pandas(integer_object_nulls=True).astype(object if pa.types.is_decimal(column.type) else None)
        some = ~pd.isna(values) if pa.types.is_decimal(column.type) or pa.types.is_integer(column.type) else pd.Series(column.is_valid().to_numpy(zero_copy_only=False))
        whole = pa.types.is_integer(column.type)
        zeros = values.where(some, 0)
        zeros = zeros.astype("int64") if whole else zeros.astype("float64")
        n, s, m = self.parts
        # The open key's state stands in front as one more row; one behind takes the state after the last row.
        run = pd.Series(np.concatenate([[0], run]))
        counts = pd.Series(np.concatenate([[n], some.to_numpy().astype("int64")])).groupby(run).cumsum()
        sums = pd.Series(np.concatenate([np.array([s], dtype=zeros.dtype), zeros])).groupby(run).cumsum()
        lowest = np.iinfo("int64").min if whole else -np.inf
        tops = pd.Series(np.concatenate([np.array([lowest if m is None else m], dtype=zeros.dtype), zeros.where(some, lowest)])).groupby(run).cummax()
        upto = [x.groupby(run).shift(1, fill_value=e).to_numpy()[1:] for x, e in ((counts, 0), (sums, 0), (tops, lowest))]
        none = upto[0] == 0
        last = int(counts.iloc[-1])
        self.parts = (last, sums.iloc[-1], tops.iloc[-1] if last else None)
        kind = pa.int64() if whole else pa.float64()
        return [pa.array(upto[0]), pa.array(upto[1], kind, mask=none), pa.array(upto[2], kind, mask=none)]


def _walked(
    df: DataFrame, keys: list[str], order: list[Column], lags: dict[str, str], count: bool, total: str | None, xors: list[str] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """The stored segments with ``_seg``, ``_lead``, ``_edge`` and local columns ``_here_...``."""
    by, xors = [*[F.col(k) for k in keys], *order], xors or []
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    if keep is not None:
        ranged = df = ranged.select(*keep)
    fields = [StructField(SEG, IntegerType()), StructField(LEAD, BooleanType()), StructField(EDGE, IntegerType())]
    fields += [StructField(f"_here_{n}", df.schema[c].dataType) for n, c in lags.items()]
    fields += [StructField("_here_n", LongType())] if count else []
    if total:
        value = StructType.fromDDL("x bigint" if df.schema[total].dataType.typeName() in ("byte", "short", "integer", "long") else "x double")["x"].dataType
        fields += [StructField("_here_count", LongType()), StructField("_here_sum", value), StructField("_here_max", value)]
    fields += [StructField(f"_here_{c}", LongType()) for c in xors]
    schema = StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, segment, pending = _Walk(keys, lags, count, total, xors), TaskContext.get().partitionId(), None
        names = schema.names

        def made(batch, edge, lead, local) -> pa.RecordBatch:
            own = [pa.array(np.full(batch.num_rows, segment, dtype=np.int32)), pa.array(lead), pa.array(edge)]
            return pa.RecordBatch.from_arrays([*batch.columns, *own, *local], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            edge = np.zeros(batch.num_rows, dtype=np.int32)
            edge[0] |= pending is None
            if pending is not None:
                yield made(*pending)
            pending = (batch, edge, *walk.step(batch))
        if pending is not None:
            pending[1][-1] |= 2
            yield made(*pending)

    return cut_lineage(ranged.mapInArrow(run, schema))


def _carried(walked: DataFrame, keys: list[str], tail: dict[str, Column], combine: dict[str, Column]) -> DataFrame:
    """``walked`` with what earlier segments add to each segment's first key, on rows of that key.

    ``tail`` are a segment's values of its last key, its last row included;
    ``combine`` aggregates them over the earlier segments. The rows looked at
    are the first and last of each segment: at most two for each partition of
    the range exchange, which also bounds the broadcast.
    """
    edges = walked.where(F.col(EDGE) > 0)
    empty = {n: F.lit(None) for n in tail}
    asks = edges.where(F.col(EDGE).bitwiseAND(1) > 0).select(*keys, SEG, F.lit(0).alias("_kind"), *[v.alias(n) for n, v in empty.items()])
    tails = edges.where(F.col(EDGE).bitwiseAND(2) > 0).select(*keys, SEG, F.lit(1).alias("_kind"), *[v.alias(n) for n, v in tail.items()])
    # A segment asks before its own last key counts.
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SEG, "_kind").rowsBetween(Window.unboundedPreceding, -1)
    both = tails.unionByName(asks)
    carry = both.select(SEG, "_kind", *[c.over(upto).alias(n) for n, c in combine.items()]).where("_kind = 0").drop("_kind")
    out = walked.join(F.broadcast(carry), SEG, "left")
    return out.withColumns({n: F.when(F.col(LEAD), F.col(n)) for n in combine})


def _of(walked: DataFrame, out: DataFrame) -> DataFrame:
    """A result that :func:`..session.drop_stored` frees together with its segments."""
    out._stored_path = walked._stored_path
    return out


def with_row_index(
    df: DataFrame, order: list[Column], keys: list[str] | None = None, name: str = "row_idx", keep: list[str] | None = None
) -> DataFrame:
    """Dense 0-based index in ``order``, per key where keys are given.

    ``order`` must be total; add tie-breakers. With ``keep``, only these columns
    (the keys among them) are written and returned; others serve the order.
    """
    keys = keys or []
    walked = _walked(df, keys, order, {}, True, None, keep=keep)
    out = _carried(walked, keys, {"_carry": F.col("_here_n") + 1}, {"_carry": F.sum("_carry")})
    return _of(walked, out.select(*(df.columns if keep is None else keep), (F.col("_here_n") + F.coalesce("_carry", F.lit(0))).alias(name)))


def lag_over(df: DataFrame, keys: list[str], order: list[Column], cols: dict[str, str]) -> DataFrame:
    """Previous row's values per key: ``cols`` maps a new name to a column."""
    walked = _walked(df, keys, order, cols, True, None)
    values = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    out = _carried(walked, keys, {"_carry": values}, {"_carry": F.last("_carry", ignorenulls=True)})
    # Only the first row of the segment looks back over its border.
    first = F.col("_here_n") == 0
    here = {n: F.when(first, F.col("_carry")[n]).otherwise(F.col(f"_here_{n}")) for n in cols}
    return _of(walked, out.select(*df.columns, *[v.alias(n) for n, v in here.items()]))


def running_before(df: DataFrame, keys: list[str], order: list[Column], col: str) -> DataFrame:
    """Count, sum and maximum of ``col`` over the rows before each row of its key.

    Adds ``prev_n``, ``prev_sum`` and ``prev_max`` (sum and maximum are null
    before the first value).
    """
    walked = _walked(df, keys, order, {}, False, col)
    own = F.col(col).cast(walked.schema["_here_sum"].dataType)
    added = F.when(own.isNotNull(), F.coalesce("_here_sum", F.lit(0)) + own).otherwise(F.col("_here_sum"))
    tail = {"_cn": F.col("_here_count") + own.isNotNull().cast("bigint"), "_cs": added, "_cm": F.greatest("_here_max", own)}
    out = _carried(walked, keys, tail, {"_cn": F.sum("_cn"), "_cs": F.sum("_cs"), "_cm": F.max("_cm")})
    total = F.when(F.col("_here_sum").isNull(), F.col("_cs")).otherwise(F.col("_here_sum") + F.coalesce("_cs", F.lit(0)))
    return _of(walked, out.select(
        *df.columns,
        (F.col("_here_count") + F.coalesce("_cn", F.lit(0))).alias("prev_n"),
        total.alias("prev_sum"),
        F.greatest("_here_max", "_cm").alias("prev_max"),
    ))


def running_xor_before(df: DataFrame, keys: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    """Exclusive or of long, non-null ``cols`` over the rows before each row of its key, as ``prev_<col>``; 0 on the first row."""
    walked = _walked(df, keys, order, {}, False, None, xors=cols)
    tail = {f"_c_{c}": F.col(f"_here_{c}").bitwiseXOR(F.col(c)) for c in cols}
    out = _carried(walked, keys, tail, {n: F.bit_xor(n) for n in tail})
    before = [F.col(f"_here_{c}").bitwiseXOR(F.coalesce(f"_c_{c}", F.lit(0))).alias(f"prev_{c}") for c in cols]
    return _of(walked, out.select(*df.columns, *before))


def rank_values(df: DataFrame, keys: list[str], value: str, descending: bool = True) -> DataFrame:
    """``rank`` and ``dense_rank`` of each distinct (key, value).

    Ties are folded into counts first, so a value shared by a third of all rows
    is one row here; join it back on (keys, value) to rank the rows themselves.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    direction = F.col(value).desc() if descending else F.col(value).asc()
    ahead = running_before(counted, keys, [direction], "ties")
    return ahead.select(
        *keys,
        value,
        (F.coalesce("prev_sum", F.lit(0)) + 1).alias("rank"),
        (F.col("prev_n") + 1).alias("dense_rank"),
    )
