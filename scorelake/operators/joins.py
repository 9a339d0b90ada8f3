"""Joins between models, data, runs, tasks and executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio
from ..session import cut_lineage
from .segments import lag_over, running_before, with_row_index

#: Name of what no declared value covers.
OTHER = "other"


def bind_inputs(data_sizes: DataFrame, registry: DataFrame, on: str = "category") -> DataFrame:
    """Which models read which input: registry rows inner-joined to input sizes.

    ``data_sizes`` has one row per category or name, already counted, so the
    data itself is never copied once per model. Unknown names drop out.
    """
    return registry.join(data_sizes, on, "inner")


def models_with_data(registry: DataFrame, data: DataFrame, on: str = "name") -> DataFrame:
    return registry.join(data.select(on), on, "left_semi")


def models_without_data(registry: DataFrame, data: DataFrame, on: str = "name") -> DataFrame:
    return registry.join(data.select(on), on, "left_anti")


def with_registry(df: DataFrame, registry: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Left lookup; ``defaults`` replaces each missing looked-up column."""
    joined = df.join(registry.select(on, *defaults), on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def mode_matrix(df: DataFrame, row: str, mode: str, value: Column, modes: list[str], missing: str = "-") -> DataFrame:
    """Row x mode table of a summed value; absent cells read ``missing``.

    Modes that aren't declared, null ones too, are summed in ``other``.
    """
    cells = _by_mode(df, row, mode, value, modes)
    return cells.select(row, *[F.coalesce(F.col(m).cast("string"), F.lit(missing)).alias(m) for m in [*modes, OTHER]])


def _by_mode(df: DataFrame, row: str, mode: str, value: Column, modes: list[str]) -> DataFrame:
    undeclared = ~F.coalesce(F.col(mode).isin(modes), F.lit(False))
    declared = [F.sum(F.when(F.col(mode) == m, value)).alias(m) for m in modes]
    return df.groupBy(row).agg(*declared, F.sum(F.when(undeclared, value)).alias(OTHER))


def pivot_modes(df: DataFrame, row: str, mode: str, value: str, modes: list[str]) -> DataFrame:
    """The same as numbers; absent cells are null."""
    return _by_mode(df, row, mode, F.col(value), modes)


def band_of(c: Column | str, bands: list[tuple[float | None, str]]) -> Column:
    """Name of the first band whose upper limit is at least the value.

    The band list is a handful of literals, so the range join folds into one
    CASE expression: no join, no shuffle, no broadcast.
    """
    value = F.col(c) if isinstance(c, str) else c
    out = None
    for upper, name in bands:
        if upper is None:
            return F.lit(name) if out is None else out.otherwise(F.lit(name))
        out = F.when(value <= upper, F.lit(name)) if out is None else out.when(value <= upper, F.lit(name))
    return out


def with_band(df: DataFrame, col: str, bands: list[tuple[float | None, str]], out: str = "band") -> DataFrame:
    return df.withColumn(out, band_of(col, bands))


#: Cells of a grid are at least so small a share of the greatest number that they count exactly in a double.
_CELL_BITS = 50


def in_bands(df: DataFrame, col: str, bands: DataFrame, low: str = "low", high: str = "high", by: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` beside every row of ``bands`` with ``low <= col < high``: a join with a table of intervals.

    A missing limit is none; bands may overlap, and empty ones hold nothing. Each
    band lies in the one or two cells of a grid whose cells are as wide as it, up
    to the next power of two. A value looks into its cell of each grid that has a
    band, so the join is by (grid, cell) with the limits checked after it, never
    a product. Columns of both sides; null and NaN values match nothing.

    Pairs are as many as values times bands that hold them. With ``by``, columns
    of ``bands``, they are counted and summed without being built: ``by``, ``n``
    and ``total`` (of ``col``) for each ``by`` that has a pair, at the cost of a sort.
    """
    taken = set(df.columns) & set(bands.columns)
    if taken:
        raise ValueError(f"columns on both sides: {sorted(taken)}")
    value = F.col(col).cast("double")
    rows = df.where(value.isNotNull() & ~F.isnan(value))
    if by is not None:
        return _band_totals(rows.select(value.alias("_at")), bands, low, high, by)
    least, most = rows.agg(F.min(value), F.max(value)).first()
    if least is None:
        least = most = 0.0
    # Limits beyond all values rule nothing out.
    edges = bands.withColumn("_lo", F.greatest(F.coalesce(F.col(low).cast("double"), F.lit(least)), F.lit(least)))
    edges = edges.withColumn("_hi", F.least(F.coalesce(F.col(high).cast("double"), F.lit(most)), F.lit(most)))
    reach = F.lit(float(max(abs(least), abs(most), 1e-290)))
    width = F.greatest(F.col("_hi") - F.col("_lo"), reach * F.lit(2.0**-_CELL_BITS))
    edges = edges.where(F.col("_lo") <= F.col("_hi")).withColumn("_grid", F.ceil(F.log2(width)).cast("int"))

    def cell(c: Column) -> Column:
        return F.floor(c / F.pow(F.lit(2.0), F.col("_grid")))

    # Stored, so that Spark broadcasts it by its real size or deals both sides by cell.
    placed = cut_lineage(edges.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi"))))).drop("_lo", "_hi"))
    # One number for each width there is, of some two thousand at most.
    grids = sorted(r[0] for r in placed.select("_grid").distinct().collect())
    if not grids:
        return rows.join(bands, F.lit(False))
    asked = rows.withColumn("_grid", F.explode(F.array(*[F.lit(g) for g in grids]))).withColumn("_cell", cell(value))
    inside = (F.col(low).isNull() | (value >= F.col(low))) & (F.col(high).isNull() | (value < F.col(high)))
    return asked.join(placed, ["_grid", "_cell"]).where(inside).drop("_grid", "_cell")


def _band_totals(values: DataFrame, bands: DataFrame, low: str, high: str, by: list[str]) -> DataFrame:
    """What stands before a band's end less what stands before its start, on one sorted line of values and limits.

    Sums run from zero outwards, negative values in a pass of their own, so no
    sum holds values greater than those of the band it is taken for.
    """
    lo, hi = F.col(low).cast("double"), F.col(high).cast("double")
    limits = [F.struct(F.coalesce(lo, F.lit(float("-inf"))).alias("_at"), F.lit(-1).alias("_sign")), F.struct(F.coalesce(hi, F.lit(float("nan"))).alias("_at"), F.lit(1).alias("_sign"))]
    # Empty and reversed bands hold nothing. A limit stands before the values that equal it.
    held = bands.where(lo.isNull() | hi.isNull() | (lo < hi)).select(*by, F.explode(F.array(*limits)).alias("_edge"))
    edges = held.select(*by, "_edge.*", F.lit(0).alias("_side"), F.lit(None).cast("double").alias("_value"))
    # The last column deals a value that many rows share over several segments.
    placed = values.select("_at", F.lit(0).alias("_sign"), F.lit(1).alias("_side"), F.col("_at").alias("_value"))
    side, line = [F.col("_at"), F.col("_side"), F.col("_tie")], placed.unionByName(edges, allowMissingColumns=True).select(*by, "_sign", "_side", "_value", F.when(F.col("_at") == 0, F.lit(0.0)).otherwise(F.col("_at")).alias("_at"), F.monotonically_increasing_id().alias("_tie"))
    upward = running_before(line.where("_side = 0 OR _value >= 0"), [], side, "_value")
    parts = [upward.where("_side = 0").select(*by, "_sign", "prev_n", "prev_sum")]
    if values.where("_at < 0").limit(1).count():
        downward = running_before(line.where("_side = 0 OR _value < 0"), [], [c.desc() for c in side], "_value")
        parts.append(downward.where("_side = 0").select(*by, (-F.col("_sign")).alias("_sign"), "prev_n", "prev_sum"))
    signed = reduce(DataFrame.unionByName, parts).groupBy(*by)
    out = signed.agg(F.sum(F.col("_sign") * F.col("prev_n")).alias("n"), F.sum(F.col("_sign") * F.coalesce("prev_sum", F.lit(0.0))).alias("total"))
    return out.where("n > 0")


def with_batches(df: DataFrame, order: list[Column], batch_size: int, keys: list[str] | None = None) -> DataFrame:
    """Add ``row_idx`` and ``batch_idx`` (rows ``[k*bs, (k+1)*bs)``)."""
    indexed = with_row_index(df, order, keys)
    return indexed.withColumn("batch_idx", F.floor(F.col("row_idx") / F.lit(batch_size)).cast("long"))


def batch_count(n: Column | str, batch_size: int) -> Column:
    value = F.col(n) if isinstance(n, str) else n
    return F.ceil(value / F.lit(float(batch_size))).cast("long")


def align_batches(sizes: DataFrame, batch_size: int, rows: str = "n_rows") -> DataFrame:
    """Batch k holds the models that still have rows: batch_idx, models, rows.

    Works on row counts alone. Between two batches where some model ends, the
    same models run full batches, so models are folded by their batch count and
    each stretch is unfolded once. No row per (model, batch) is ever built.
    """
    last = batch_count(F.col(rows), batch_size)
    ends = (
        sizes.where(F.col(rows) > 0)
        .groupBy(last.alias("n_batches"))
        .agg(F.count(F.lit(1)).alias("ending"), F.sum(F.col(rows) - (last - 1) * batch_size).alias("tail_rows"))
    )
    later = running_before(ends, [], [F.col("n_batches").desc()], "ending")
    later = later.withColumn("outlive", F.coalesce("prev_sum", F.lit(0))).drop("prev_n", "prev_sum", "prev_max")
    spans = lag_over(later, [], [F.col("n_batches")], {"prev_end": "n_batches"})
    spans = spans.withColumns({"first": F.coalesce("prev_end", F.lit(0)), "final": F.col("n_batches") - 1})
    # Two unfolding steps keep each generated array short.
    step = 100_000
    starts = F.explode(F.sequence("first", "final", F.lit(step).cast("long"))).alias("start")
    chunked = spans.select("*", starts)
    stop = F.least(F.col("start") + (step - 1), F.col("final"))
    each = chunked.select("*", F.explode(F.sequence("start", stop)).alias("batch_idx"))
    full = (F.col("outlive") + F.col("ending")) * batch_size
    return each.select(
        "batch_idx",
        (F.col("outlive") + F.col("ending")).alias("models"),
        F.when(F.col("batch_idx") == F.col("final"), F.col("outlive") * batch_size + F.col("tail_rows"))
        .otherwise(full)
        .alias("rows"),
    )


def dense_grid(facts: DataFrame, key: str, axis: str, values: list, measures: dict[str, Column]) -> DataFrame:
    """Every key x declared axis value and ``other``, with 0 where no fact exists.

    The axis is a short declared list of strings; facts of other values, null
    ones too, are those of ``other``. Each key's facts are folded into one map
    of axis value to measures and read back once per listed value, so the grid
    costs one aggregation and no product of two tables.
    """
    known = F.when(F.col(axis).isin(values), F.col(axis)).otherwise(F.lit(OTHER))
    values = [*values, OTHER]
    cells = facts.withColumn(axis, known).groupBy(key, axis).agg(*[m.alias(n) for n, m in measures.items()])
    folded = cells.groupBy(key).agg(
        *[
            F.max(F.when(F.col(axis) == v, F.struct(*measures))).alias(f"_cell{i}")
            for i, v in enumerate(values)
        ]
    )
    listed = F.array(*[F.struct(F.lit(v).alias(axis), F.col(f"_cell{i}").alias("m")) for i, v in enumerate(values)])
    rows = folded.select(key, F.explode(listed).alias("_g"))
    return rows.select(key, f"_g.{axis}", *[F.coalesce(F.col(f"_g.m.{n}"), F.lit(0)).alias(n) for n in measures])


def vs_baseline(df: DataFrame, mode: str, value: str, baseline: str) -> DataFrame:
    """Ratio of each row to the baseline mode's value (baseline = 1.0, 0 if it is 0)."""
    base = df.where(F.col(mode) == baseline).agg(F.max(value)).scalar()
    return df.withColumn("baseline", base).withColumn("speedup", safe_ratio(F.col(value), F.col("baseline")))


def task_star(tasks: DataFrame, runs: DataFrame, executors: DataFrame) -> DataFrame:
    """Tasks with the columns of their run and executor; AQE picks each strategy."""
    return tasks.join(runs, "run_id", "inner").join(executors, "executor_id", "inner")
