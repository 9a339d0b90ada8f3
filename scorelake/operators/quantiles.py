"""Percentiles per key: exact with linear interpolation, and approximate."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .segments import null_safe_join

# Accuracy of the approximate form: its rank error is at most n / ACCURACY.
ACCURACY = 10_000

#: Bits of a double's significand, and of the middle and the low digit; the high digit has the rest and the exponent.
_BITS, _DIGIT = 53, 22
_LEAST_EXPONENT = -1022
#: High digits of values without an exponent: infinite ones, and NaN, which is the greatest as in Spark's order.
_INFINITE, _NAN = 1 << 24, 1 << 25


def _digits(v: Column) -> list[Column]:
    """Three whole numbers that sort like the double ``v``, the first before the second before the third.

    The exponent and the first nine bits of the significand, then twice 22 bits.
    A logarithm that is rounded up across a power of two only moves that value
    to the next exponent with a significand below one: the order holds.
    """
    size, sign = F.abs(v), F.when(v < 0, -1).otherwise(1)
    exponent = F.greatest(F.floor(F.log2(size)), F.lit(_LEAST_EXPONENT))
    # Powers of two scale exactly.
    bits = (size * F.pow(F.lit(2.0), -exponent) * F.lit(2.0**_BITS)).cast("bigint")
    high = (exponent - _LEAST_EXPONENT) * (1 << (_BITS + 2 - 2 * _DIGIT)) + F.shiftright(bits, 2 * _DIGIT)
    plain = ~F.isnan(v) & (size < float("inf")) & (v != 0)
    others = F.when(F.isnan(v), _NAN).when(v == 0, 0).otherwise(sign * F.lit(_INFINITE))
    mask = F.lit((1 << _DIGIT) - 1)
    return [
        F.when(plain, sign * high).otherwise(others).cast("int"),
        F.when(plain, sign * F.shiftright(bits, _DIGIT).bitwiseAND(mask)).otherwise(0).cast("int"),
        F.when(plain, sign * bits.bitwiseAND(mask)).otherwise(0).cast("int"),
    ]


def exact_percentiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation percentiles, by radix selection for keys of any size.

    Histograms of three digits of the value, from the high one on, are counted on
    the map side first. The ends of a bucket are known as well, so a wanted rank
    is found once it falls on one, or on a bucket of one value; only buckets with
    others go on to the next digit, and it ends when there are none. So the table
    is scanned once, twice or three times, but its rows are neither sorted nor
    stored, and what crosses the network are counts: for a key at most some
    thousand buckets for each power of two in the first round, and 2^22 in the
    others. Open buckets are stored, so that Spark broadcasts them by their real
    size, or else joins by key.
    """
    keys = list(keys)
    line = df.where(F.col(value).isNotNull()).select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_v"))
    digits = dict(zip(("_high", "_mid", "_low"), _digits(F.col("_v")), strict=True))
    places = [(F.col("_n") - 1) * F.lit(float(q)) for q in quantiles.values()]
    # The ends are ranks themselves, others lie between two.
    whole = [q in (0.0, 1.0) for q in quantiles.values()]
    ranks = {f"_r{i}a": F.floor(p) for i, p in enumerate(places)} | {f"_r{i}b": F.ceil(p) for i, p in enumerate(places) if not whole[i]}
    ends = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    first, last = F.col("_before"), F.col("_to") - 1

    def settled(counts: DataFrame, known: list[str]) -> DataFrame:
        """Per key the values at wanted ranks, and the buckets that are still open; ``_before`` rows of the key lie before each."""
        own = Window.partitionBy(*([*keys, *known[:-1]] or [F.lit(0)]))
        upto = F.sum("_c").over(own.orderBy(known[-1]).rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("_to", F.col("_before") + upto).withColumn("_before", F.col("_to") - F.col("_c"))
        # NaN equals NaN here, and a bucket of NaN holds nothing else.
        within = reduce(or_, [(r > first) & (r < last) for r in ranks.values()])
        counts = counts.withColumn("_open", within & (F.col("_lo") < F.col("_hi")))
        here = F.when(~F.col("_open"), True)

        def at(rank: Column) -> Column:
            return F.max(F.when((rank >= first) & (rank <= last) & here, F.when(rank == last, F.col("_hi")).otherwise(F.col("_lo"))))

        # A rank lies in one bucket, so what describes that bucket can be gathered number by number.
        about = [*known, "_before"]
        opened = [F.max(F.when(F.col("_open") & (r >= first) & (r <= last), F.col(c))).alias(f"{n}{c}") for n, r in ranks.items() for c in about]
        found = counts.groupBy(*keys, "_n").agg(*[at(r).alias(n) for n, r in ranks.items()], *opened)
        left = F.array(*[F.struct(*[F.col(f"{n}{c}").alias(c) for c in about]) for n in ranks])
        left = F.array_distinct(F.filter(left, lambda x: x["_before"].isNotNull()))
        return found.select(*keys, "_n", *ranks, left.alias("_left"))

    line = line.withColumn("_high", digits["_high"])
    counts = line.groupBy(*keys, "_high").agg(*ends)
    total = F.sum("_c").over(Window.partitionBy(*(keys or [F.lit(0)])))
    counts = counts.withColumns({"_n": total, "_before": F.lit(0).cast("bigint")})
    rounds, known = [cut_lineage(settled(counts, ["_high"]))], ["_high"]
    for digit in ("_mid", "_low"):
        left = cut_lineage(rounds[-1].select(*keys, "_n", F.inline("_left")))
        if left.isEmpty():
            break
        inside = null_safe_join(line, left, [*keys, *known]).withColumn(digit, digits[digit])
        known, line = [*known, digit], line.withColumn(digit, digits[digit])
        counts = inside.groupBy(*keys, *known, "_n", "_before").agg(*ends)
        rounds.append(cut_lineage(settled(counts, known)))
    rows = rounds[0].drop("_left")
    if len(rounds) > 1:
        later = reduce(DataFrame.unionByName, [r.drop("_left", "_n") for r in rounds[1:]])
        later = later.groupBy(*keys).agg(*[F.max(c).alias(f"_l{c}") for c in ranks])
        rows = null_safe_join(rows, cut_lineage(later), keys, "left") if keys else rows.crossJoin(later)
        rows = rows.withColumns({c: F.coalesce(c, f"_l{c}") for c in ranks})
    low = [F.col(f"_r{i}a") for i in range(len(places))]
    high = [F.col(f"_r{i}a" if whole[i] else f"_r{i}b") for i in range(len(places))]
    out = [(a + (b - a) * (p - F.floor(p))).alias(n) for n, a, b, p in zip(quantiles, low, high, places, strict=True)]
    return rows.select(*keys, *out)


def approx_percentiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Sketch percentiles: one pass, mergeable, bounded state per key."""
    return df.groupBy(*keys).agg(*[F.percentile_approx(value, float(q), accuracy).alias(n) for n, q in quantiles.items()])


#: Size of a stored sketch. Its rank error, and that of any number of them merged, is at most ``sketch_error`` of all rows in 99 of 100 cases.
SKETCH_SIZE = 1600


def sketch_error(size: int = SKETCH_SIZE) -> float:
    """Published rank error of a KLL sketch of this size."""
    return 2.296 / size**0.9723


def sketch_values(df: DataFrame, keys: list[str], value: str, size: int = SKETCH_SIZE) -> DataFrame:
    """``keys, sketch``: a mergeable summary of the values of each key, some kilobytes whatever their number.

    Store them per day, say, and merge what a report spans; the rows themselves
    are not read again. Null values are not counted.
    """
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def merged_percentiles(sketches: DataFrame, keys: list[str], quantiles: dict[str, float], size: int = SKETCH_SIZE) -> DataFrame:
    """Percentiles of each key over all of its stored sketches, and ``n``, the values that they stand for."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", size).alias("_sketch"))
    found = [F.kll_sketch_get_quantile_double("_sketch", F.lit(float(q))).alias(n) for n, q in quantiles.items()]
    return merged.select(*keys, F.kll_sketch_get_n_double("_sketch").alias("n"), *found)
