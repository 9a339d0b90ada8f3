"""Vector columns: splitting, normalizing, validating, and reading predictions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class id, class name and threat category of a signal label.
SIGNAL_CLASSES = [
    (0, "CW_Radar", "Threat emitter"),
    (1, "Pulsed_Radar", "Threat emitter"),
    (2, "FMCW_Radar", "Threat emitter"),
    (3, "Phase_Coded_Radar", "Threat emitter"),
    (4, "Noise_Jammer", "Electronic attack"),
    (5, "Spot_Jammer", "Electronic attack"),
    (6, "Sweep_Jammer", "Electronic attack"),
    (7, "Comm_Signal", "Non-threat"),
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Compute ``value`` once per row and hand it to ``body``. An expression used
    inside a lambda would otherwise be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _doubles(c) -> Column:
    return _col(c).cast("array<double>")


def split_iq(df: DataFrame, col: str, half: int) -> DataFrame:
    """Add ``i_part`` and ``q_part``, the two halves of a vector."""
    return df.withColumns({"i_part": F.slice(col, 1, half), "q_part": F.slice(col, half + 1, half)})


def concat_iq(i_part, q_part) -> Column:
    return F.concat(_col(i_part), _col(q_part))


def norm(c) -> Column:
    """Euclidean length, added up in double."""
    return F.sqrt(F.aggregate(_doubles(c), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(df: DataFrame, col: str, eps: float | None = None, out: str | None = None) -> DataFrame:
    """Divide by the length. Without ``eps`` a zero vector stays as it is; with
    ``eps`` the length is clamped from below, as embedding normalization does."""
    vector = _doubles(col)
    if eps is None:
        unit = let(norm(col), lambda n: F.when(n > 0, F.transform(vector, lambda x: x / n)).otherwise(vector))
    else:
        unit = let(F.greatest(norm(col), F.lit(eps)), lambda n: F.transform(vector, lambda x: x / n))
    return df.withColumn(out or col, unit)


def wide_names(n: int) -> list[str]:
    half = n // 2
    return [f"i_{k}" for k in range(half)] + [f"q_{k}" for k in range(n - half)]


def to_wide(df: DataFrame, col: str, n: int) -> DataFrame:
    """Replace an array column by ``i_0..``, ``q_0..`` columns."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, *[F.get(col, F.lit(k)).alias(name) for k, name in enumerate(wide_names(n))])


def to_array(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Replace wide columns by one array column."""
    rest = [c for c in df.columns if c not in set(cols)]
    return df.select(*rest, F.array(*cols).alias(out))


def validate_shape(df: DataFrame, col: str, shape: list[int] | Column) -> tuple[DataFrame, DataFrame]:
    """Split rows by whether the vector's length is the product of ``shape``.

    ``shape`` is a literal shape or the registry's shape column already joined
    on. A missing vector counts as rejected.
    """
    dims = shape if isinstance(shape, Column) else F.array(*[F.lit(int(d)) for d in shape])
    wanted = F.aggregate(dims, F.lit(1).cast("long"), lambda acc, d: acc * d)
    fits = F.coalesce(F.size(col) == wanted, F.lit(False)) & F.col(col).isNotNull()
    return df.where(fits), df.where(~fits)


def class_frame(spark, classes=SIGNAL_CLASSES) -> DataFrame:
    """The class dimension: a fixed list of eight rows."""
    return spark.createDataFrame(list(classes), "class_id int, class_name string, category string")


def decode_labels(df: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """Left join to the class dimension; unknown labels keep null names."""
    return df.join(classes, df[label] == classes["class_id"], "left").drop("class_id")


def argmax(c) -> Column:
    """0-based index of the largest value, the first one on a tie."""
    return (F.array_position(_col(c), F.array_max(_col(c))) - 1).cast("int")


def softmax(c) -> Column:
    """Probabilities, shifted by the maximum so large logits do not overflow."""
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    shifted = let(F.array_max(_doubles(c)), lambda top: F.transform(_doubles(c), lambda x: F.exp(x - top)))
    return let(shifted, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def with_confidence(df: DataFrame, logits: str = "logits", label: str | None = "label") -> DataFrame:
    """Add ``pred``, ``confidence`` (largest probability) and, with labels, ``correct``."""
    out = df.withColumns({"pred": argmax(logits), "confidence": F.array_max(softmax(logits))})
    if label is None or label not in df.columns:
        return out
    return out.withColumn("correct", F.coalesce(F.col("pred") == F.col(label), F.lit(False)))


def preview(c, k: int = 8) -> Column:
    """First ``k`` values as signed text with three decimals."""
    return F.array_join(F.transform(F.slice(_col(c), 1, k), lambda x: F.format_string("%+.3f", x.cast("double"))), " ")


def sq_error(a, b) -> Column:
    """Sum (not mean) of squared differences."""
    pairs = F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    pairs = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def prefix_sum(df: DataFrame, col: str, out: str = "prefix") -> DataFrame:
    """Running sum inside each vector, in time linear in its length. It stays within the row: no shuffle.

    One cumulative sum over the values of a whole Arrow batch, less what came
    before each vector, would lose digits; so each vector is summed by itself.
    """

    @F.pandas_udf("array<double>")
    def summed(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.cumsum(np.asarray(v, dtype="float64")))

    return df.withColumn(out, summed(_doubles(col)))
