"""Label and prediction evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_histogram(df: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class; a class without rows shows 0. Classes are the left side,
    already-counted labels the right, so nothing large is joined."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    out = classes.join(counts, classes["class_id"] == counts[label], "left")
    return out.select("class_id", F.coalesce("n", F.lit(0)).alias("n"))


def confusion(preds: DataFrame, labels: list[int], label: str = "label") -> DataFrame:
    """True label x predicted label counts, one ``pred_k`` column per label.

    Predictions outside ``labels``, null ones too, are counted in ``pred_other``.
    """
    declared = F.coalesce(F.col("pred").isin(list(labels)), F.lit(False))
    return preds.groupBy(label).agg(
        *[F.count_if(F.col("pred") == k).alias(f"pred_{k}") for k in labels], F.count_if(~declared).alias("pred_other")
    )
