"""Fitting models from labelled vectors."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nets
from .registry import Model

# A centroid model has one row per class; more classes than this is not one.
MAX_CLASSES = 10_000


def centroid_table(df: DataFrame, label: str = "label", col: str = "features") -> DataFrame:
    """Mean of each dimension per class. Partial sums combine before the
    shuffle, so a class with most of the rows moves no more than any other."""
    flat = df.where(F.col(label).isNotNull()).select(label, F.posexplode(col).alias("dim", "x"))
    return flat.groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def fit_centroids(df: DataFrame, label: str = "label", col: str = "features", name: str = "centroid") -> Model:
    """Nearest-centroid classifier (largest dot product), trained in one aggregate."""
    table = centroid_table(df, label, col)
    packed = table.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("c"))
    rows = packed.orderBy(label).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if [r[label] for r in rows] != list(range(len(rows))):
        raise ValueError("class labels must be 0..k-1")
    centers = np.array([[cell["mean"] for cell in r["c"]] for r in rows])
    return Model(name, nets.centroid, {"centers": centers}, (centers.shape[1],), "logits")


def fit_classifier(df: DataFrame, layers: list[int], label: str = "label", col: str = "features", max_iter: int = 60, seed: int = 42):
    """Train a small perceptron from a labelled table; returns the fitted model."""
    ready = df.select(array_to_vector(col).alias("features"), F.col(label).cast("double").alias("label"))
    trainer = MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, blockSize=256, seed=seed)
    return trainer.fit(ready)


def classify(model, df: DataFrame, id_cols: tuple[str, ...] = ("signal_id",), label: str = "label", col: str = "features") -> DataFrame:
    ready = df.withColumn("features", array_to_vector(col))
    out = model.transform(ready)
    pred = F.col("prediction").cast("int")
    return out.select(*id_cols, label, pred.alias("pred"), (pred == F.col(label)).alias("correct"))


def fit_reconstructor(df: DataFrame, k: int, col: str = "features"):
    """Principal components, the trainable form of a denoiser."""
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(df.select(array_to_vector(col).alias("_v")))


def reconstructor_model(pca, name: str = "pca_denoiser") -> Model:
    """Project on the components and back, as a scorable model."""
    basis = np.array(pca.pc.toArray())
    return Model(name, _project, {"basis": basis}, (basis.shape[0],), "vector")


def _project(w: nets.Weights, x: np.ndarray) -> np.ndarray:
    return (x @ w["basis"]) @ w["basis"].T


def reconstruction_error_model(pca, name: str = "pca_anomaly") -> Model:
    basis = np.array(pca.pc.toArray())
    return Model(name, _residual, {"basis": basis}, (basis.shape[0],), "score")


def _residual(w: nets.Weights, x: np.ndarray) -> np.ndarray:
    diff = _project(w, x) - x
    return (diff * diff).sum(axis=1)
