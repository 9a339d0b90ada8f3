"""The model registry: metadata rows, loaders, and memory figures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio
from ..schemas import REGISTRY
from . import nets

# The ten known models with category, input shape, output and
# memory estimate in MB.
KNOWN_MODELS = [
    ("ew_classifier", "signal", [128], "8-class logits (radar/jammer/comms)", 50.0),
    ("signal_denoiser", "signal", [128], "128-dim denoised signal", 100.0),
    ("threat_prioritizer", "signal", [128], "scalar priority score [0,1]", 350.0),
    ("rf_fingerprinter", "signal", [128], "32-dim emitter embedding", 120.0),
    ("anomaly_detector", "signal", [128], "scalar anomaly score", 100.0),
    ("resnet18", "image_classification", [3, 224, 224], "1000-class ImageNet logits", 300.0),
    ("mobilenetv3", "image_classification", [3, 224, 224], "1000-class ImageNet logits", 150.0),
    ("efficientnet_b0", "image_classification", [3, 224, 224], "1000-class ImageNet logits", 200.0),
    ("yolov8_nano", "object_detection", [3, 640, 640], "detection boxes (x,y,w,h,conf,cls)", 200.0),
    ("yolov8_small", "object_detection", [3, 640, 640], "detection boxes (x,y,w,h,conf,cls)", 400.0),
]


@dataclass
class Model:
    """A scorable model.

    ``forward(weights, x)`` maps a float batch ``(n, prod(input_shape))`` to
    ``(n, k)`` or ``(n,)``. ``output`` names what comes back: ``logits``,
    ``vector`` or ``score``.
    """

    name: str
    forward: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    input_shape: tuple[int, ...] = (128,)
    output: str = "vector"
    category: str = "signal"
    memory_mb: float = 0.0
    output_desc: str = ""
    version: int = 1
    prepare: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]] | None = None
    #: The same as ``forward`` on a device, where there is such a form.
    forward_cuda: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray] | None = None

    @property
    def width(self) -> int:
        return int(np.prod(self.input_shape))


class ModelRegistry:
    """Models by name. Metadata is also available as a DataFrame."""

    def __init__(self) -> None:
        self.models: dict[str, Model] = {}

    def register_model(self, model: Model) -> Model:
        if model.output not in ("logits", "vector", "score"):
            raise ValueError(f"unknown output kind {model.output!r}")
        self.models[model.name] = model
        return model

    def in_category(self, category: str) -> list[Model]:
        return [m for m in self.models.values() if m.category == category]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(m.name, m.category, list(m.input_shape), m.output_desc, float(m.memory_mb)) for m in self.models.values()]
        return spark.createDataFrame(rows, REGISTRY)


def known_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN_MODELS, REGISTRY)


def signal_registry(weights: dict[str, dict[str, np.ndarray]], width: int = 128) -> ModelRegistry:
    """The five signal models over the given weights (those present only)."""
    registry = ModelRegistry()
    memory = {name: mb for name, _, _, _, mb in KNOWN_MODELS}
    descs = {name: d for name, _, _, d, _ in KNOWN_MODELS}
    for name, (forward, prepare, output) in nets.SIGNAL_MODELS.items():
        if name in weights:
            registry.register_model(
                Model(name, forward, weights[name], (width,), output, "signal", memory[name], descs[name], prepare=prepare)
            )
    return registry


def total_memory(registry: DataFrame, by: str | None = None, memory: str = "estimated_memory_mb") -> DataFrame:
    keys = [by] if by else []
    return registry.groupBy(*keys).agg(F.count(F.lit(1)).alias("models"), F.sum(memory).alias("memory_mb"))


def memory_share(registry: DataFrame, memory: str = "estimated_memory_mb") -> DataFrame:
    """Each model's percent of all memory; the total is a scalar, not a window."""
    total = registry.agg(F.sum(memory)).scalar()
    return registry.withColumn("share_pct", safe_ratio(F.col(memory) * 100, total))


# Weight growth, runtime context and buffer in MB.
WEIGHT_FACTOR, CONTEXT_MB, BUFFER_MB = 1.2, 300.0, 100.0


def memory_need(registry: DataFrame, batch: int, in_bytes: Column, out_bytes: Column, by: list[str] | None = None, memory: str = "estimated_memory_mb") -> DataFrame:
    """Memory to hold a set of models plus one batch of inputs and outputs."""
    per_mb = F.lit(float(1024 * 1024))
    return registry.groupBy(*(by or [])).agg(
        (
            F.sum(F.col(memory) * WEIGHT_FACTOR)
            + F.sum(in_bytes) * batch / per_mb
            + F.sum(out_bytes) * batch / per_mb
            + F.lit(CONTEXT_MB + BUFFER_MB)
        ).alias("need_mb")
    )
