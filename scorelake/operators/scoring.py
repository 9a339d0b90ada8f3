"""Distributed batched scoring: one pass over the data, rows out, nothing collected.

Only the id columns and the vector cross into Python, as Arrow batches whose
values are viewed as one matrix without copying row by row. Weights travel once
as a broadcast and are prepared once per Python worker.
"""

from __future__ import annotations

import hashlib
import os
import socket
import time
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import WEIGHTS
from .registry import Model, ModelRegistry

# Prepared model sets that a worker keeps.
KEPT_SETS = 4
# Weights are held by the driver and every executor; larger sets are refused.
MAX_WEIGHT_BYTES = 1 << 30

TASK_SCHEMA = (
    "struct<partition_idx:int,attempt:int,executor_id:string,hostname:string,pid:int,device:string,model:string,"
    "samples:bigint,batches:bigint,load_time:double,inference_time:double>"
)

_prepared: dict[tuple, dict[str, dict[str, np.ndarray]]] = {}


# -- weights ------------------------------------------------------------------


def weights_frame(spark: SparkSession, weights: dict[str, dict[str, np.ndarray]], version: int = 1) -> DataFrame:
    rows = [
        (model, version, layer, list(map(int, data.shape)), data.astype("float32").ravel().tolist())
        for model, layers in weights.items()
        for layer, data in layers.items()
    ]
    return spark.createDataFrame(rows, WEIGHTS)


def load_weights(table: DataFrame, version: int | None = None, max_bytes: int = MAX_WEIGHT_BYTES) -> dict[str, dict[str, np.ndarray]]:
    """Read a weights table into arrays, after checking its size.

    Without a ``version`` each model has its highest one. More than ``max_bytes``
    of weights, or a layer stored twice, is an error.
    """
    if version is not None:
        table = table.where(F.col("version") == version)
    else:
        latest = table.groupBy("model").agg(F.max("version").alias("version"))
        table = table.join(latest, ["model", "version"], "left_semi")
    size = table.agg(F.coalesce(F.sum(F.size("data").cast("long")), F.lit(0))).first()[0] * 4
    if size > max_bytes:
        raise ValueError(f"weights take {size} bytes, more than the {max_bytes} allowed on one executor")
    out: dict[str, dict[str, np.ndarray]] = {}
    for row in table.select("model", "layer", "shape", "data").toLocalIterator():
        if row["layer"] in out.get(row["model"], {}):
            raise ValueError(f"layer {row['layer']} of {row['model']} is stored twice")
        out.setdefault(row["model"], {})[row["layer"]] = np.asarray(row["data"], dtype="float32").reshape(row["shape"])
    return out


def broadcast_weights(spark: SparkSession, models: list[Model]):
    size = sum(a.nbytes for m in models for a in m.weights.values())
    if size > MAX_WEIGHT_BYTES:
        raise ValueError(f"weights take {size} bytes, more than the {MAX_WEIGHT_BYTES} allowed on one executor")
    return spark.sparkContext.broadcast({m.name: m.weights for m in models})


def content_token(models: list[Model]) -> str:
    """What identifies prepared weights on a worker: names, versions and a digest of all values."""
    digest = hashlib.sha1(usedforsecurity=False)
    for m in models:
        digest.update(f"{m.name}:{m.version}:{getattr(m.prepare, '__qualname__', None)}".encode())
        for layer in sorted(m.weights):
            digest.update(f"{layer}{m.weights[layer].shape}{m.weights[layer].dtype}".encode())
            digest.update(np.ascontiguousarray(m.weights[layer]).tobytes())
    return digest.hexdigest()


# -- devices ------------------------------------------------------------------


def choose_device(mode: str, has_gpu: bool) -> str:
    """Device of a task. ``gpu_only`` without a device is an error, not a fallback."""
    if mode == "cpu_only":
        return "cpu"
    if mode == "hybrid":
        return "cuda" if has_gpu else "cpu"
    if mode == "gpu_only":
        if not has_gpu:
            raise RuntimeError("gpu_only was asked for but the task holds no gpu resource")
        return "cuda"
    raise ValueError(f"unknown device mode {mode!r}")


def _task_device(mode: str) -> str:
    context = TaskContext.get()
    return choose_device(mode, bool(context and context.resources().get("gpu")))


# -- the Python side of a task ------------------------------------------------


def _matrix(column: pa.Array, width: int, dtype: str) -> np.ndarray:
    """View a list column as ``(rows, width)``; rows of another length are an error."""
    values = column.flatten()
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or values.null_count or (lengths != width).any():
        raise ValueError(f"expected vectors of {width} values; run validate_shape first")
    return np.ascontiguousarray(values.to_numpy(zero_copy_only=False).reshape(len(column), width), dtype=dtype)


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k, dtype="int32")), pa.array(values.ravel()))


def _logit_columns(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First maximum and its softmax probability."""
    pred = logits.argmax(axis=1).astype("int32")
    shifted = logits.astype("float64") - logits.max(axis=1, keepdims=True)
    return pred, 1.0 / np.exp(shifted).sum(axis=1)


LOGIT_FIELDS = ("pred", "confidence", "logits")


def _to_arrow(kind: str, out: np.ndarray, outputs: tuple[str, ...] = LOGIT_FIELDS) -> pa.Array:
    if kind == "score":
        return pa.array(out.reshape(len(out)).astype("float64"))
    if kind == "vector":
        return _lists(out)
    fields = {}
    if "confidence" in outputs:
        pred, confidence = _logit_columns(out)
        fields = {"pred": pa.array(pred), "confidence": pa.array(confidence)}
    elif "pred" in outputs:
        fields = {"pred": pa.array(out.argmax(axis=1).astype("int32"))}
    if "logits" in outputs:
        fields["logits"] = _lists(out)
    return pa.StructArray.from_arrays([fields[f] for f in outputs], list(outputs))


def _spark_type(kind: str, dtype: str, outputs: tuple[str, ...] = LOGIT_FIELDS) -> str:
    element = "float" if dtype == "float32" else "double"
    types = {"pred": "int", "confidence": "double", "logits": f"array<{element}>"}
    return {
        "score": "double",
        "vector": f"array<{element}>",
        "logits": "struct<" + ",".join(f"{f}:{types[f]}" for f in outputs) + ">",
    }[kind]


def _worker_weights(handle, token: str, specs, dtype: str) -> tuple[dict[str, dict[str, np.ndarray]], dict[str, float]]:
    """Prepared weights of this worker; the first task on a worker pays for them."""
    key = (token, dtype, tuple(s["name"] for s in specs))
    times = {s["name"]: 0.0 for s in specs}
    if key not in _prepared:
        stored = handle.value
        ready = {}
        for spec in specs:
            begun = time.perf_counter()
            # Preparation multiplies layers together, so it runs in double.
            weights = {k: np.asarray(v, dtype="float64") for k, v in stored[spec["name"]].items()}
            if spec["prepare"]:
                weights = spec["prepare"](weights)
            ready[spec["name"]] = {k: np.ascontiguousarray(v, dtype=dtype) for k, v in weights.items()}
            times[spec["name"]] = time.perf_counter() - begun
        while len(_prepared) >= KEPT_SETS:
            _prepared.pop(next(iter(_prepared)))
        _prepared[key] = ready
    else:
        _prepared[key] = _prepared.pop(key)  # last used, last to go
    return _prepared[key], times


def _run_batches(spec, weights, x: np.ndarray, batch_size: int) -> np.ndarray:
    parts = [spec["forward"](weights, x[i : i + batch_size].copy()) for i in range(0, len(x), batch_size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _scorer(handle, token: str, specs, ids: list[str], batch_size: int, dtype: str, device_mode: str, metrics: bool, outputs: tuple[str, ...]):
    """The function each task runs over its Arrow batches.

    On a device, models that have a form for it use that; task rows name the
    device that did each model's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        device = _task_device(device_mode)
        weights, load = _worker_weights(handle, token, specs, dtype)
        on_device = {s["name"] for s in specs if device == "cuda" and s["cuda"]}
        running = [{**s, "forward": s["cuda"]} if s["name"] in on_device else s for s in specs]
        spent = {s["name"]: [0, 0, 0.0] for s in specs}
        id_types = None
        for batch in batches:
            id_types = [batch.schema.field(c).type for c in ids]
            if batch.num_rows == 0:
                continue
            x = _matrix(batch.column(len(ids)), specs[0]["width"], dtype)
            columns = []
            for spec in running:
                begun = time.perf_counter()
                out = _run_batches(spec, weights[spec["name"]], x, batch_size)
                tally = spent[spec["name"]]
                tally[0] += len(x)
                tally[1] += -(-len(x) // batch_size)
                tally[2] += time.perf_counter() - begun
                columns.append(_to_arrow(spec["output"], out, outputs))
            names = ids + [s["name"] for s in specs]
            arrays = [batch.column(i) for i in range(len(ids))] + columns
            if metrics:
                names, arrays = names + ["task"], arrays + [pa.nulls(len(x), _task_type())]
            yield pa.RecordBatch.from_arrays(arrays, names)
        if metrics and id_types is not None:
            yield _task_rows(ids, id_types, specs, dtype, outputs, on_device, load, spent)

    return run


def _task_type() -> pa.DataType:
    kinds = [
        ("partition_idx", pa.int32()), ("attempt", pa.int32()), ("executor_id", pa.string()), ("hostname", pa.string()),
        ("pid", pa.int32()), ("device", pa.string()), ("model", pa.string()), ("samples", pa.int64()),
        ("batches", pa.int64()), ("load_time", pa.float64()), ("inference_time", pa.float64()),
    ]
    return pa.struct(kinds)


def _arrow_type(kind: str, dtype: str, outputs: tuple[str, ...]) -> pa.DataType:
    element = pa.float32() if dtype == "float32" else pa.float64()
    if kind == "score":
        return pa.float64()
    if kind == "vector":
        return pa.list_(element)
    types = {"pred": pa.int32(), "confidence": pa.float64(), "logits": pa.list_(element)}
    return pa.struct([(f, types[f]) for f in outputs])


def _task_rows(ids, id_types, specs, dtype, outputs, on_device, load, spent) -> pa.RecordBatch:
    """One trailing row per model that says how this task ran."""
    context, host, pid = TaskContext.get(), socket.gethostname(), os.getpid()
    rows = [
        {
            "partition_idx": context.partitionId(), "attempt": context.attemptNumber(), "executor_id": f"{host}_{pid}",
            "hostname": host, "pid": pid, "device": "cuda" if name in on_device else "cpu", "model": name, "samples": samples, "batches": batches,
            "load_time": load[name], "inference_time": seconds,
        }
        for name, (samples, batches, seconds) in spent.items()
    ]
    n = len(rows)
    arrays = [pa.nulls(n, t) for t in id_types] + [pa.nulls(n, _arrow_type(s["output"], dtype, outputs)) for s in specs]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(rows, _task_type())], [*ids, *[s["name"] for s in specs], "task"])


# -- public operators ---------------------------------------------------------


def score_all(
    df: DataFrame,
    models: list[Model] | ModelRegistry,
    input_col: str = "features",
    id_cols: tuple[str, ...] = ("signal_id",),
    batch_size: int = 1024,
    device_mode: str = "cpu_only",
    dtype: str = "float32",
    metrics: bool = False,
    outputs: tuple[str, ...] = LOGIT_FIELDS,
) -> DataFrame:
    """Score every row with every model in a single pass.

    Returns the id columns and one column per model: a struct of ``pred``,
    ``confidence`` and ``logits``, an array, or a double. All models must share
    the input's modality. With ``metrics`` each task adds one trailing row per
    model, ids null and ``task`` filled; see :func:`split_scored`.
    """
    return Scorer(df.sparkSession, models, batch_size, device_mode, dtype, outputs=outputs)(df, input_col, id_cols, metrics)


class Scorer:
    """Models ready to score any number of tables: weights are checked and broadcast once."""

    def __init__(self, spark: SparkSession, models: list[Model] | ModelRegistry, batch_size: int = 1024, device_mode: str = "cpu_only", dtype: str = "float32", profile=None, outputs: tuple[str, ...] = LOGIT_FIELDS) -> None:
        """``profile``: a resource profile that asks for devices, passed on to the tasks.
        ``outputs``: the fields of a classifier's struct; others are never built.
        """
        if not outputs or set(outputs) - set(LOGIT_FIELDS):
            raise ValueError(f"outputs are some of {LOGIT_FIELDS}")
        self.outputs = tuple(outputs)
        self.models = list(models.models.values()) if isinstance(models, ModelRegistry) else list(models)
        if len({m.width for m in self.models}) != 1:
            raise ValueError("models scored together must read the same input shape; score_registry takes a mixed registry")
        self.handle = broadcast_weights(spark, self.models)
        self.token = content_token(self.models)
        self.batch_size, self.device_mode, self.dtype, self.profile = batch_size, device_mode, dtype, profile

    def __call__(self, df: DataFrame, input_col: str = "features", id_cols: tuple[str, ...] = ("signal_id",), metrics: bool = False) -> DataFrame:
        specs = [{"name": m.name, "forward": m.forward, "prepare": m.prepare, "output": m.output, "width": m.width, "cuda": m.forward_cuda} for m in self.models]
        slim = df.select(*id_cols, input_col)
        if dict(slim.dtypes)[input_col] not in ("array<float>", "array<double>"):
            slim = slim.withColumn(input_col, F.col(input_col).cast("array<double>"))
        kinds = dict(slim.dtypes)
        schema = [f"`{c}` {kinds[c]}" for c in id_cols] + [f"`{m.name}` {_spark_type(m.output, self.dtype, self.outputs)}" for m in self.models]
        if metrics:
            schema.append(f"task {TASK_SCHEMA}")
        run = _scorer(self.handle, self.token, specs, list(id_cols), self.batch_size, self.dtype, self.device_mode, metrics, self.outputs)
        return slim.mapInArrow(run, ", ".join(schema), profile=self.profile)


def score_registry(inputs: dict[str, DataFrame], registry: ModelRegistry, input_col: str = "features", id_col: str = "signal_id", **kwargs) -> tuple[DataFrame, list[str]]:
    """Score a registry of mixed modalities: each category's table with the models of that category.

    Returns one row per (category, id, model) with ``pred`` and ``confidence`` of
    classifiers, ``vector`` or ``score`` of the others, and the names of the
    models that have no data. Models of a category that read the same shape share
    one pass over its table. Ids are compared as text, since tables may differ.
    """
    rows, without = [], []
    for category in dict.fromkeys(m.category for m in registry.models.values()):
        models = registry.in_category(category)
        if category not in inputs:
            without += [m.name for m in models]
            continue
        widths = list(dict.fromkeys(m.width for m in models))
        for width in widths:
            group = [m for m in models if m.width == width]
            # A vector that no model of the category reads is an error of the first, not a row that vanishes.
            others = [w for w in widths if w != width]
            fits = ~F.coalesce(F.size(input_col).isin(others), F.lit(False)) if width == widths[0] else F.size(input_col) == width
            table = inputs[category].where(fits) if others else inputs[category]
            scored = Scorer(table.sparkSession, group, **kwargs)(table, input_col, (id_col,))
            entries = F.array(*[_model_entry(m) for m in group])
            opened = scored.select(F.lit(category).alias("category"), F.col(id_col).cast("string").alias("id"), F.inline(entries))
            rows.append(opened)
    if not rows:
        raise ValueError("no category of the registry has data")
    return reduce(DataFrame.unionByName, rows), without


def _model_entry(m: Model) -> Column:
    c = F.col(f"`{m.name}`")
    logits = m.output == "logits"
    return F.struct(
        F.lit(m.name).alias("model"),
        (c["pred"] if logits else F.lit(None).cast("int")).alias("pred"),
        (c["confidence"] if logits else F.lit(None).cast("double")).alias("confidence"),
        (c if m.output == "vector" else F.lit(None)).cast("array<double>").alias("vector"),
        (c if m.output == "score" else F.lit(None)).cast("double").alias("score"),
    )


def score(df: DataFrame, model: Model, input_col: str = "features", id_cols: tuple[str, ...] = ("signal_id",), batch_size: int = 1024, device_mode: str = "cpu_only", dtype: str = "float32", outputs: tuple[str, ...] = LOGIT_FIELDS) -> DataFrame:
    """Score with one model; a classifier's struct is opened into columns (those of ``outputs``)."""
    out = score_all(df, [model], input_col, id_cols, batch_size, device_mode, dtype, outputs=outputs)
    if model.output == "logits":
        return out.select(*id_cols, f"`{model.name}`.*")
    return out.withColumnRenamed(model.name, "output")


def score_blobs(df: DataFrame, model: Model, decode: Callable[[bytes], np.ndarray], content_col: str = "content", id_cols: tuple[str, ...] = ("path",), batch_size: int = 64, device_mode: str = "cpu_only", dtype: str = "float32") -> DataFrame:
    """Score stored files or encoded images with one model.

    ``decode`` turns a file's bytes into the model's input; it runs inside the
    scoring batch, so only ``batch_size`` decoded inputs exist at a time. The
    column ``device`` names what did the work: on a device, a model's form for it.
    """
    handle = broadcast_weights(df.sparkSession, [model])
    spec = {"name": model.name, "forward": model.forward, "cuda": model.forward_cuda, "prepare": model.prepare, "output": model.output, "width": model.width}
    token, ids = content_token([model]), list(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on_device = _task_device(device_mode) == "cuda" and spec["cuda"] is not None
        forward, device = (spec["cuda"], "cuda") if on_device else (spec["forward"], "cpu")
        weights, _ = _worker_weights(handle, token, [spec], dtype)
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                x = np.stack([np.asarray(decode(c.as_py()), dtype=dtype).ravel() for c in part.column(len(ids))])
                if x.shape[1] != spec["width"]:
                    raise ValueError(f"decoder gave {x.shape[1]} values, the model reads {spec['width']}")
                out = _to_arrow(spec["output"], forward(weights[spec["name"]], x))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(ids)], out, pa.array([device] * len(x))], [*ids, spec["name"], "device"])

    slim = df.select(*id_cols, content_col)
    kinds = dict(slim.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ids] + [f"`{model.name}` {_spark_type(model.output, dtype)}", "device string"])
    scored = slim.mapInArrow(run, schema)
    if model.output == "logits":
        return scored.select(*id_cols, f"`{model.name}`.*", "device")
    return scored.withColumnRenamed(model.name, "output")


def score_column(spark: SparkSession, model: Model, batch_size: int = 1024) -> Callable[[str | Column], Column]:
    """The column form, for use inside ``select``: logits, vector or score."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    handle = broadcast_weights(spark, [model])
    spec = {"name": model.name, "prepare": model.prepare}
    forward, scalar, token = model.forward, model.output == "score", content_token([model])

    def make():
        weights = _worker_weights(handle, token, [spec], "float32")[0][model.name]
        return lambda x: forward(weights, np.array(x, dtype="float32"))

    kind = T.FloatType() if scalar else T.ArrayType(T.FloatType())
    return predict_batch_udf(make, return_type=kind, batch_size=batch_size, input_tensor_shapes=[[model.width]])


def split_scored(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions and task rows of a scored frame read back from storage."""
    return scored.where(F.col("task").isNull()).drop("task"), scored.where(F.col("task").isNotNull()).select("task.*")


def with_task_metrics(df: DataFrame, models, path: str, **kwargs) -> tuple[DataFrame, DataFrame]:
    """Score once, write predictions and task rows to ``path``, read both back.

    Writing keeps only the rows of each task's successful attempt, so retried
    tasks are not counted twice.
    """
    scored = score_all(df, models, metrics=True, **kwargs)
    scored.write.mode("errorifexists").parquet(path)
    return split_scored(df.sparkSession.read.schema(scored.schema).parquet(path))
