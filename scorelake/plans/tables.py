"""The test tables read as signals, runs, tasks, executors, models and telemetry.

Each view has a DataFrame form and an SQL form for the comparison queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HALF = 32  # in-phase values per test vector; the rest is quadrature
MODES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
BASELINE_MODE = "5-LOW"
DEVICES = ["A", "N", "R"]
LABELS = list(range(10))
TASK_ORDER = ["run_id", "partition_idx", "model_id", "executor_id", "samples", "inference_time"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_path(sf_dir: str, name: str) -> str:
    """The same table for a stream, be it a file or a folder of files: as a pattern, since a stream takes no plain file."""
    return f"{sf_dir}/{name}.parque[t]"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("signal_id"), F.col("embedding").alias("features"), F.col("label").cast("int").alias("label"))


def wide_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of 128 values: the test vector in phase, its mirror in quadrature."""
    return signals(spark, sf_dir).withColumn("features", F.concat("features", F.reverse("features")))


#: Blocks of vectors on either side of :func:`task_signals` at least, and vectors of a block at most (about).
SIDE_BLOCKS, SIDE_VECTORS = 8, 65536


def task_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 128-value signal per task: the vector its model maps to in phase, the
    one its executor maps to in quadrature.

    Vectors never travel with tasks: a grid of blocks has a column for each part
    of the models' vectors and a row for each part of the executors'. Each vector
    goes to the blocks of its column or row, each task as bare keys to its one block.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.count(F.lit(1))).scalar()
    t = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_suppkey").alias("executor_id"),
        F.pmod("l_partkey", n).alias("_i"),
        F.pmod("l_suppkey", n).alias("_q"),
    )
    side = F.greatest(F.lit(SIDE_BLOCKS), F.ceil(e.agg(F.count(F.lit(1)) / SIDE_VECTORS).scalar())).cast("int")
    part = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), side).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    kinds = dict(t.dtypes)
    wanted = t.where("_i IS NOT NULL AND _q IS NOT NULL").select((part("_i") * side + part("_q")).alias("_block"), F.lit(2).alias("_kind"), "run_id", "executor_id",
                                                                 F.col("_i").cast("bigint").alias("_i"), F.col("_q").cast("bigint").alias("_q"), none("array<float>").alias("_v"))
    other = F.explode(F.sequence(F.lit(0), side - 1)).alias("_other")
    known = e.where("vec_id IS NOT NULL").select("vec_id", "embedding", part("vec_id").alias("_own"), other)
    for kind, block in enumerate([F.col("_own") * side + F.col("_other"), F.col("_other") * side + F.col("_own")]):
        wanted = wanted.unionByName(known.select(block.alias("_block"), F.lit(kind).alias("_kind"), none(kinds["run_id"]).alias("run_id"), none(kinds["executor_id"]).alias("executor_id"),
                                                 F.col("vec_id").cast("bigint").alias("_i"), none("bigint").alias("_q"), F.col("embedding").cast("array<float>").alias("_v")))
    dealt = wanted.repartition("_block").sortWithinPartitions("_block", "_kind")
    met = dealt.mapInArrow(_attach, f"run_id {kinds['run_id']}, executor_id {kinds['executor_id']}, _iv array<float>, _qv array<float>")
    return met.select("run_id", "executor_id", F.concat("_iv", "_qv").alias("features"))


def _attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tasks with their vectors. Of each block, both sides' vectors (kinds 0 and 1) stand before its tasks (2)."""
    sides: list = [[], []]
    stock: list = [None, None]
    at = None
    for batch in batches:
        block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
            if a == b:
                continue
            if block[a] != at:
                at, sides, stock = block[a], [[], []], [None, None]
            rows = batch.slice(a, b - a)
            if kind[a] < 2:
                sides[kind[a]].append((rows.column(4), rows.column(6)))
                continue
            for s in range(2):
                if stock[s] is None and sides[s]:
                    ids = pa.concat_arrays([x for x, _ in sides[s]]).to_numpy()
                    order = np.argsort(ids, kind="stable")
                    stock[s] = ids[order], pa.concat_arrays([v for _, v in sides[s]]).take(pa.array(order))
                    sides[s] = []
            if stock[0] is None or stock[1] is None:
                continue
            for first in range(0, len(rows), 4096):
                few = rows.slice(first, 4096)
                task, found = np.arange(len(few)), []
                # An id that several vectors have gives a row for each, as in a join.
                for s in range(2):
                    ids = few.column(4 + s).to_numpy()[task]
                    low, high = (np.searchsorted(stock[s][0], ids, side=x) for x in ("left", "right"))
                    times = high - low
                    ends = np.cumsum(times)
                    found = [f.repeat(times) for f in found] + [np.arange(ends[-1] if len(ends) else 0) - (ends - times).repeat(times) + low.repeat(times)]
                    task = task.repeat(times)
                if len(task):
                    own = pa.array(task)
                    yield pa.RecordBatch.from_arrays([few.column(2).take(own), few.column(3).take(own), *[stock[s][1].take(pa.array(found[s])) for s in range(2)]], names=["run_id", "executor_id", "_iv", "_qv"])


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("device_mode"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") == "F", F.lit("failed")).alias("error"),
        F.col("o_totalprice").alias("elapsed_time"),
        F.col("o_orderdate").alias("run_ts"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("partition_idx"),
        F.col("l_suppkey").alias("executor_id"),
        F.col("l_partkey").alias("model_id"),
        F.col("l_quantity").cast("long").alias("samples"),
        F.col("l_extendedprice").alias("inference_time"),
        (F.col("l_tax") + F.col("l_discount")).alias("load_time"),
        F.col("l_returnflag").alias("device"),
        F.col("l_linestatus").alias("cached"),
        F.col("l_shipdate").alias("ts"),
    )


def executors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(
        F.col("s_suppkey").alias("executor_id"),
        F.col("s_name").alias("executor_name"),
        F.col("n_name").alias("hostname"),
        F.col("r_name").alias("site"),
        F.col("s_acctbal").alias("capacity"),
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("model_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("node"),
        F.col("p_size").cast("double").alias("memory_mb"),
        F.col("p_retailprice").alias("priority"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("executor_id"),
        F.col("event_type").alias("metric"),
        "value",
        "props",
    )


SIGNALS = "signals AS (SELECT vec_id AS signal_id, embedding AS features, label FROM embeddings)"
RUNS = (
    "runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS device_mode, o_orderstatus AS status, "
    "CASE WHEN o_orderstatus = 'F' THEN 'failed' END AS error, o_totalprice AS elapsed_time, o_orderdate AS run_ts FROM orders)"
)
TASKS = (
    "tasks AS (SELECT l_orderkey AS run_id, l_linenumber AS partition_idx, l_suppkey AS executor_id, l_partkey AS model_id, "
    "CAST(l_quantity AS BIGINT) AS samples, l_extendedprice AS inference_time, l_tax + l_discount AS load_time, "
    "l_returnflag AS device, l_linestatus AS cached, l_shipdate AS ts FROM lineitem)"
)
EXECUTORS = (
    "executors AS (SELECT s_suppkey AS executor_id, s_name AS executor_name, n_name AS hostname, r_name AS site, s_acctbal AS capacity "
    "FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)
MODELS = (
    "models AS (SELECT p_partkey AS model_id, p_name AS name, p_type AS category, p_brand AS node, "
    "CAST(p_size AS DOUBLE) AS memory_mb, p_retailprice AS priority FROM part)"
)
TELEMETRY = "telemetry AS (SELECT event_id, ts, user_id AS executor_id, event_type AS metric, value, props FROM events)"
TASK_ORDER_SQL = "run_id, partition_idx, model_id, executor_id, samples, inference_time"
