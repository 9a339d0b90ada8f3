"""Greedy placement of models on devices under a memory budget, many nodes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The four orderings a plan can use.
STRATEGIES = ("priority", "largest_first", "greedy", "balanced")


def _turn(strategy: str, size: str, priority: str | None, tie: str) -> Column:
    """A value that sorts the models of a node in the order they get their turn."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "greedy":
        return F.struct(F.col(tie))
    if strategy == "priority":
        # A missing priority sorts as 0, whatever is recorded for it later.
        rank = F.coalesce(F.col(priority), F.lit(0)) if priority else F.lit(0)
        return F.struct((-rank).alias("rank"), F.col(tie))
    return F.struct((-F.col(size)).alias("rank"), F.col(tie))


class FreeSpace:
    """Free memory of a node's devices: a tree in which each inner place holds the more of its two below."""

    def __init__(self, budgets: list[float]) -> None:
        self.width = 1
        while self.width < len(budgets):
            self.width *= 2
        none = float("-inf")
        self.most = [none] * self.width + [float(b) for b in budgets] + [none] * (self.width - len(budgets))
        for i in range(self.width - 1, 0, -1):
            self.most[i] = max(self.most[2 * i], self.most[2 * i + 1])

    def take(self, need: float, emptiest: bool) -> int:
        """The first device with room for ``need`` (or the emptiest, the first of them), -1 where none has; its space shrinks."""
        most = self.most
        if not most[1] >= need:
            return -1
        wanted, at = (most[1] if emptiest else need), 1
        while at < self.width:
            at = 2 * at if most[2 * at] >= wanted else 2 * at + 1
        most[at] -= need
        found = at - self.width
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return found


def plan_placement(
    models: DataFrame,
    budgets: list[float],
    strategy: str = "priority",
    node: str = "node",
    model: str = "model_id",
    size: str = "memory_mb",
    priority: str | None = None,
) -> DataFrame:
    """Add ``device``: ``cuda:<k>``, or ``cpu`` where no device has room.

    A model is placed on the first device with room (for ``balanced`` with
    several devices: the emptiest, the first of equally empty ones). A model
    without a size fits nowhere. The choice for a model needs all choices before
    it, so a node's models pass one task in the order of their turns, as a sorted
    stream: what is held is the node's free space, a tree over its devices, and
    one batch of rows. Each row crosses the network once and gets its device on
    the way; nodes run side by side.
    """
    emptiest, turn = strategy == "balanced", _turn(strategy, size, priority, model)
    names = models.columns
    work = models.select("*", F.col(node).alias("_node"), F.col(size).cast("double").alias("_need"), turn.alias("_turn"))
    line = work.repartition("_node").sortWithinPartitions("_node", "_turn").drop("_turn")
    labels = [f"cuda:{i}" for i in range(len(budgets))] + ["cpu"]
    at_node, at_need = len(names), len(names) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free, last = FreeSpace(budgets), None
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, needs = batch.column(at_node), batch.column(at_need).to_numpy(zero_copy_only=False)
            runs = nodes.dictionary_encode().indices.to_pylist()
            chosen, before = np.full(batch.num_rows, -1), None
            for i, (now, need) in enumerate(zip(runs, needs.tolist(), strict=True)):
                if i == 0:
                    # The first row of a batch may go on with the last one's node.
                    value = nodes[0].as_py()
                    free = free if last is not None and last[0] == value else FreeSpace(budgets)
                elif now != before:
                    free = FreeSpace(budgets)
                before = now
                if free.most[1] >= need:
                    chosen[i] = free.take(need, emptiest)
            last = (nodes[-1].as_py(),)
            device = pa.array([labels[c] for c in chosen.tolist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], device], names=[*names, "device"])

    schema = StructType([*models.schema.fields, StructField("device", StringType())])
    return line.mapInArrow(run, schema)


def placement_totals(placed: DataFrame, by: list[str] | None = None, size: str = "memory_mb") -> DataFrame:
    """Models and MB on devices against cpu."""
    on_gpu = F.col("device") != "cpu"
    return placed.groupBy(*(by or [])).agg(
        F.count_if(on_gpu).alias("models_on_gpu"),
        F.count_if(~on_gpu).alias("models_on_cpu"),
        F.coalesce(F.sum(F.when(on_gpu, F.col(size))), F.lit(0)).alias("gpu_mb"),
        F.coalesce(F.sum(F.when(~on_gpu, F.col(size))), F.lit(0)).alias("cpu_mb"),
    )
