"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``edges``; the root is the component's smallest node.

    Large stars hang each greater neighbour on the smallest node in sight, small
    stars each smaller one; the two alternate until nothing changes, which takes
    about log n rounds. Only a sum goes to the driver. Every round's edges are
    stored in the shared folder.
    """
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links, before = cut_lineage(both), None
    while True:
        links, old = cut_lineage(_small_star(_large_star(links))), links
        drop_stored(old)
        # A change makes some end smaller or an edge fewer, so equal sums of both mean the end.
        row = links.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if before == tuple(row):
            break
        before = tuple(row)
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _large_star(links: DataFrame) -> DataFrame:
    around = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Each greater neighbour v of u goes to the smallest node next to u.
    return around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # Every edge points from the greater node u to a smaller v.
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
