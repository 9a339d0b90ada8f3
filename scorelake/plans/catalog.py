"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship_package(spark)
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return fn(spark, sf_dir)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add


def rnd(c: Column | str, digits: int = 4) -> Column:
    """Round for comparison with the same steps as :func:`rnd_sql`, so both
    engines treat a value halfway between two results alike."""
    value = F.col(c) if isinstance(c, str) else c
    scale = float(10**digits)
    return F.floor(value.cast("double") * scale + 0.5) / scale


def rnd_sql(expr: str, digits: int = 4) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(({expr})::DOUBLE * {scale} + 0.5) / {scale})"
