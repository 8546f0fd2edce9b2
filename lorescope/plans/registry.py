"""Registration of named queries together with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorescope.plans.views import twin, view

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


class Inputs:
    """Tables and views of one folder, read by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(inputs)`` under ``name``, with the SQL that must agree with it."""

    def register(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            TWINS[name] = twin(sql)
        return fn

    return register
