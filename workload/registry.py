"""The list of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.views import duck_sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Source:
    """The tables and views of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, oracle: str | None = None):
    """Register a function ``Source -> DataFrame`` under ``name``."""

    def register(build: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Source(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = duck_sql(oracle)
        return build

    return register
