"""Pairs of a Spark query and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortline.workload.campus import Campus

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a ``Campus`` under its own name."""

    def register(build: Callable[[Campus], DataFrame]) -> Callable[[Campus], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Campus(spark, sf_dir))

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register
