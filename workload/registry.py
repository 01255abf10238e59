"""Names of the registered queries, their Spark side and their check in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bomatlas.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows."""

    def register(run: Query) -> Query:
        def with_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark)
            return run(spark, sf_dir)

        with_settings.__name__ = name
        QUERIES[name] = with_settings
        if check is not None:
            ORACLES[name] = check
        return run

    return register
