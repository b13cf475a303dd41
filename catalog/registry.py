"""Collects the queries: name -> function of (spark, folder), name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the charge table (see ``catalog.charges``) as a query."""
    from catalog.charges import charges

    def register(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(charges(spark, folder))

        run.__name__, run.__doc__ = name, function.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns, as the SQL does, so that sums in any order compare equal."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})
