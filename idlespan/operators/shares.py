"""Counts, shares and top lists over a grouped table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlespan.functions import numbers


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value with their share; nulls are not counted in rows, but in the share's base.

    The total is a one-row aggregate of the counts, so a column of any cardinality will do.
    """
    grouped = df.groupBy(column).agg(F.count(F.lit(1)).alias("Count"))
    total = grouped.agg(F.sum("Count")).scalar()
    return (
        grouped.withColumn("Percent", F.col("Count") / total * 100.0)
        .filter(F.col(column).isNotNull())
    )


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values with their share; ties in value order."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column).agg(F.count(F.lit(1)).alias("Count"))
        .orderBy(F.desc("Count"), column).limit(n)
        .withColumn("Percent", F.col("Count") / total * 100.0)
    )


def cost_share(df: DataFrame, key: str, cost: str) -> DataFrame:
    """Cost per key and its share of all cost (0 when there is none)."""
    grouped = df.groupBy(key).agg(numbers.sum_or_zero(F.col(cost)).alias("TotalCost"))
    total = grouped.agg(F.sum("TotalCost")).scalar()
    return grouped.withColumn("CostPercent", numbers.share_percent(F.col("TotalCost"), total))


def top_services_by_cost(df: DataFrame, cost: str, n: int = 5) -> DataFrame:
    """The ``n`` services with the highest cost, with their share of all cost."""
    total = df.agg(numbers.sum_or_zero(F.col(cost))).scalar()
    return (
        df.groupBy("ServiceName")
        .agg(numbers.sum_or_zero(F.col(cost)).alias("TotalCost"), F.count(F.lit(1)).alias("Rows"))
        .orderBy(F.desc("TotalCost"), "ServiceName").limit(n)
        .withColumn("CostPercent", numbers.share_percent(F.col("TotalCost"), total))
    )


def count_and_waste(df: DataFrame, key: str, waste: str = "WastedCost") -> DataFrame:
    """Resources and waste per key, each with its share."""
    grouped = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("ResourceId").alias("Count"), numbers.sum_or_zero(F.col(waste)).alias("Cost"))
    return grouped.withColumns({
        f"{c}Percent": numbers.share_percent(F.col(c), grouped.agg(F.sum(c)).scalar()) for c in ("Count", "Cost")})
