"""Merging charge tables and spreading charges over the hours they cover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlespan.functions import numbers, times
from idlespan.schema import CHARGE_PERIOD_COLUMNS, require_columns

_MEASURES = ("BilledCost", "EffectiveCost", "ConsumedQuantity",
             "SimulatedCPUUsage", "SimulatedMemoryUsage")


def merge_tables(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; columns a table lacks are null."""
    if not tables:
        raise ValueError("nothing to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def parse_charges(df: DataFrame) -> DataFrame:
    """Type the period and the measures; drop rows without period or billed cost."""
    require_columns(df, CHARGE_PERIOD_COLUMNS)
    kinds = dict(df.dtypes)
    typed = {c: times.parse_timestamp(F.col(c), kinds[c], times.CHARGE_TIME_FORMAT)
             for c in CHARGE_PERIOD_COLUMNS}
    typed |= {c: numbers.number(F.col(c)) for c in _MEASURES if c in kinds}
    needed = [c for c in (*CHARGE_PERIOD_COLUMNS, "BilledCost") if c in kinds]
    return df.withColumns(typed).dropna(subset=needed)


def with_hourly_cost(charges: DataFrame, distribute_cost: bool = True) -> DataFrame:
    """Add ``OriginalDurationHours`` and the cost of one hour, ``HourlyCost``."""
    timed = charges.withColumn(
        "OriginalDurationHours",
        times.period_hours(F.col("ChargePeriodStart"), F.col("ChargePeriodEnd")))
    cost = F.col("BilledCost")
    if distribute_cost:
        cost = cost / F.col("OriginalDurationHours")
    return timed.withColumn("HourlyCost", cost)


def expand_hours(charges: DataFrame, distribute_cost: bool = True,
                 spread_all: bool = False) -> DataFrame:
    """One row per charge and hour.

    ``HourlyTimestamp`` counts whole hours from the period's start and is not cut
    to the clock hour.  By default only ``HourlyCost`` is spread: other amounts are
    repeated on each hour.  ``spread_all`` divides those by the hours as well.
    """
    timed = with_hourly_cost(charges, distribute_cost)
    if spread_all:
        amounts = [c for c in ("BilledCost", "EffectiveCost", "ConsumedQuantity")
                   if c in timed.columns]
        timed = timed.withColumns(
            {c: F.col(c) / F.col("OriginalDurationHours") for c in amounts})
    hours = F.sequence(F.lit(0).cast("bigint"), F.col("OriginalDurationHours") - 1)
    return (
        timed.withColumn("_hour", F.explode(hours))
        .withColumn("HourlyTimestamp",
                    times.plus_hours(F.col("ChargePeriodStart"), F.col("_hour")))
        .drop("_hour")
    )


def hourly_summary(charges: DataFrame, distribute_cost: bool = True) -> DataFrame:
    """Charges, total and mean cost of every hour, in time order.

    Charges with the same start and length fall on the same hours, so they are
    added up before the expansion: what is expanded and shuffled is one row per
    (start, length), not one per charge.
    """
    same_hours = (
        with_hourly_cost(charges, distribute_cost)
        .groupBy("ChargePeriodStart", "OriginalDurationHours")
        .agg(F.count(F.lit(1)).alias("_rows"), numbers.sum_or_zero(F.col("HourlyCost")).alias("_cost"))
    )
    hours = F.sequence(F.lit(0).cast("bigint"), F.col("OriginalDurationHours") - 1)
    return (
        same_hours.withColumn("_hour", F.explode(hours))
        .groupBy(times.plus_hours(F.col("ChargePeriodStart"), F.col("_hour")).alias("HourlyTimestamp"))
        .agg(F.sum("_rows").alias("RecordCount"), F.sum("_cost").alias("TotalCost"))
        .withColumn("AvgCost", F.col("TotalCost") / F.col("RecordCount"))
        .orderBy("HourlyTimestamp")
    )
