"""Merging, hour expansion, rollups and hourly aggregates (T and A operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.sql import using
from idlespan.operators import overprovisioned, rollup, shares, timegrid

_ROLLUP_DIGITS = {"TotalHourlyCost": 8, "AvgCPUUsage": 8, "AvgMemoryUsage": 8,
                  "TotalEffectiveCost": 6, "TotalBilledCost": 6, "TotalConsumedQuantity": 6}


def rounds(digits: dict[str, int]) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c, d in digits.items())


def rolled(charges: DataFrame) -> DataFrame:
    return rollup.resource_hours_of_charges(charges, keep_usage_date=True)


def rolled_stretches(charges: DataFrame) -> DataFrame:
    return rollup.resource_stretches_of_charges(charges, keep_usage_date=True)


def hourly(charges: DataFrame) -> DataFrame:
    return rollup.hours_of_stretches(hourly_stretches(charges))


def hourly_stretches(charges: DataFrame, keep_layout: bool = False) -> DataFrame:
    return rollup.hourly_aggregate(rolled_stretches(charges), ordered=False, keep_layout=keep_layout)


def low_hours(charges: DataFrame) -> DataFrame:
    return overprovisioned.low_usage_hours(hourly_stretches(charges))


@query("t1_diagonal_concat", using("charges") + """
SELECT ProviderName, ResourceId, ServiceName, BilledCost, SimulatedCPUUsage FROM charges WHERE ProviderName = 'GCP'
UNION ALL
SELECT ProviderName, ResourceId, ServiceName, BilledCost, NULL FROM charges WHERE ProviderName = 'AWS'""")
def _(charges):
    gcp = charges.filter(F.col("ProviderName") == "GCP").select(
        "ProviderName", "ResourceId", "ServiceName", "BilledCost", "SimulatedCPUUsage")
    aws = charges.filter(F.col("ProviderName") == "AWS").select(
        "ServiceName", "ResourceId", "ProviderName", "BilledCost")
    return timegrid.merge_tables(gcp, aws)


@query("t2_parse_and_drop", using("charges") + """
SELECT ResourceId, ChargePeriodStart, ChargePeriodEnd, BilledCost FROM charges
WHERE ServiceName <> 'Cloud SQL' AND ServiceName <> 'Amazon RDS'""")
def _(charges):
    """Text periods and costs; those of one service each are no time and no number."""
    no_time, no_cost = F.col("ServiceName") == "Cloud SQL", F.col("ServiceName") == "Amazon RDS"
    text = charges.select(
        "ResourceId",
        F.when(no_time, "soon").otherwise(F.date_format("ChargePeriodStart", "yyyy-MM-dd HH:mm:ss"))
        .alias("ChargePeriodStart"),
        F.date_format("ChargePeriodEnd", "yyyy-MM-dd HH:mm:ss").alias("ChargePeriodEnd"),
        F.when(no_cost, "n/a").otherwise(F.col("BilledCost").cast("string")).alias("BilledCost"))
    return timegrid.parse_charges(text)


@query("t3_duration_hours", using("timed") + """
SELECT ResourceId, ChargePeriodStart, ChargePeriodEnd, OriginalDurationHours FROM timed""")
def _(charges):
    return timegrid.with_hourly_cost(charges).select(
        "ResourceId", "ChargePeriodStart", "ChargePeriodEnd", "OriginalDurationHours")


@query("t4_cost_spread", using("timed") + """
SELECT ResourceId, ChargePeriodStart, BilledCost / OriginalDurationHours AS HourlyCost, BilledCost AS WholeCost
FROM timed""")
def _(charges):
    spread = timegrid.with_hourly_cost(charges)
    kept = timegrid.with_hourly_cost(spread.withColumnRenamed("HourlyCost", "Spread"), distribute_cost=False)
    return kept.select("ResourceId", "ChargePeriodStart", F.col("Spread").alias("HourlyCost"),
                       F.col("HourlyCost").alias("WholeCost"))


@query("t5_hour_expansion", using("expanded") + """
SELECT ResourceId, ServiceName, ChargePeriodStart, OriginalDurationHours, HourlyTimestamp, HourlyCost FROM expanded""")
def _(charges):
    return timegrid.expand_hours(charges).select(
        "ResourceId", "ServiceName", "ChargePeriodStart", "OriginalDurationHours", "HourlyTimestamp", "HourlyCost")


@query("t5_hour_expansion_spread_all", using("expanded") + """
SELECT ResourceId, HourlyTimestamp, EffectiveCost / OriginalDurationHours AS EffectiveCost,
       ConsumedQuantity / OriginalDurationHours AS ConsumedQuantity FROM expanded""")
def _(charges):
    return timegrid.expand_hours(charges, spread_all=True).select(
        "ResourceId", "HourlyTimestamp", "EffectiveCost", "ConsumedQuantity")


# Cents split over 8, 16 or 32 hours lie exactly between two rounded values, where the
# order of a sum decides; a small shift moves them off.
TIE_SHIFT = 1.3717421e-6


@query("t6_hourly_summary", using("expanded") + f"""
SELECT HourlyTimestamp, count(*) AS RecordCount, round(sum(HourlyCost) + {TIE_SHIFT}, 4) AS TotalCost,
       round(avg(HourlyCost) + {TIE_SHIFT}, 4) AS AvgCost FROM expanded GROUP BY 1""")
def _(charges):
    summary = timegrid.hourly_summary(charges)
    shifted = summary.withColumns({c: F.col(c) + TIE_SHIFT for c in ("TotalCost", "AvgCost")})
    return rounded(shifted, TotalCost=4, AvgCost=4)


_ROLLUP_SQL = using("rollup") + f"""
SELECT * REPLACE ({rounds(_ROLLUP_DIGITS)}) FROM rollup"""


@query("a1_resource_hour_rollup", _ROLLUP_SQL)
def _(charges):
    # Equal hours are rounded once.
    return rollup.hours_of_stretches(rounded(rollup.resource_stretches_of_charges(charges), **_ROLLUP_DIGITS))


@query("a1_resource_hour_rollup_of_expanded", _ROLLUP_SQL)
def _(charges):
    return rounded(rollup.resource_hours(timegrid.expand_hours(charges)), **_ROLLUP_DIGITS)


@query("a2_rollup_by_provider", using("rollup") + """
SELECT ProviderName, count(DISTINCT ResourceId) AS Resources, round(sum(TotalHourlyCost), 2) AS TotalCost
FROM rollup GROUP BY 1""")
def _(charges):
    return rounded(rollup.rollup_by_provider(rolled_stretches(charges)), TotalCost=2)


@query("a2_rollup_summary", using("rollup") + """
SELECT count(*) AS GroupedRows, CAST(sum(RecordCount) AS BIGINT) AS InputRows,
       count(DISTINCT ResourceId) AS UniqueResources, count(DISTINCT BillingAccountId) AS UniqueAccounts,
       min(HourlyTimestamp) AS FirstHour, max(HourlyTimestamp) AS LastHour,
       round(sum(TotalHourlyCost), 2) AS TotalCost, round(sum(RecordCount) / count(*), 8) AS CompressionRatio
FROM rollup""")
def _(charges):
    return rounded(rollup.rollup_summary(rolled_stretches(charges)), TotalCost=2, CompressionRatio=8)


@query("a3_hourly_aggregate", using("hourly") + """
SELECT * REPLACE (round(HourlyCost, 8) AS HourlyCost, round(AvgCPUUsage, 8) AS AvgCPUUsage,
  round(AvgMemoryUsage, 8) AS AvgMemoryUsage, round(TotalConsumedQuantity, 6) AS TotalConsumedQuantity)
FROM hourly""")
def _(charges):
    return rollup.hours_of_stretches(rounded(hourly_stretches(charges), HourlyCost=8, AvgCPUUsage=8,
                                             AvgMemoryUsage=8, TotalConsumedQuantity=6))


@query("a3_hourly_totals", using("hourly") + """
SELECT count(*) AS TotalRecords, count(DISTINCT HourlyTimestamp) AS UniqueHours,
       count(DISTINCT ResourceId) AS UniqueResources, round(sum(HourlyCost), 2) AS TotalCost,
       round(avg(AvgCPUUsage), 6) AS MeanCPUUsage, round(avg(AvgMemoryUsage), 6) AS MeanMemoryUsage FROM hourly""")
def _(charges):
    return rounded(rollup.hourly_summary_totals(hourly_stretches(charges)), TotalCost=2, MeanCPUUsage=6, MeanMemoryUsage=6)


@query("a4_provider_comparison", using("hourly") + """
SELECT ProviderName, round(sum(HourlyCost), 2) AS TotalCost, round(avg(HourlyCost), 4) AS AvgCost,
       count(DISTINCT ResourceId) AS UniqueResources, count(DISTINCT HourlyTimestamp) AS UniqueHours,
       count(*) AS TotalRecords FROM hourly GROUP BY 1""")
def _(charges):
    return rounded(rollup.provider_comparison(hourly_stretches(charges)), TotalCost=2, AvgCost=4)


@query("a5_provider_cost_share", using("hourly") + """
SELECT ProviderName, round(sum(HourlyCost), 2) AS TotalCost,
       round(sum(HourlyCost) / sum(sum(HourlyCost)) OVER () * 100, 6) AS CostPercent FROM hourly GROUP BY 1""")
def _(charges):
    return rounded(shares.cost_share(hourly(charges), "ProviderName", "HourlyCost"), TotalCost=2, CostPercent=6)


@query("a6_top_services_by_cost", using("hourly") + """
SELECT ServiceName, round(sum(HourlyCost), 2) AS TotalCost, count(*) AS Rows,
       round(sum(HourlyCost) / (SELECT sum(HourlyCost) FROM hourly) * 100, 6) AS CostPercent
FROM hourly GROUP BY 1 ORDER BY sum(HourlyCost) DESC LIMIT 5""")
def _(charges):
    return rounded(shares.top_services_by_cost(hourly(charges), "HourlyCost"), TotalCost=2, CostPercent=6)


@query("a7_top_offenders", using("low_hours") + """
SELECT ProviderName, ResourceId, ServiceName, LowUsageHours, round(TotalWastedCost, 3) AS TotalWastedCost
FROM low_hours ORDER BY low_hours.TotalWastedCost DESC LIMIT 10""")
def _(charges):
    top = overprovisioned.top_offenders(low_hours(charges), 10)
    return rounded(top.select("ProviderName", "ResourceId", "ServiceName", "LowUsageHours", "TotalWastedCost"),
                   TotalWastedCost=3)


@query("a8_value_counts", using("charges") + """
SELECT ServiceName, count(*) AS Count, round(count(*) / sum(count(*)) OVER () * 100, 8) AS Percent
FROM charges GROUP BY 1""")
def _(charges):
    return rounded(shares.value_counts(charges, "ServiceName"), Percent=8)


@query("a12_low_hours_extrapolation", using("low_hours") + """
SELECT count(*) AS Resources, round(sum(TotalWastedCost), 2) AS TotalWastedCost,
       round(sum(TotalWastedCost) * 4.33, 1) AS MonthlyCost, round(sum(TotalWastedCost) * 52, 1) AS YearlyCost,
       round(avg(AvgCPU), 6) AS MeanCPU, round(avg(AvgMemory), 6) AS MeanMemory FROM low_hours""")
def _(charges):
    return rounded(overprovisioned.low_hours_totals(low_hours(charges)), TotalWastedCost=2, MonthlyCost=1,
                   YearlyCost=1, MeanCPU=6, MeanMemory=6)
