"""Small tables for tests."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

START = datetime(2024, 1, 1)

ROLLUP_SCHEMA = (
    "ProviderName string, BillingAccountId string, ResourceId string, HourlyTimestamp timestamp_ntz, "
    "ServiceName string, ResourceType string, CommitmentDiscountStatus string, TotalHourlyCost double, "
    "RecordCount bigint, AvgCPUUsage double, AvgMemoryUsage double, TotalEffectiveCost double, "
    "TotalBilledCost double, TotalConsumedQuantity double")

CHARGE_SCHEMA = (
    "ProviderName string, BillingAccountId string, ResourceId string, ServiceName string, "
    "ChargePeriodStart timestamp_ntz, ChargePeriodEnd timestamp_ntz, BilledCost double, EffectiveCost double, "
    "ConsumedQuantity double, CommitmentDiscountStatus string, SimulatedCPUUsage double, SimulatedMemoryUsage double")


def rollup_row(hour, resource="r1", cpu=0.1, memory=0.9, cost=10.0, provider="GCP", account="a",
               service="Compute Engine", status=None, effective=None, quantity=1.0):
    return (provider, account, resource, START + timedelta(hours=hour), service, "VM", status, cost, 1, cpu,
            memory, cost if effective is None else effective, cost, quantity)


def rollup_table(spark, rows):
    return spark.createDataFrame(rows, ROLLUP_SCHEMA)


def charge_row(start_hour=0.0, hours=1.0, resource="r1", cost=10.0, provider="GCP", account="a",
               service="Compute Engine", effective=None, quantity=1.0, status=None, cpu=0.5, memory=0.5):
    begin = START + timedelta(hours=start_hour)
    return (provider, account, resource, service, begin, begin + timedelta(hours=hours), cost,
            cost if effective is None else effective, quantity, status, cpu, memory)


def charge_table(spark, rows):
    return spark.createDataFrame(rows, CHARGE_SCHEMA)


def same_rows(left, right, digits=9):
    """Both tables hold the same rows, doubles compared after rounding."""
    def plain(df):
        rounded = df.select(*[
            F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in sorted(df.dtypes)])
        return sorted(map(repr, rounded.collect()))

    return plain(left) == plain(right)
