"""Raw provider billing to charges, and choosing charges by provider."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlespan import fixed_values as fixed
from idlespan.functions import numbers, text, times

_DATES = ("Usage Start Date", "Usage End Date")


def gcp_to_charges(raw: DataFrame) -> DataFrame:
    """Lay a raw GCP billing table out as charges."""
    kinds = dict(raw.dtypes)
    start, end = (times.parse_timestamp(F.col(c), kinds[c]) for c in _DATES)
    service, quantity = F.col("Service Name"), F.col("Usage Quantity")
    cost = F.col("Rounded Cost ($)")
    description = F.concat(service, F.lit(" - "), text.plain_number_text(quantity),
                           F.lit(" "), F.col("Usage Unit"))
    return raw.select(
        start.alias("ChargePeriodStart"),
        end.alias("ChargePeriodEnd"),
        cost.alias("BilledCost"),
        cost.alias("EffectiveCost"),
        F.lit("Google Cloud").alias("InvoiceIssuerName"),
        F.lit("GCP").alias("ProviderName"),
        F.lit("Google").alias("PublisherName"),
        service.alias("ServiceName"),
        F.col("Resource ID").alias("ResourceId"),
        text.raw_resource_type(service).alias("ResourceType"),
        quantity.alias("ConsumedQuantity"),
        F.col("Usage Unit").alias("ConsumedUnit"),
        F.col("Region / Zone").alias("Region"),
        description.alias("ChargeDescription"),
        F.lit("Used").alias("CommitmentDiscountStatus"),
        F.lit(None).cast("string").alias("CommitmentDiscountType"),
        percent_to_fraction(F.col("CPU Utilization (%)")).alias("SimulatedCPUUsage"),
        percent_to_fraction(F.col("Memory Utilization (%)")).alias("SimulatedMemoryUsage"),
        F.col("Network Inbound Data (Bytes)").alias("NetworkInboundBytes"),
        F.col("Network Outbound Data (Bytes)").alias("NetworkOutboundBytes"),
        F.col("Unrounded Cost ($)").alias("UnroundedCost"),
        F.col("Cost per Quantity ($)").alias("CostPerQuantity"),
    )


def percent_to_fraction(percent: Column) -> Column:
    return percent / F.lit(100.0)


def conversion_summary(charges: DataFrame) -> DataFrame:
    """One row: rows, cost, period, whole days covered and distinct counts."""
    names = ["ResourceId", "ServiceName", "Region"]
    # Rows of equal names are added up first, then resources, so that each is one row; what is left is one row per
    # service and region.
    sums = charges.groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"), F.sum("BilledCost").alias("cost"), F.count("BilledCost").alias("costs"),
        F.min("ChargePeriodStart").alias("a"), F.max("ChargePeriodEnd").alias("b"))
    listed = sums.groupBy("ResourceId").agg(F.collect_list(F.struct("ServiceName", "Region", "n", "cost", "costs", "a", "b")).alias("rows"))
    marked = listed.select("ResourceId", F.posexplode("rows").alias("nth", "row")).select(
        "row.*", ((F.col("nth") == 0) & F.col("ResourceId").isNotNull()).cast("bigint").alias("resource"))
    few = marked.groupBy("ServiceName", "Region").agg(
        *[F.sum(c).alias(c) for c in ("n", "cost", "costs", "resource")], F.min("a").alias("a"), F.max("b").alias("b"))
    return few.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        numbers.sum_or_zero(F.col("cost")).alias("total_cost"),
        F.try_divide(F.sum("cost"), F.sum("costs")).alias("avg_cost"),
        F.min("a").alias("start_date"),
        F.max("b").alias("end_date"),
        F.count_distinct("ServiceName").alias("unique_services"),
        F.coalesce(F.sum("resource"), F.lit(0)).alias("unique_resources"),
        F.count_distinct("Region").alias("unique_regions"),
    ).withColumn("date_range_days", times.whole_days(F.col("start_date"), F.col("end_date")))


def charges_of_provider(charges: DataFrame, provider: str = "AWS") -> DataFrame:
    """Rows whose provider has exactly this name."""
    return charges.filter(F.col("ProviderName") == provider)


def filter_cloud(charges: DataFrame, cloud: str,
                 patterns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose provider matches any of the patterns, ignoring case."""
    words = patterns if patterns is not None else fixed.CLOUD_FILTER_PATTERNS[cloud]
    return charges.filter(F.col("ProviderName").rlike("(?i)" + "|".join(words)))


def with_cloud(df: DataFrame) -> DataFrame:
    """Add ``Cloud``; rows of other providers are dropped.

    A name that matches both clouds yields a row for each.  Without a provider
    column everything counts as GCP.
    """
    if "ProviderName" not in df.columns:
        return df.withColumn("Cloud", F.lit("GCP"))
    provider = F.col("ProviderName")
    clouds = F.array_compact(F.array(*[
        F.when(text.matches_cloud(provider, cloud), F.lit(cloud)) for cloud in fixed.CLOUD_WORDS]))
    return df.withColumn("Cloud", F.explode(clouds))


def of_cloud(df: DataFrame, cloud: str) -> DataFrame:
    """One cloud's rows, by the same rule as ``with_cloud``."""
    if "ProviderName" not in df.columns:
        return df if cloud == "GCP" else df.filter(F.lit(False))
    return df.filter(text.matches_cloud(F.col("ProviderName"), cloud))


def provider_of_file(df: DataFrame, file_column: str) -> DataFrame:
    """``CloudProvider`` of every file: by its name, else by its only provider.

    A file that holds several providers, or a missing one, is 'Unknown'.
    """
    name = F.lower(F.element_at(F.split(F.col(file_column), "/"), -1))
    provider = F.col("_only")
    by_name = F.when(name.contains("aws"), "AWS").when(
        name.contains("gcp") | name.contains("google"), "GCP")
    by_content = F.when(provider.contains("AWS") | provider.contains("Amazon"), "AWS").when(
        provider.contains("Google") | provider.contains("GCP"), "GCP")
    per_file = df.groupBy(file_column).agg(
        F.when((F.min("ProviderName") == F.max("ProviderName"))
               & (F.count("ProviderName") == F.count(F.lit(1))), F.min("ProviderName")).alias("_only"))
    return per_file.select(
        file_column, F.coalesce(by_name, by_content, F.lit("Unknown")).alias("CloudProvider"))


def cost_by_issuer(charges: DataFrame, start: str, end: str) -> DataFrame:
    """Billed cost of charges within a period by provider, publisher and issuer, largest first."""
    inside = (F.col("ChargePeriodStart") >= F.lit(start).cast("timestamp_ntz")) & (
        F.col("ChargePeriodEnd") < F.lit(end).cast("timestamp_ntz"))
    names = ["ProviderName", "PublisherName", "InvoiceIssuerName"]
    return (
        charges.filter(inside).dropna(subset=names).groupBy(*names)
        .agg(numbers.sum_or_zero(F.col("BilledCost")).alias("TotalBilledCost"))
        .orderBy(F.desc("TotalBilledCost"))
    )
