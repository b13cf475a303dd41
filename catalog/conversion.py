"""Conversion, provider rules and name rules (P operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.charges import raw_gcp_billing
from catalog.registry import query, rounded
from catalog.sql import IS_AWS, IS_COMPUTE, IS_GCP, label, using
from idlespan import fixed_values as fixed
from idlespan import schema
from idlespan.functions import text
from idlespan.operators import conversion, rollup, shares, timegrid


@query("p1_gcp_to_charges", using("raw") + f"""
SELECT ChargePeriodStart, ChargePeriodEnd, rounded AS BilledCost, rounded AS EffectiveCost,
       'Google Cloud' AS InvoiceIssuerName, 'GCP' AS ProviderName, 'Google' AS PublisherName,
       "Service Name" AS ServiceName, "Resource ID" AS ResourceId,
       {label('"Service Name"', fixed.RAW_RESOURCE_TYPES, "Other")} AS ResourceType,
       "Usage Quantity" AS ConsumedQuantity, "Usage Unit" AS ConsumedUnit, "Region / Zone" AS Region,
       "Service Name" || ' - ' || "Usage Quantity" || ' ' || "Usage Unit" AS ChargeDescription,
       'Used' AS CommitmentDiscountStatus, CAST(NULL AS VARCHAR) AS CommitmentDiscountType,
       cpu_percent / 100.0 AS SimulatedCPUUsage, memory_percent / 100.0 AS SimulatedMemoryUsage,
       inbound AS NetworkInboundBytes, outbound AS NetworkOutboundBytes,
       unrounded AS UnroundedCost, CAST(0.5 AS DOUBLE) AS CostPerQuantity FROM raw""")
def _(charges):
    return conversion.gcp_to_charges(raw_gcp_billing(charges))


@query("p2_percent_to_fraction", using("raw") + """
SELECT "Resource ID" AS ResourceId, cpu_percent / 100.0 AS cpu, memory_percent / 100.0 AS memory FROM raw""")
def _(charges):
    raw = raw_gcp_billing(charges)
    return raw.select(F.col("Resource ID").alias("ResourceId"),
                      conversion.percent_to_fraction(F.col("CPU Utilization (%)")).alias("cpu"),
                      conversion.percent_to_fraction(F.col("Memory Utilization (%)")).alias("memory"))


@query("p3_resource_type_of_raw_service", using("charges") + f"""
SELECT ServiceName, Region, {label("ServiceName || ' ' || Region", fixed.RAW_RESOURCE_TYPES, "Other")} AS kind,
       count(*) AS n FROM charges GROUP BY ALL""")
def _(charges):
    kind = text.raw_resource_type(F.concat_ws(" ", "ServiceName", "Region"))
    return charges.groupBy("ServiceName", "Region", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("p4_charge_description", using("raw") + """
SELECT "Resource ID" AS ResourceId,
       "Service Name" || ' - ' || "Usage Quantity" || ' ' || "Usage Unit" AS ChargeDescription FROM raw""")
def _(charges):
    return conversion.gcp_to_charges(raw_gcp_billing(charges)).select("ResourceId", "ChargeDescription")


@query("p5_conversion_summary", using("raw") + """
SELECT count(*) AS total_records, round(sum(rounded), 2) AS total_cost, round(avg(rounded), 4) AS avg_cost,
       min(ChargePeriodStart) AS start_date, max(ChargePeriodEnd) AS end_date,
       count(DISTINCT "Service Name") AS unique_services, count(DISTINCT "Resource ID") AS unique_resources,
       count(DISTINCT "Region / Zone") AS unique_regions,
       date_sub('day', min(ChargePeriodStart), max(ChargePeriodEnd)) AS date_range_days FROM raw""")
def _(charges):
    converted = conversion.gcp_to_charges(raw_gcp_billing(charges))
    return rounded(conversion.conversion_summary(converted), total_cost=2, avg_cost=4)


@query("p5_resource_type_counts", using("raw") + f"""
SELECT {label('"Service Name"', fixed.RAW_RESOURCE_TYPES, "Other")} AS ResourceType, count(*) AS Count,
       round(count(*) / sum(count(*)) OVER () * 100, 8) AS Percent FROM raw GROUP BY 1""")
def _(charges):
    converted = conversion.gcp_to_charges(raw_gcp_billing(charges))
    return rounded(shares.value_counts(converted, "ResourceType"), Percent=8)


@query("p6_aws_extract", using("charges") + """
SELECT ResourceId, ServiceName, ChargePeriodStart, BilledCost FROM charges WHERE ProviderName = 'AWS'""")
def _(charges):
    return conversion.charges_of_provider(charges).select(
        "ResourceId", "ServiceName", "ChargePeriodStart", "BilledCost")


@query("p7_cloud_filter", using("charges") + """
SELECT ResourceId, PublisherName, BilledCost FROM charges
WHERE regexp_matches(PublisherName, '(?i)AWS|Amazon Web Services|amazon')""")
def _(charges):
    by_publisher = charges.withColumn("ProviderName", F.col("PublisherName"))
    return conversion.filter_cloud(by_publisher, "AWS").select("ResourceId", "PublisherName", "BilledCost")


@query("p8_provider_split", using("charges") + f"""
SELECT Cloud, ProviderName, count(*) AS n FROM (
  SELECT 'GCP' AS Cloud, * FROM charges WHERE {IS_GCP} UNION ALL
  SELECT 'AWS' AS Cloud, * FROM charges WHERE {IS_AWS}) GROUP BY ALL""")
def _(charges):
    return conversion.with_cloud(charges).groupBy("Cloud", "ProviderName").agg(F.count(F.lit(1)).alias("n"))


_FILES = ("CASE WHEN l.Region IN ('ASIA', 'AFRICA') THEN '/in/' || lower(l.ProviderName) || '_billing.csv' "
          "WHEN l.Region = 'EUROPE' THEN '/in/' || l.ServiceName || '.csv' ELSE '/in/all.csv' END")


@query("p9_provider_of_file", using("charges") + f"""
SELECT SourceFile, CASE WHEN contains(lower(SourceFile), 'aws') THEN 'AWS'
         WHEN contains(lower(SourceFile), 'gcp') OR contains(lower(SourceFile), 'google') THEN 'GCP'
         WHEN count(DISTINCT ProviderName) = 1 AND min(ProviderName) = 'AWS' THEN 'AWS'
         WHEN count(DISTINCT ProviderName) = 1 AND min(ProviderName) = 'GCP' THEN 'GCP'
         ELSE 'Unknown' END AS CloudProvider
FROM (SELECT *, {_FILES} AS SourceFile FROM charges l) GROUP BY SourceFile""")
def _(charges):
    region = F.col("Region")
    file = (F.when(region.isin("ASIA", "AFRICA"),
                   F.concat(F.lit("/in/"), F.lower("ProviderName"), F.lit("_billing.csv")))
            .when(region == "EUROPE", F.concat(F.lit("/in/"), "ServiceName", F.lit(".csv")))
            .otherwise("/in/all.csv"))
    return conversion.provider_of_file(charges.withColumn("SourceFile", file), "SourceFile")


@query("p10_compute_services", using("charges") + f"""
SELECT ServiceName, {IS_COMPUTE} AS is_compute, count(*) AS n FROM charges GROUP BY ALL""")
def _(charges):
    return charges.groupBy("ServiceName", text.is_compute_service(F.col("ServiceName")).alias("is_compute")).agg(
        F.count(F.lit(1)).alias("n"))


# Several columns together give the rules more words to look at.
_NAMES = "ServiceName || ' ' || ConsumedUnit || ' ' || ResourceType || ' ' || ChargeDescription"


def _named(charges):
    return charges.withColumn("name", F.concat_ws(
        " ", "ServiceName", "ConsumedUnit", "ResourceType", "ChargeDescription"))


def _name_rule(name: str, sql_rule: str, column_rule):
    sql = using("charges") + f"""
SELECT name, {sql_rule} AS label, count(*) AS n FROM (SELECT {_NAMES} AS name FROM charges) GROUP BY ALL"""

    @query(name, sql)
    def _(charges):
        return _named(charges).groupBy("name", column_rule(F.col("name")).alias("label")).agg(
            F.count(F.lit(1)).alias("n"))


_name_rule("p11_service_category", label("name", fixed.SERVICE_CATEGORIES, "Other"), text.service_category)
_name_rule("p12_service_category_with_fallback",
           label("name", fixed.SERVICE_CATEGORIES + fixed.GENERIC_CATEGORIES, "Other"),
           text.service_category_with_fallback)
_name_rule("p13_classifier_resource_type", label("name", fixed.CLASSIFIER_RESOURCE_TYPES, "Other"),
           text.classifier_resource_type)
_name_rule("p14_boosting_resource_type", label("name", fixed.BOOSTING_RESOURCE_TYPES, "Other"),
           text.boosting_resource_type)


@query("p15_column_discovery", using("charges") + """
SELECT ResourceId, SimulatedCPUUsage AS cpu, SimulatedMemoryUsage AS memory, ChargePeriodStart AS at FROM charges""")
def _(charges):
    cpu, memory = schema.find_usage_columns(charges.columns)
    time = schema.first_existing(charges.columns, fixed.TIME_COLUMNS)
    return charges.select("ResourceId", F.col(cpu).alias("cpu"), F.col(memory).alias("memory"),
                          F.col(time).alias("at"))


@query("p16_cost_by_issuer", using("charges") + """
SELECT ProviderName, PublisherName, InvoiceIssuerName, round(sum(BilledCost), 2) AS TotalBilledCost FROM charges
WHERE ChargePeriodStart >= TIMESTAMP '1996-09-01' AND ChargePeriodEnd < TIMESTAMP '1997-12-31' GROUP BY ALL""")
def _(charges):
    return rounded(conversion.cost_by_issuer(charges, "1996-09-01", "1997-12-31"), TotalBilledCost=2)


@query("s5_required_columns", using("charges") + "SELECT count(*) AS n FROM charges")
def _(charges):
    return schema.require_columns(charges, schema.CHARGE_PERIOD_COLUMNS).agg(F.count(F.lit(1)).alias("n"))


@query("s12_output_columns", using("rollup") + """
SELECT ResourceId, ProviderName, ServiceName, ResourceType, CommitmentDiscountStatus,
       round(TotalHourlyCost, 8) AS TotalHourlyCost FROM rollup""")
def _(charges):
    table = rollup.resource_hours_of_charges(timegrid.merge_tables(charges))
    return rounded(schema.keep_existing(table, schema.UNUSED_COLUMNS), TotalHourlyCost=8)
