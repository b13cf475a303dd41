"""Charges derived from the test tables, in Spark and as SQL.

Each line item becomes a charge: its supplier is the resource, its quantity the
number of hours.  Every other supplier is GCP (which has usage figures) or AWS.
Some resources neither cost nor use anything during 1996; of these every other has
no unused commitments.  Cloud Run is used far less than the other GCP services.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SERVICES = ("Compute Engine", "Amazon EC2", "Cloud SQL", "AWS Lambda", "Cloud Run", "Amazon RDS")
_TYPES = ("VM", "VM", "Database", "Function", "Container", "Database")
_FREE_TEXTS = {1: "Free Tier allowance", 2: "Included with plan", 3: "Promotional credit",
               4: "$0.00 per request, no charge", 5: "Trial period"}


# Naming the columns spares the job that reads each file's schema.
_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def _pick(index: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def charges(spark: SparkSession, folder: str) -> DataFrame:
    def table(name: str) -> DataFrame:
        return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")

    joined = (
        table("lineitem")
        .join(table("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    supplier = F.col("l_suppkey")
    idle = (supplier % 10).isin(6, 7) & (F.year("l_shipdate") == 1996)
    gcp = supplier % 2 == 0
    measured = gcp & (F.col("l_linenumber") < 7)
    light = supplier % 6 == 4
    returned = F.col("l_returnflag") == "R"

    def unless_idle(amount: Column) -> Column:
        return F.when(idle, F.lit(0.0)).otherwise(amount)

    service = _pick(supplier % 6, _SERVICES)
    free_text = F.lit("Unbilled usage")
    for line, text in _FREE_TEXTS.items():
        free_text = F.when(F.col("l_linenumber") == line, text).otherwise(free_text)
    return joined.select(
        F.when(gcp, "GCP").otherwise("AWS").alias("ProviderName"),
        F.when(gcp, "Google").otherwise("Amazon Web Services").alias("PublisherName"),
        F.when(gcp, "Google Cloud").otherwise("AWS").alias("InvoiceIssuerName"),
        F.concat(F.lit("acct-"), "s_nationkey").alias("BillingAccountId"),
        F.concat(F.lit("res-"), "l_suppkey").alias("ResourceId"),
        service.alias("ServiceName"),
        _pick(supplier % 6, _TYPES).alias("ResourceType"),
        F.col("r_name").alias("Region"),
        F.col("l_shipdate").alias("ChargePeriodStart"),
        F.timestamp_add("HOUR", F.col("l_quantity").cast("int"), F.col("l_shipdate")).alias("ChargePeriodEnd"),
        unless_idle(F.col("l_extendedprice")).alias("BilledCost"),
        unless_idle(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("EffectiveCost"),
        unless_idle(F.col("l_quantity")).alias("ConsumedQuantity"),
        F.lit("Hours").alias("ConsumedUnit"),
        F.when(idle, free_text).otherwise(F.concat(service, F.lit(" usage"))).alias("ChargeDescription"),
        F.when(returned & (F.col("l_discount") >= 0.095) & (supplier % 10 != 7), "Unused")
        .when(returned, "Used").alias("CommitmentDiscountStatus"),
        F.when(returned, F.when(F.col("l_linenumber") % 2 == 0, "Reserved").otherwise("Savings Plan"))
        .alias("CommitmentDiscountType"),
        F.when(measured, F.when(light, F.col("l_tax") * 5 + 0.0137).otherwise(F.col("l_tax") * 11 + 0.01))
        .alias("SimulatedCPUUsage"),
        F.when(measured, F.when(light, F.col("l_discount") * 5 + 0.0237).otherwise(F.col("l_discount") * 9 + 0.02))
        .alias("SimulatedMemoryUsage"),
    )


def raw_gcp_billing(charge_table: DataFrame) -> DataFrame:
    """The GCP charges under the raw billing table's names."""
    return charge_table.filter(F.col("ProviderName") == "GCP").select(
        F.col("ResourceId").alias("Resource ID"),
        F.col("ServiceName").alias("Service Name"),
        F.col("ConsumedQuantity").alias("Usage Quantity"),
        F.col("ConsumedUnit").alias("Usage Unit"),
        F.col("Region").alias("Region / Zone"),
        (F.col("SimulatedCPUUsage") * 100).alias("CPU Utilization (%)"),
        (F.col("SimulatedMemoryUsage") * 100).alias("Memory Utilization (%)"),
        (F.col("ConsumedQuantity") * 1024).alias("Network Inbound Data (Bytes)"),
        (F.col("ConsumedQuantity") * 2048).alias("Network Outbound Data (Bytes)"),
        F.col("ChargePeriodStart").alias("Usage Start Date"),
        F.col("ChargePeriodEnd").alias("Usage End Date"),
        F.lit(0.5).alias("Cost per Quantity ($)"),
        F.col("EffectiveCost").alias("Unrounded Cost ($)"),
        F.col("BilledCost").alias("Rounded Cost ($)"),
    )


def _case(index: str, values) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {whens} END"


_FREE_SQL = "CASE l_linenumber " + " ".join(
    f"WHEN {n} THEN '{t}'" for n, t in _FREE_TEXTS.items()) + " ELSE 'Unbilled usage' END"

CHARGES_SQL = f"""
SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'GCP' ELSE 'AWS' END AS ProviderName,
       CASE WHEN l_suppkey % 2 = 0 THEN 'Google' ELSE 'Amazon Web Services' END AS PublisherName,
       CASE WHEN l_suppkey % 2 = 0 THEN 'Google Cloud' ELSE 'AWS' END AS InvoiceIssuerName,
       'acct-' || s_nationkey AS BillingAccountId,
       'res-' || l_suppkey AS ResourceId,
       {_case("l_suppkey % 6", _SERVICES)} AS ServiceName,
       {_case("l_suppkey % 6", _TYPES)} AS ResourceType,
       r_name AS Region,
       l_shipdate AS ChargePeriodStart,
       l_shipdate + to_hours(l_quantity::INT) AS ChargePeriodEnd,
       CASE WHEN z THEN 0.0 ELSE l_extendedprice END AS BilledCost,
       CASE WHEN z THEN 0.0 ELSE l_extendedprice * (1 - l_discount) END AS EffectiveCost,
       CASE WHEN z THEN 0.0 ELSE l_quantity END AS ConsumedQuantity,
       'Hours' AS ConsumedUnit,
       CASE WHEN z THEN {_FREE_SQL} ELSE {_case("l_suppkey % 6", _SERVICES)} || ' usage' END AS ChargeDescription,
       CASE WHEN l_returnflag = 'R' AND l_discount >= 0.095 AND l_suppkey % 10 <> 7 THEN 'Unused'
            WHEN l_returnflag = 'R' THEN 'Used' END AS CommitmentDiscountStatus,
       CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'Reserved'
            WHEN l_returnflag = 'R' THEN 'Savings Plan' END AS CommitmentDiscountType,
       CASE WHEN l_suppkey % 2 <> 0 OR l_linenumber >= 7 THEN NULL
            WHEN l_suppkey % 6 = 4 THEN l_tax * 5 + 0.0137 ELSE l_tax * 11 + 0.01 END AS SimulatedCPUUsage,
       CASE WHEN l_suppkey % 2 <> 0 OR l_linenumber >= 7 THEN NULL
            WHEN l_suppkey % 6 = 4 THEN l_discount * 5 + 0.0237 ELSE l_discount * 9 + 0.02 END AS SimulatedMemoryUsage
FROM (SELECT *, (l_suppkey % 10 IN (6, 7) AND year(l_shipdate) = 1996) AS z FROM lineitem) l
JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""
