"""Reading and writing (S operators).

Tables are written below the session's shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.learning import _FLAT, patterns_of, rounds
from catalog.registry import query, rounded
from catalog.sql import using
from idlespan import fixed_values as fixed
from idlespan.functions import numbers
from idlespan.operators import learning, rollup, timegrid, unused
from idlespan.plans import detection as plans
from idlespan.session import shared_folder
from idlespan.sources import sinks, stores, tables

_SOME = ("ResourceId", "ProviderName", "ServiceName", "ChargePeriodStart", "ChargePeriodEnd", "BilledCost",
         "SimulatedCPUUsage", "CommitmentDiscountStatus")
_SOME_SQL = using("charges") + f"SELECT {', '.join(_SOME)} FROM charges"


def _folder(charges) -> str:
    return shared_folder(charges.sparkSession)


@query("s1_typed_csv", _SOME_SQL)
def _(charges):
    path = sinks.write_csv(charges, _folder(charges))
    return tables.read_charges(charges.sparkSession, path).select(*_SOME)


@query("s2_text_csv", using("charges") + "SELECT ResourceId, BilledCost, SimulatedCPUUsage FROM charges")
def _(charges):
    path = sinks.write_csv(charges, _folder(charges))
    text = tables.read_text_csv(charges.sparkSession, path)
    return text.select("ResourceId", *[numbers.number(F.col(c)).alias(c) for c in ("BilledCost", "SimulatedCPUUsage")])


def _two_headers(charges):
    folder = _folder(charges)
    gcp = charges.filter(F.col("ProviderName") == "GCP")
    aws = charges.filter(F.col("ProviderName") == "AWS").drop("SimulatedCPUUsage", "SimulatedMemoryUsage")
    sinks.write_csv(gcp, folder)
    sinks.write_csv(aws, folder, mode="append")
    return tables.read_folder(charges.sparkSession, folder)


@query("s3_folder_of_csv", using("charges") + """
SELECT ProviderName, count(*) AS n, count(SimulatedCPUUsage) AS with_usage FROM charges GROUP BY 1""")
def _(charges):
    return _two_headers(charges).groupBy("ProviderName").agg(
        F.count(F.lit(1)).alias("n"), F.count("SimulatedCPUUsage").alias("with_usage"))


@query("s3_folder_patterns", using("unused_charges", "charges") + """
SELECT CloudProvider, PatternType, count(*) AS n, round(sum(savings), 2) AS savings, round(sum(waste), 2) AS waste
FROM (SELECT ProviderName AS CloudProvider, 'OverProvisioning' AS PatternType, BilledCost * 0.6 AS savings, NULL AS waste
      FROM charges WHERE SimulatedCPUUsage < 0.3
      UNION ALL SELECT ProviderName, 'Unused', NULL, WastedCost FROM unused_charges) GROUP BY ALL""")
def _(charges):
    """One file per provider: each is examined by itself and its provider detected."""
    folder = _folder(charges)
    for provider in ("GCP", "AWS"):
        one = charges.filter(F.col("ProviderName") == provider)
        sinks.write_csv(one.repartition(1), folder, mode="append")
    found = plans.folder_patterns(tables.read_folder(charges.sparkSession, folder))
    return rounded(found.groupBy("CloudProvider", "PatternType").agg(
        F.count(F.lit(1)).alias("n"), F.sum("PotentialSavings").alias("savings"),
        F.sum("WastedCost").alias("waste")), savings=2, waste=2)


@query("s4_time_columns", using("charges") + """
SELECT ResourceId, CASE WHEN ServiceName = 'Cloud SQL' THEN NULL ELSE ChargePeriodStart END AS ChargePeriodStart,
       ChargePeriodEnd FROM charges""")
def _(charges):
    text = charges.select(
        "ResourceId",
        F.when(F.col("ServiceName") == "Cloud SQL", "unknown").otherwise(F.col("ChargePeriodStart").cast("string"))
        .alias("ChargePeriodStart"),
        F.col("ChargePeriodEnd").cast("string").alias("ChargePeriodEnd"))
    return tables.parse_time_columns(text)


@query("s6_pattern_store", using("patterns") + f"SELECT service_name, sample_count, {rounds(_FLAT, 8)} FROM patterns")
def _(charges):
    path = stores.write_patterns(patterns_of(charges), _folder(charges))
    return rounded(learning.flat_patterns(stores.read_patterns(charges.sparkSession, path)), **{c: 8 for c in _FLAT})


@query("s7_default_mapping", using("charges", extra={"default_mapping": "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{a}', '{g}')" for i, (a, g) in enumerate(fixed.DEFAULT_SERVICE_MAPPING)) + ") AS m(ord, aws_key, gcp)"}) + """
SELECT s.ServiceName, arg_min(gcp, CASE WHEN aws_key = s.ServiceName THEN -1 ELSE ord END) AS target
FROM (SELECT DISTINCT ServiceName FROM charges) s LEFT JOIN default_mapping
  ON aws_key = s.ServiceName OR contains(lower(s.ServiceName), lower(aws_key)) OR contains(lower(aws_key), lower(s.ServiceName))
GROUP BY 1""")
def _(charges):
    """No mapping has been written, so the default one is written and used."""
    mapping = stores.read_mapping(charges.sparkSession, _folder(charges))
    return charges.select("ServiceName").distinct().withColumn(
        "target", learning.match_service(F.col("ServiceName"), mapping))


@query("s8_csv_sink", using("timed") + """
SELECT ResourceId, ChargePeriodStart, CAST(OriginalDurationHours AS VARCHAR) AS OriginalDurationHours FROM timed""")
def _(charges):
    path = sinks.write_csv(timegrid.with_hourly_cost(charges), _folder(charges))
    text = tables.parse_time_columns(tables.read_text_csv(charges.sparkSession, path))
    return text.select("ResourceId", "ChargePeriodStart", "OriginalDurationHours")


@query("s9_gzip_sink", using("commitments") + "SELECT ResourceId, UnusedReason, WastedCost FROM commitments")
def _(charges):
    path = sinks.write_csv(unused.unused_commitments(charges), _folder(charges), gzip=True)
    text = tables.read_text_csv(charges.sparkSession, path)
    return text.select("ResourceId", "UnusedReason", numbers.number(F.col("WastedCost")).alias("WastedCost"))


@query("s10_per_cloud_sink", using("commitments") + """
SELECT ProviderName AS CloudProvider, count(*) AS n, round(sum(WastedCost), 2) AS waste FROM commitments
WHERE ProviderName = 'AWS' GROUP BY 1""")
def _(charges):
    found = unused.tag_detections(unused.unused_commitments(charges), "Unused")
    path = sinks.write_per_cloud(found, _folder(charges))
    one = charges.sparkSession.read.option("header", True).csv(path).filter(F.col("CloudProvider") == "AWS")
    return rounded(one.groupBy("CloudProvider").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("WastedCost").cast("double")).alias("waste")), waste=2)


@query("s11_stats_sink", using("rollup") + """
SELECT ProviderName, count(DISTINCT ResourceId) AS Resources, round(sum(TotalHourlyCost), 2) AS TotalCost
FROM rollup GROUP BY 1""")
def _(charges):
    stats = rollup.rollup_by_provider(rollup.resource_stretches_of_charges(charges))
    path = sinks.write_stats(stats, _folder(charges))
    return rounded(charges.sparkSession.read.schema(stats.schema).json(path), TotalCost=2)


_PROFILED = {"ProviderName": "string", "BilledCost": "double", "CommitmentDiscountStatus": "string",
             "SimulatedCPUUsage": "double", "ChargePeriodStart": "timestamp_ntz"}


@query("s14_schema_profile", using("charges") + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, count(*) - count({c}) AS null_count, "
    f"round((count(*) - count({c})) / count(*) * 100, 8) AS null_pct FROM charges" for c, kind in _PROFILED.items()))
def _(charges):
    return rounded(tables.schema_profile(charges.select(*_PROFILED)), null_pct=8)


@query("s15_dataset_summary", using("charges") + """
SELECT count(*) AS total_records, 19 AS total_columns, round(sum(BilledCost), 2) AS total_cost,
       round(avg(BilledCost), 4) AS avg_cost FROM charges""")
def _(charges):
    return rounded(tables.dataset_summary(charges), total_cost=2, avg_cost=4)
