"""Names, conversion, reading and writing."""

import gzip
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from idlespan import fixed_values as fixed
from idlespan import schema
from idlespan.functions import text
from idlespan.operators import conversion, learning
from idlespan.sources import sinks, stores, tables
from tests.helpers import charge_row, charge_table


def _apply(spark, rule, value):
    return spark.createDataFrame([(value,)], "n string").select(rule(F.col("n"))).first()[0]


@pytest.mark.parametrize("rule, value, expected", [
    (text.raw_resource_type, "Cloud Run", "Compute"),
    (text.raw_resource_type, "Trunk SQL", "Compute"),       # 'run' comes first
    (text.raw_resource_type, "Cloud Domains", "AI/ML"),     # 'ai' inside a word
    (text.raw_resource_type, "Artifact Hub", "Container Registry"),
    (text.raw_resource_type, None, "Other"),
    (text.service_category, "Amazon EKS on EC2", "Compute"),
    (text.service_category, "Compute pool", "Other"),
    (text.service_category_with_fallback, "Compute pool", "Compute"),
    (text.service_category_with_fallback, "My DB", "Database"),
    (text.classifier_resource_type, "AWS Lambda", "Function"),
    (text.classifier_resource_type, None, "Unknown"),
    (text.boosting_resource_type, "Kubernetes Engine", "VM"),
    (text.boosting_resource_type, "EBS Volume", "BlockStorage"),
    (text.boosting_resource_type, None, "Other"),
    (text.is_compute_service, "AMAZON ECS", True),
    (text.is_compute_service, None, False),
])
def test_name_rules(spark, rule, value, expected):
    assert _apply(spark, rule, value) == expected


@pytest.mark.parametrize("value, expected", [
    (12.0, "12.0"), (0.5, "0.5"), (12345678.9, "12345678.9"), (1e7, "10000000.0"), (0.00025, "0.00025"), (0.0, "0.0")])
def test_numbers_in_descriptions(spark, value, expected):
    table = spark.createDataFrame([(value,)], "v double")
    assert table.select(text.plain_number_text(F.col("v"))).first()[0] == expected


def test_raw_billing_with_text_dates(spark):
    raw = spark.createDataFrame(
        [("r", "Cloud SQL", 2.0, "Hours", "eu", 45.0, -1.0, 1.0, 2.0, "2024-03-01 00:00:00", "2024-03-01 05:00:00",
          0.1, 0.19, 0.2)], schema.RAW_GCP_BILLING.names)
    raw = raw.withColumn("Memory Utilization (%)", F.lit(None).cast("double"))
    row = conversion.gcp_to_charges(raw).first()
    assert (row.ServiceName, row.ResourceType, row.CommitmentDiscountStatus) == ("Cloud SQL", "Database", "Used")
    assert (row.SimulatedCPUUsage, row.SimulatedMemoryUsage) == (0.45, None)
    assert row.ChargeDescription == "Cloud SQL - 2.0 Hours"
    assert row.ChargePeriodEnd.hour == 5


def test_csv_round_trip_keeps_nulls_and_types(spark, tmp_path):
    charges = charge_table(spark, [charge_row(), charge_row(resource=None, cpu=None)])
    back = tables.read_charges(spark, sinks.write_csv(charges, str(tmp_path / "out")))
    assert back.schema == schema.CHARGES
    assert back.select(*charges.columns).orderBy("ResourceId").collect() == charges.orderBy("ResourceId").collect()


def test_folder_with_two_headers_and_byte_order_mark(spark, tmp_path):
    (tmp_path / "gcp.csv").write_text("﻿ProviderName,BilledCost\nGCP,1.5\n", encoding="utf-8")
    (tmp_path / "aws.csv").write_text("BilledCost,ServiceName\n2,S3\nbad,S3\n", encoding="utf-8")
    (tmp_path / "notes.txt").write_text("no table")
    table = tables.read_folder(spark, str(tmp_path))
    found = {(Path(r.SourceFile).name, r.ProviderName, r.BilledCost, r.ServiceName) for r in table.collect()}
    assert found == {("gcp.csv", "GCP", "1.5", None), ("aws.csv", None, "2", "S3"), ("aws.csv", None, "bad", "S3")}
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        tables.read_folder(spark, str(tmp_path / "empty"))


def test_gzip_and_per_cloud_folders(spark, tmp_path):
    table = spark.createDataFrame([("AWS", 1), ("GCP", 2)], "CloudProvider string, n int")
    path = Path(sinks.write_per_cloud(table, str(tmp_path / "clouds")))
    assert {p.name for p in path.glob("CloudProvider=*")} == {"CloudProvider=AWS", "CloudProvider=GCP"}
    packed = next(Path(sinks.write_csv(table, str(tmp_path / "packed"), gzip=True)).glob("*.csv.gz"))
    assert gzip.open(packed, "rt").readline() == "CloudProvider,n\n"


def test_time_columns(spark):
    table = spark.createDataFrame([("2024-01-01 10:00:00", "never", "2024")], "StartDate string, EndTime string, Id string")
    row = tables.parse_time_columns(table).first()
    assert row.StartDate.hour == 10 and row.EndTime is None and row.Id == "2024"


def test_profile_and_summary(spark):
    table = spark.createDataFrame([("a", 1.0), (None, 3.0)], "name string, MyCost double")
    found = {r.column: (r.dtype, r.null_count, r.null_pct) for r in tables.schema_profile(table).collect()}
    assert found == {"name": ("string", 1, 50.0), "MyCost": ("double", 0, 0.0)}
    assert tables.dataset_summary(table).first()[:] == (2, 2, 4.0, 2.0)


def test_pattern_and_mapping_stores(spark, tmp_path):
    usage = spark.createDataFrame([("s", 0.2, 0.4)], "service_name string, cpu double, memory double")
    patterns = learning.learn_patterns(usage)
    back = stores.read_patterns(spark, stores.write_patterns(patterns, str(tmp_path / "patterns")))
    assert back.collect() == patterns.collect()
    path = str(tmp_path / "mapping")
    assert stores.read_mapping(spark, path) == fixed.DEFAULT_SERVICE_MAPPING
    assert stores.read_mapping(spark, path) == fixed.DEFAULT_SERVICE_MAPPING
    other = stores.write_mapping(spark, str(tmp_path / "own"), fixed.SERVICE_MAPPING)
    assert stores.read_mapping(spark, other) == fixed.SERVICE_MAPPING
    assert len(fixed.SERVICE_MAPPING) == 30


def test_column_lookup():
    columns = ["Id", "CPU Utilization (%)", "SimulatedMemoryUsage", "Memory Type"]
    assert schema.find_usage_columns(columns) == ("CPU Utilization (%)", "SimulatedMemoryUsage")
    assert schema.find_column(columns, "memory", "type") == "Memory Type"
    assert schema.find_column(columns, "disk") is None
