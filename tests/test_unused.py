"""Unused resources, tags and reports."""

from pyspark.sql import functions as F

from idlespan.operators import conversion, reports, shares, unused
from idlespan.plans import detection as plans
from tests.helpers import charge_row, charge_table, rollup_row, rollup_table


def test_commitment_row_wins_and_missing_resources_collapse(spark):
    rows = [charge_row(resource="a", quantity=0.0), charge_row(start_hour=5, resource="a", status="UNUSED"),
            charge_row(resource="b", quantity=0.0), charge_row(resource=None, quantity=0.0),
            charge_row(start_hour=9, resource=None, quantity=0.0), charge_row(resource="c", status="Used")]
    found = {r.ResourceId: (r.UnusedReason, r.WastedCost) for r in unused.unused_charges(charge_table(spark, rows)).collect()}
    assert found == {"a": ("Commitment-Unused", 10.0), "b": ("Zero-Cost-Zero-Usage", 0.0),
                     None: ("Zero-Cost-Zero-Usage", 0.0)}


def test_first_row_is_the_earliest(spark):
    rows = [charge_row(start_hour=h, cost=float(h), status="Unused") for h in (7, 3, 5)]
    assert unused.unused_charges(charge_table(spark, rows)).first().WastedCost == 3.0


def test_strict_mode_and_required_cost(spark):
    table = charge_table(spark, [charge_row(quantity=0.0), charge_row(cost=0.0, quantity=None),
                                 charge_row(cost=0.0, status="Unused")])
    assert unused.zero_usage_charges(table).count() == 1
    assert unused.zero_usage_charges(table, mode="strict").count() == 1
    assert unused.unused_commitments(table).count() == 1
    assert unused.unused_commitments(table, require_cost=True).count() == 0


def test_unused_resources_of_rollup(spark):
    rows = [rollup_row(h, resource="idle", cost=0.0, quantity=0.0) for h in range(80)]
    rows += [rollup_row(h, resource="both", cost=0.0, quantity=0.0) for h in range(80)]
    rows += [rollup_row(90, resource="both", status="unused", cost=4.0)]
    found = {r.ResourceId: r.UnusedReason for r in unused.unused_resources(rollup_table(spark, rows)).collect()}
    assert found == {"idle": "Zero-Usage-80h", "both": "Commitment-Unused"}


def test_name_of_both_clouds_counts_in_both(spark):
    table = charge_table(spark, [charge_row(provider=p) for p in ("GCP", "AWS via Google", "Azure", None)])
    found = conversion.with_cloud(table).groupBy("Cloud").count().collect()
    assert {r.Cloud: r["count"] for r in found} == {"GCP": 2, "AWS": 1}
    assert {r.Cloud for r in conversion.with_cloud(table.drop("ProviderName")).collect()} == {"GCP"}


def test_provider_of_file(spark):
    rows = [("/d/my_AWS.csv", "GCP"), ("/d/x.csv", "Amazon"), ("/d/y.csv", "GCP"), ("/d/y.csv", None),
            ("/d/z.csv", "gcp")]
    table = spark.createDataFrame(rows, "f string, ProviderName string")
    found = {r.f: r.CloudProvider for r in conversion.provider_of_file(table, "f").collect()}
    assert found == {"/d/my_AWS.csv": "AWS", "/d/x.csv": "AWS", "/d/y.csv": "Unknown", "/d/z.csv": "Unknown"}


def test_flags_choose_rules(spark):
    table = charge_table(spark, [charge_row(cpu=0.1), charge_row(provider="AWS", quantity=0.0)])
    only_unused = plans.cloud_patterns(table).collect()
    assert [(r.CloudProvider, r.PatternType) for r in only_unused] == [("AWS", "Unused")]
    both = plans.cloud_patterns(table, over_provisioning=True).collect()
    assert sorted(r.PatternType for r in both) == ["OverProvisioning", "Unused"]


def test_maximum_falls_into_the_last_bin(spark):
    values = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    found = {r.bin: r.n for r in reports.histogram(values, "v", 10).collect()}
    assert found == {**{i: 1 for i in range(9)}, 9: 2}
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [(r.bin, r.n) for r in reports.histogram(flat, "v", 10).collect()] == [(5, 2)]


def test_top_services_and_others(spark):
    rows = [charge_row(service=s, status="Unused") for s in "aaabbcd"]
    found = reports.top_services_and_others(unused.unused_commitments(charge_table(spark, rows)), 2)
    assert {r.Service: r.Count for r in found.collect()} == {"a": 3, "b": 2, "Others": 2}


def test_shares_of_nothing_are_zero(spark):
    table = charge_table(spark, [charge_row(cost=0.0)])
    assert shares.cost_share(table, "ProviderName", "BilledCost").first().CostPercent == 0.0


def test_savings_on_roi(spark):
    low = spark.createDataFrame([(100.0,), (200.0,)], "PotentialSavings double")
    idle = spark.createDataFrame([(150.0,)], "WastedCost double")
    row = reports.return_on_investment(low, idle).first()
    assert (row.TotalSavings, row.NetSavings, row.RoiPercent, row.Reinvestable) == (450.0, 300.0, 200.0, 225.0)


def test_crosstab_margins(spark):
    table = spark.createDataFrame([("AWS", "Unused"), ("AWS", "Unused"), ("GCP", "OverProvisioning")],
                                  "CloudProvider string, PatternType string")
    found = {r.CloudProvider: (r.OverProvisioning, r.Unused, r.All) for r in reports.pattern_crosstab(table).collect()}
    assert found == {"AWS": (0, 2, 2), "GCP": (1, 0, 1), "All": (1, 2, 3)}


def test_free_words_are_literal(spark):
    table = charge_table(spark, [charge_row(cost=0.0)] * 2).withColumn("ChargeDescription", F.lit("$0.00 per Free Tier hour"))
    found = {r.keyword: r.matches for r in unused.free_charge_words(table).collect()}
    assert found["$0.00"] == found["free tier"] == found["free"] == 2 and found["credit"] == 0
