"""What the plans must not contain, and results that must not be empty."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from idlespan.operators import learning, overprovisioned, rollup, shares, unused
from idlespan.plans import detection
from idlespan.session import shared_folder, written
from tests.helpers import charge_row, charge_table, rollup_row, rollup_table

FOLDERS = [f for f in (f"/root/testdata/sf{n}" for n in ("0.001", "0.01")) if Path(f).exists()]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("folder", FOLDERS)
def test_estimates_split_the_services(spark, folder):
    from catalog import QUERIES

    counts = {r.status: r.n for r in QUERIES["r8_detected_and_normal"](spark, folder).collect()}
    assert counts["Over-Provisioned"] > 0 and counts["Normal"] > 0
    assert QUERIES["r1_reasons"](spark, folder).count() == 2


def test_charges_are_not_shuffled_for_estimates(spark):
    usage = [charge_row(h, service="Cloud Run", cpu=0.2, memory=0.2) for h in range(9)]
    aws = charge_table(spark, [charge_row(h, provider="AWS", service="AWS Lambda", cpu=None, memory=None) for h in range(5)])
    patterns = written(learning.learn_patterns(learning.clean_usage(charge_table(spark, usage))))
    joined = learning.attach_estimates(aws, written(learning.estimate_services(aws, patterns)))
    assert "BroadcastHashJoin" in plan(joined) and "Exchange hashpartitioning" not in plan(joined)
    assert {r.method for r in joined.collect()} == {"exact_match"}


def test_streak_windows_share_one_sort(spark):
    table = rollup_table(spark, [rollup_row(h, quantity=0.0, cost=0.0, effective=0.0) for h in range(80)])
    found = unused.zero_usage_streaks(table)
    text = plan(found)
    by_block = [line for line in text.splitlines() if re.search(r"\bSort \[_block", line)]
    assert len(by_block) == 1, by_block
    assert found.first().ConsecutiveZeroHours == 80


def test_hours_without_a_resource_are_spread(spark):
    rows = [charge_row(h % 24, hours=1.0, resource=None, account=f"a{h % 40}", service=f"s{h % 7}") for h in range(400)]
    table = charge_table(spark, rows)
    spread = rollup.resource_hours_of_charges(table)
    used = spread.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 3 and spread.agg(F.sum("RecordCount")).first()[0] == 400
    together = rollup.resource_hours_of_charges(table, keep_usage_date=True).drop(*rollup.LAYOUT)
    assert spread.exceptAll(together).count() == 0 and together.exceptAll(spread).count() == 0


def test_hourly_aggregate_sorts_only_on_request(spark):
    table = rollup_table(spark, [rollup_row(h % 3, service=f"s{h}") for h in range(6)])
    assert "rangepartitioning" not in plan(rollup.hourly_aggregate(table))
    rows = rollup.hourly_aggregate(table, ordered=True).select("HourlyTimestamp", "ServiceName").collect()
    assert rows == sorted(rows)


def test_shares_have_no_unpartitioned_window(spark):
    df = spark.createDataFrame([("a", 1.0, "r"), ("b", 3.0, "s"), (None, 4.0, "t")], "k string, c double, ResourceId string")
    for made in (shares.value_counts(df, "k"), shares.cost_share(df, "k", "c"), shares.count_and_waste(df, "k", "c")):
        assert "Window" not in plan(made)
    assert {(r.k, r.Percent) for r in shares.value_counts(df.filter("k IS NOT NULL"), "k").collect()} == {("a", 50.0), ("b", 50.0)}


def test_percent_scales_in_one_pass(spark):
    rows = [("s", 40.0, 0.5), ("s", 90.0, 0.25), ("s", 101.0, 80.0), ("s", None, 0.5), ("s", 50.0, None)]
    df = spark.createDataFrame(rows, "ServiceName string, SimulatedCPUUsage double, SimulatedMemoryUsage double")
    # The row of 101 % CPU is no usage, so its memory does not make memory a percentage.
    assert sorted(map(tuple, learning.clean_usage(df).collect())) == [("s", 0.4, 0.5), ("s", 0.9, 0.25)]
    # CPU alone: memory plays no part.
    alone = learning.clean_usage(df, memory=None)
    assert sorted(map(tuple, alone.collect())) == [("s", 0.4, None), ("s", 0.5, None), ("s", 0.9, None)]
    pattern = learning.learn_patterns(alone).first()
    assert (pattern.sample_count, pattern.cpu.q50, pattern.memory.q50) == (3, 0.5, None)
    assert len(learning.clean_usage(df, cpu=None).collect()) == 4
    with pytest.raises(ValueError):
        learning.clean_usage(df, cpu=None, memory=None)
    assert len(set(re.findall(r"subquery#(\d+)", plan(learning.clean_usage(df))))) == 1


def test_clouds_by_other_words(spark):
    table = charge_table(spark, [charge_row(0, provider="Nimbus", quantity=0.0), charge_row(1, provider="AWS", quantity=0.0)])
    found = detection.cloud_patterns(table, patterns={"NIM": ("nimbus",)})
    assert [r.CloudProvider for r in found.collect()] == ["NIM"]


def test_stored_tables_lie_in_one_folder_of_the_session(spark):
    first, second = shared_folder(spark), shared_folder(spark)
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    assert spark.sparkContext.applicationId in first


@pytest.fixture
def mixed_charges(spark):
    """Idle and committed resources of both clouds, stored; a day of charges without a resource, some unused commitments."""
    rows = [charge_row(h, resource=f"idle{c}", provider=c, cost=0.0, quantity=0.0) for c in ("GCP", "AWS") for h in range(80)]
    rows += [charge_row(h, resource="both", provider="AWS", cost=0.0, quantity=0.0) for h in range(80)]
    rows += [charge_row(h, resource="both", provider="AWS", status="Unused", cost=4.0 - h / 100) for h in (90, 85)]
    rows += [charge_row(h % 24, resource=None, account=f"a{h % 30}", service=f"s{h % 9}", cost=0.0, quantity=0.0, cpu=0.1) for h in range(600)]
    rows += [charge_row(5, resource=None, service="s1", status="unused", cost=2.0), charge_row(3, resource=None, service="s2", status="unused", cost=3.0)]
    return written(charge_table(spark, rows))


def scans(df) -> int:
    return len(re.findall(r"FileScan parquet|Scan parquet", plan(df)))


def test_unused_rules_read_charges_once(mixed_charges):
    table = detection.rollup_of(mixed_charges)
    assert scans(detection.unused_report(mixed_charges)) == scans(unused.unused_stats(table)) == 1
    found = {r.ResourceId: (r.UnusedReason, r.WastedCost) for r in detection.unused_report(mixed_charges).collect()}
    assert found == {"idleGCP": ("Zero-Usage-80h", 0.0), "idleAWS": ("Zero-Usage-80h", 0.0), "both": ("Commitment-Unused", 3.15),
                     None: ("Commitment-Unused", 3.0)}
    # The same as rule by rule, each with a pass of its own.
    plain = table.drop(*rollup.LAYOUT)
    apart = unused.first_per_resource([unused.unused_commitments_in_rollup(plain), unused.zero_usage_streaks(table)])
    names = apart.columns
    assert sorted(map(repr, unused.unused_resources(table).select(*names).collect())) == sorted(map(repr, apart.select(*names).collect()))
    stats = {r.condition: (r.gcp, r.aws, r.total, r.rollup_rows) for r in unused.unused_stats(table).collect()}
    rows = plain.count()
    assert stats == {"commitment_unused": (2, 2, 4, rows), "zero_usage": (1, 2, 3, rows)}


def test_detection_stats_read_charges_once(mixed_charges):
    table = detection.rollup_of(mixed_charges).withColumns(
        {"PredictedCPUClass": F.lit("Low"), "PredictedMemoryClass": F.lit("High")})
    found = overprovisioned.detection_stats_of_rollup(table)
    assert scans(found) == 1
    both = overprovisioned.union_of_clouds(overprovisioned.gcp_low_streaks(table), overprovisioned.aws_low_streaks(table))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, overprovisioned.detection_stats(table, both).collect()))


def test_a_day_without_resources_is_spread_in_every_plan(spark, mixed_charges):
    table = detection.rollup_of(mixed_charges)
    used = table.filter("ResourceId IS NULL").select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 3
    low = detection.low_usage_report(mixed_charges).filter("ResourceId IS NULL")
    expected = mixed_charges.filter("ResourceId IS NULL AND SimulatedCPUUsage < 0.3").groupBy("ServiceName").agg(
        F.count_distinct("ChargePeriodStart").alias("n")).filter("n >= 24")
    assert {r.ServiceName: r.LowUsageHours for r in low.collect()} == {r.ServiceName: r.n for r in expected.collect()}


def test_distinct_counts_expand_nothing(mixed_charges, spark):
    table = detection.rollup_of(mixed_charges)
    hourly = rollup.hourly_aggregate(table)
    for made in (rollup.rollup_summary(table), rollup.rollup_by_provider(table), rollup.provider_comparison(hourly), rollup.hourly_summary_totals(hourly)):
        text = plan(made)
        assert "Expand" not in text and "HourlyTimestamp" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", text))
    # Charges that begin between hours: times, not hours, are told apart; missing times count as none.
    rows = [charge_row(0.5, hours=3, resource="a"), charge_row(1, hours=2, resource="b"), charge_row(1, hours=2, resource="a", account="z"),
            charge_row(1, hours=2, resource=None, provider="AWS")]
    own = rollup.resource_hours_of_charges(charge_table(spark, rows))
    expected = own.agg(F.count_distinct("ResourceId"), F.count_distinct("BillingAccountId"), F.count(F.lit(1))).first()
    found = rollup.rollup_summary(own).first()
    assert (found.UniqueResources, found.UniqueAccounts, found.GroupedRows) == tuple(expected) == (2, 2, 9)
    byhour = rollup.hourly_aggregate(own)
    both = {r.ProviderName: (r.UniqueResources, r.UniqueHours, r.TotalRecords) for r in rollup.provider_comparison(byhour).collect()}
    assert both == {"GCP": (2, 5, 7), "AWS": (0, 2, 2)}
    assert rollup.hourly_summary_totals(byhour).first().UniqueHours == 5
    empty = rollup.hourly_summary_totals(byhour.limit(0)).collect()
    assert [tuple(r)[:3] for r in empty] == [(0, 0, 0)]
