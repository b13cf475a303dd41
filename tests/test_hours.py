"""Hour expansion and rollups."""

import random

import pytest
from pyspark.sql import functions as F

from idlespan.operators import overprovisioned, rollup, timegrid
from tests.helpers import CHARGE_SCHEMA, charge_row, charge_table, same_rows


@pytest.mark.parametrize("hours, expected", [(0, 1), (-5, 1), (1.9, 1), (2, 2), (2.99, 2), (24, 24)])
def test_period_hours(spark, hours, expected):
    row = timegrid.with_hourly_cost(charge_table(spark, [charge_row(hours=hours)])).first()
    assert row.OriginalDurationHours == expected
    assert row.HourlyCost == 10.0 / expected


def test_expansion_keeps_minutes_and_other_amounts(spark):
    rows = timegrid.expand_hours(charge_table(spark, [charge_row(start_hour=0.5, hours=3)])).orderBy(
        "HourlyTimestamp").collect()
    assert [r.HourlyTimestamp.minute for r in rows] == [30, 30, 30]
    assert [r.EffectiveCost for r in rows] == [10.0] * 3
    spread = timegrid.expand_hours(charge_table(spark, [charge_row(hours=4)]), spread_all=True).collect()
    assert [r.EffectiveCost for r in spread] == [2.5] * 4


def test_parse_drops_bad_rows(spark):
    text = spark.createDataFrame(
        [("2024-01-01 00:00:00", "2024-01-01 02:00:00", "5"), ("soon", "2024-01-01 02:00:00", "5"),
         ("2024-01-01 00:00:00", "2024-01-01 02:00:00", ""), ("2024-01-01 00:00:00", "2024-01-01 02:00:00", "free")],
        "ChargePeriodStart string, ChargePeriodEnd string, BilledCost string")
    parsed = timegrid.parse_charges(text)
    assert dict(parsed.dtypes)["ChargePeriodStart"] == "timestamp_ntz"
    assert [r.BilledCost for r in parsed.collect()] == [5.0]


def test_missing_columns_raise_before_any_job(spark):
    with pytest.raises(ValueError, match="ChargePeriodEnd"):
        timegrid.parse_charges(spark.range(1).withColumn("ChargePeriodStart", F.lit("x")))
    with pytest.raises(ValueError, match="BillingAccountId"):
        rollup.resource_hours(spark.range(1))


def _random_charges(spark, seed, size=400):
    dice = random.Random(seed)
    rows = [charge_row(
        start_hour=dice.choice([dice.randint(0, 90), dice.uniform(0, 90)]),
        hours=dice.choice([0, 1, 1.9, 3, 23.5, 24, 25, 49, dice.uniform(0, 80)]),
        # One resource holds most rows.
        resource=dice.choice(["hot"] * 5 + ["r1", "r2", None]), account=dice.choice("ab"),
        cost=dice.uniform(0, 9), status=dice.choice([None, "Used", "Unused"]),
        quantity=dice.choice([None, 0.0, 2.0]), cpu=dice.choice([None, 0.1, 0.7]))
        for _ in range(size)]
    return charge_table(spark, rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_late_expansion_equals_expansion_first(spark, seed):
    charges = _random_charges(spark, seed)
    late = rollup.resource_hours_of_charges(charges)
    first = rollup.resource_hours(timegrid.expand_hours(charges))
    assert same_rows(late, first)


def test_hourly_summary_equals_grouping_the_expansion(spark):
    charges = _random_charges(spark, 4)
    direct = timegrid.expand_hours(charges).groupBy("HourlyTimestamp").agg(
        F.count(F.lit(1)).alias("RecordCount"), F.sum("HourlyCost").alias("TotalCost"),
        F.avg("HourlyCost").alias("AvgCost"))
    assert same_rows(timegrid.hourly_summary(charges), direct)


def test_sum_of_only_nulls_is_zero(spark):
    table = rollup.resource_hours_of_charges(charge_table(spark, [charge_row(quantity=None, cpu=None)]))
    row = table.first()
    assert row.TotalConsumedQuantity == 0.0 and row.AvgCPUUsage is None


def test_hourly_aggregate_ignores_missing_resources_in_count_only(spark):
    table = rollup.resource_hours_of_charges(charge_table(spark, [charge_row(resource=None, hours=2)]))
    rows = rollup.hourly_aggregate(table).collect()
    assert [(r.RecordCount, r.HourlyCost) for r in rows] == [(0, 5.0), (0, 5.0)]


def test_late_expansion_plan_expands_after_the_shuffle(spark):
    table = rollup.resource_hours_of_charges(
        spark.createDataFrame([charge_row()], CHARGE_SCHEMA), keep_usage_date=True)
    windowed = table.groupBy("ResourceId", *rollup.LAYOUT).count()
    plan = windowed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # equal pieces, then resource and day


def _grouped_plainly(expanded):
    """The rollup as one plain grouping of all hours."""
    keys = rollup.rollup_keys(expanded.columns)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return expanded.groupBy(*keys).agg(
        zero("HourlyCost").alias("TotalHourlyCost"), F.count(F.lit(1)).alias("RecordCount"),
        F.avg("SimulatedCPUUsage").alias("AvgCPUUsage"), F.avg("SimulatedMemoryUsage").alias("AvgMemoryUsage"),
        zero("EffectiveCost").alias("TotalEffectiveCost"), zero("BilledCost").alias("TotalBilledCost"),
        zero("ConsumedQuantity").alias("TotalConsumedQuantity"))


def test_rollups_equal_plain_grouping(spark):
    charges = _random_charges(spark, 5, 120)
    charges = charges.unionAll(charges.limit(40)).unionAll(charges.limit(40))  # some come three times
    expanded = timegrid.expand_hours(charges)
    assert same_rows(rollup.resource_hours_of_charges(charges), _grouped_plainly(expanded))
    # An expanded table may lack hours, repeat others, or have rows without a time.
    odd = expanded.filter(F.hour("HourlyTimestamp") % 5 != 3).unionAll(expanded.filter(F.hour("HourlyTimestamp") == 7))
    odd = odd.unionAll(expanded.limit(9).withColumn("HourlyTimestamp", F.lit(None).cast("timestamp_ntz")))
    assert same_rows(rollup.resource_hours(odd), _grouped_plainly(odd))


def test_rollups_neither_move_nor_hold_hours(spark):
    charges = charge_table(spark, [charge_row(hours=30)])
    for table in (rollup.resource_hours_of_charges(charges), rollup.resource_hours(timegrid.expand_hours(charges))):
        plan = table._jdf.queryExecution().executedPlan().toString()
        grouped = [line for line in plan.splitlines() if "Aggregate(keys=[" in line or "Exchange" in line or "Sort [" in line]
        assert grouped and not any("HourlyTimestamp" in line.split("functions=")[0] for line in grouped), grouped


def test_hourly_aggregate_of_stretches_equals_that_of_hours(spark):
    charges = _random_charges(spark, 6, 200)
    for layout in (True, False):
        hours = rollup.resource_hours_of_charges(charges, keep_usage_date=layout)
        stretches = rollup.resource_stretches_of_charges(charges, keep_usage_date=layout)
        assert stretches.count() < hours.count()
        plain, packed = rollup.hourly_aggregate(hours), rollup.hourly_aggregate(stretches)
        assert same_rows(rollup.hours_of_stretches(packed), plain) and same_rows(rollup.hourly_aggregate(stretches, ordered=True), plain)
        text = packed._jdf.queryExecution().executedPlan().toString()
        assert not any("HourlyTimestamp" in line.split("functions=")[0] for line in text.splitlines() if "Aggregate(keys=[" in line or "Exchange" in line)
        for summary in (rollup.hourly_summary_totals, rollup.provider_comparison, overprovisioned.low_usage_hours):
            assert same_rows(summary(packed), summary(plain), 6)
        for summary in (rollup.rollup_by_provider, rollup.rollup_summary):
            assert same_rows(summary(stretches), summary(hours), 6)


def test_providers_need_neither_hours_nor_other_amounts(spark):
    charges = _random_charges(spark, 7, 150)
    stretches = rollup.resource_stretches_of_charges(charges)
    found = rollup.rollup_by_provider(stretches)
    grouped = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(" in line]
    assert grouped and not any(c in line for c in ("ConsumedQuantity", "EffectiveCost", "SimulatedCPUUsage", "struct(") for line in grouped)
    hours = rollup.resource_hours_of_charges(charges)
    expected = hours.groupBy("ProviderName").agg(F.count_distinct("ResourceId").alias("Resources"), F.sum("TotalHourlyCost").alias("TotalCost"))
    assert same_rows(found, expected, 6) and same_rows(rollup.rollup_by_provider(hours), expected, 6)


def test_stats_sink_tells_no_hours_apart(spark, tmp_path, monkeypatch):
    from catalog import QUERIES

    day = "TIMESTAMP_NTZ'1996-01-02'"
    spark.sql(f"SELECT id AS l_orderkey, id AS l_partkey, id % 4 AS l_suppkey, 1 AS l_linenumber, 30D AS l_quantity, 60D AS l_extendedprice, 0D AS l_discount, "
              f"0D AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, {day} AS l_shipdate FROM range(8)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS s_suppkey, 's' AS s_name, 0 AS s_nationkey, 0D AS s_acctbal FROM range(4)").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("SELECT 0 AS n_nationkey, 'n' AS n_name, 0 AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("SELECT 0 AS r_regionkey, 'r' AS r_name").write.parquet(f"{tmp_path}/region.parquet")
    monkeypatch.setattr(rollup, "hours_of_stretches", lambda *_: pytest.fail("hours told apart"))
    rows = {r.ProviderName: (r.Resources, r.TotalCost) for r in QUERIES["s11_stats_sink"](spark, str(tmp_path)).collect()}
    assert rows == {"GCP": (2, 240.0), "AWS": (2, 240.0)}
