"""Longest runs, and the detectors built on them."""

import random

import pytest
from pyspark.sql import functions as F

from idlespan.operators import overprovisioned, rollup, unused
from idlespan.operators.streaks import longest_runs
from tests.helpers import charge_row, charge_table, rollup_row, rollup_table, same_rows


def _longest(rows, low, gap_aware=False):
    """Brute force over (hour, account, cpu) rows of one resource."""
    best = run = 0
    previous = None
    for hour, account, cpu in sorted(rows):
        if gap_aware and previous is not None and hour != previous + 1:
            run = 0
        run = run + 1 if low(cpu) else 0
        best, previous = max(best, run), hour
    return best


@pytest.mark.parametrize("gap_aware", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(spark, seed, gap_aware):
    dice = random.Random(seed)
    by_resource = {}
    for resource, size in (("hot", 900), ("r1", 100), ("r2", 30), ("one", 1)):
        keys = {(dice.randint(0, 400), dice.choice("abc")) for _ in range(size)}
        share = dice.choice([0.05, 0.5, 0.95])
        by_resource[resource] = [(h, a, 0.9 if dice.random() < share else 0.1) for h, a in keys]
    table = rollup_table(spark, [
        rollup_row(h, resource=r, account=a, cpu=c) for r, rows in by_resource.items() for h, a, c in rows])
    runs = longest_runs(table, {"low": F.col("AvgCPUUsage") < 0.3, "high": F.col("AvgCPUUsage") >= 0.3},
                        gap_aware=gap_aware)
    found = {r.ResourceId: (r.low, r.high, r.RowCount) for r in runs.collect()}
    assert found == {
        r: (_longest(rows, lambda c: c < 0.3, gap_aware), _longest(rows, lambda c: c >= 0.3, gap_aware), len(rows))
        for r, rows in by_resource.items()}


@pytest.mark.parametrize("length, found", [(23, 0), (24, 1)])
def test_minimum_length(spark, length, found):
    rows = [rollup_row(h) for h in range(length)] + [rollup_row(length, cpu=0.9)]
    assert overprovisioned.gcp_low_streaks(rollup_table(spark, rows)).count() == found


def test_missing_hour_ends_a_run_only_when_gap_aware(spark):
    rows = rollup_table(spark, [rollup_row(h) for h in range(30) if h != 15])
    assert overprovisioned.gcp_low_streaks(rows).first().ConsecutiveCPUHours == 29
    assert overprovisioned.gcp_low_streaks(rows, gap_aware=True).count() == 0


def test_missing_usage_is_low_and_missing_resource_is_left_out(spark):
    rows = [rollup_row(h, cpu=None) for h in range(24)] + [rollup_row(h, resource=None) for h in range(24)]
    found = overprovisioned.gcp_low_streaks(rollup_table(spark, rows)).collect()
    assert [(r.ResourceId, r.CPUStatus, r.MemoryStatus, r.CPUValue) for r in found] == [
        ("r1", "OverProvisioned", "Normal", "0.0%")]


def test_savings_come_from_the_last_row(spark):
    rows = [rollup_row(h, cost=float(h)) for h in range(30)]
    found = overprovisioned.gcp_low_streaks(rollup_table(spark, rows)).first()
    assert (found.TotalHourlyCost, found.WasteRatio) == (29.0, 0.7)
    assert found.PotentialSavings == pytest.approx(29.0 * 0.7)


def test_last_row_of_a_tie_is_the_last_by_name(spark):
    rows = [rollup_row(h) for h in range(24)] + [rollup_row(23, account=None, cost=1.0),
                                                  rollup_row(23, account="z", cost=3.0)]
    assert overprovisioned.gcp_low_streaks(rollup_table(spark, rows)).first().TotalHourlyCost == 3.0


def test_only_compute_services_of_the_cloud(spark):
    rows = [rollup_row(h, service=s, provider=p, resource=s + p) for h in range(24)
            for s, p in (("Cloud SQL", "GCP"), ("Compute Engine", "AWS"), ("Compute Engine", "Google"))]
    found = overprovisioned.gcp_low_streaks(rollup_table(spark, rows)).collect()
    assert [r.ResourceId for r in found] == ["Compute EngineGoogle"]


def test_class_streaks(spark):
    rows = rollup_table(spark, [rollup_row(h, provider="AWS", service="Amazon EC2") for h in range(24)])
    low = rows.withColumns({"PredictedCPUClass": F.lit("Low"), "PredictedMemoryClass": F.lit("High")})
    found = overprovisioned.aws_low_streaks(low).first()
    assert (found.CPUStatus, found.MemoryStatus, found.WasteRatio, found.CPUValue) == (
        "OverProvisioned", "Normal", 0.5, "Low (ML)")


@pytest.mark.parametrize("length, found", [(71, 0), (72, 1)])
def test_zero_usage_streak(spark, length, found):
    rows = [rollup_row(h, cost=0.0, quantity=0.0) for h in range(length)]
    rows.append(rollup_row(length, cost=5.0, quantity=0.0))
    result = unused.zero_usage_streaks(rollup_table(spark, rows)).collect()
    assert [r.UnusedReason for r in result] == ["Zero-Usage-72h"] * found


def test_zero_usage_looks_at_one_cost_column(spark):
    rows = [rollup_row(h, cost=5.0, effective=0.0, quantity=0.0) for h in range(72)]
    assert unused.zero_usage_streaks(rollup_table(spark, rows)).count() == 1
    assert unused.zero_usage_streaks(rollup_table(spark, rows).drop("TotalEffectiveCost")).count() == 0


def _overlapping(spark, seed):
    """Charges whose hours overlap within a resource, begin between hours, or begin where others end."""
    dice = random.Random(seed)
    rows = [charge_row(
        start_hour=dice.choice([dice.randint(0, 300), dice.randint(0, 300) + 0.5, dice.uniform(0, 300)]), hours=dice.choice([1, 3, 24, 25, 49, dice.uniform(0, 60)]),
        resource=dice.choice(["hot"] * 5 + ["r1", "r2", None]), account=dice.choice(["a", "b", None]), service=dice.choice(["Compute Engine", "Cloud SQL"]),
        provider=dice.choice(["GCP", "AWS"]), cost=dice.choice([0.0, 0.0, 0.0, 4.0]), status=dice.choice([None, "Used", "Used", "unused"]),
        quantity=dice.choice([None, 0.0, 0.0, 2.0]), cpu=dice.choice([None, 0.1, 0.1, 0.7])) for _ in range(120)]
    rows += [charge_row(start_hour=h, hours=100, resource="long", status=s, cost=c, quantity=0.0) for h, s, c in (
        (0, None, 0.0), (7, "Used", 0.0), (120, None, 0.0), (125, "Used", 1.0), (230, None, 0.0))]
    table = charge_table(spark, rows)
    return [made(table, keep_usage_date=layout) for layout in (True, False)
            for made in (rollup.resource_stretches_of_charges, rollup.resource_hours_of_charges)]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_of_stretches_equal_those_of_hours(spark, seed):
    flags = {"free": F.col("TotalHourlyCost") == 0, "idle": F.coalesce("AvgCPUUsage", F.lit(0.0)) < 0.3}
    stretches, hours, bare_stretches, bare_hours = _overlapping(spark, seed)
    for packed, plain in ((stretches, hours), (bare_stretches, bare_hours)):
        assert packed.count() < plain.count() / 2
        for gap_aware in (False, True):
            options = {"means": ["AvgCPUUsage"], "keep_last": ["HourlyTimestamp", "BillingAccountId", "TotalBilledCost"], "gap_aware": gap_aware}
            assert same_rows(longest_runs(packed, flags, **options), longest_runs(plain, flags, **options))
    # Where clocks may be put forward, hours are told apart.
    zoned = bare_stretches.withColumn("HourlyTimestamp", F.col("HourlyTimestamp").cast("timestamp"))
    assert same_rows(longest_runs(zoned, flags, gap_aware=True), longest_runs(bare_hours, flags, gap_aware=True))


def test_stretches_without_a_time_are_counted(spark):
    rows = [rollup_row(0, account="a"), rollup_row(0, account="b", cpu=0.9), rollup_row(30)]
    table = rollup_table(spark, rows).withColumn("HourlyTimestamp", F.when(F.col("HourlyTimestamp") >= "2024-01-02", F.col("HourlyTimestamp")))
    table = table.withColumn(rollup.STRETCH, F.lit(3))
    flags = {"low": F.col("AvgCPUUsage") < 0.3}
    found = longest_runs(table, flags).first()
    assert (found.low, found.RowCount) == tuple(longest_runs(rollup.hours_of_stretches(table), flags).select("low", "RowCount").first()) == (3, 9)


@pytest.mark.parametrize("seed", [3, 4])
def test_detectors_take_stretches(spark, seed):
    stretches, hours, _, _ = _overlapping(spark, seed)
    for made in (
            lambda t: unused.zero_usage_streaks(t, idle_days=1), lambda t: unused.zero_usage_streaks(t, idle_days=1, gap_aware=True),
            lambda t: unused.unused_resources(t, idle_days=1), lambda t: unused.unused_stats(t, idle_days=1),
            lambda t: overprovisioned.gcp_low_streaks(t, min_rows=5), lambda t: overprovisioned.gcp_low_streaks(t, min_rows=5, gap_aware=True)):
        packed, plain = made(stretches), made(hours)
        assert packed.columns == plain.columns and same_rows(packed, plain)
        assert made(hours).count() > 0


def test_streaks_of_stretches_hold_no_hours(spark):
    table = rollup.resource_stretches_of_charges(charge_table(spark, [charge_row(hours=30)]), keep_usage_date=True)
    for found in (unused.zero_usage_streaks(table), unused.unused_resources(table), unused.unused_stats(table)):
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "_hours" not in text and text.count("Exchange hashpartitioning") <= 4
    # Amounts and names that are not asked for are neither shuffled nor kept.
    asked = unused.zero_usage_streaks(table).select("ResourceId", "ConsecutiveZeroHours")
    grouped = [line for line in asked._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(" in line]
    assert not any("SimulatedCPUUsage" in line or "max_by" in line for line in grouped)
