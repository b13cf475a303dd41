"""Over-provisioned and unused resources (O and U operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.hours import hourly, low_hours, rolled, rolled_stretches
from catalog.registry import query, rounded
from catalog.sql import IS_AWS, IS_COMPUTE, IS_GCP, add, streaks, using
from idlespan import fixed_values as fixed
from idlespan.operators import learning, overprovisioned, timegrid, unused
from idlespan.operators.conversion import of_cloud
from idlespan.operators.streaks import longest_runs
from idlespan.plans import detection as plans
from idlespan.session import written

_LOW = {"ConsecutiveCPUHours": "AvgCPUUsage < 0.3", "ConsecutiveMemoryHours": "AvgMemoryUsage < 0.3"}
_ZERO = {"ConsecutiveZeroHours": "TotalEffectiveCost = 0 AND TotalConsumedQuantity = 0"}


def _gcp_streaks_sql(min_rows: int, gap_aware: bool = False) -> str:
    return using("gcp_compute", extra=streaks("gcp_compute", _LOW, gap_aware)) + f"""
SELECT r.ResourceId, l.ProviderName, l.ServiceName, l.ResourceType, r.ConsecutiveCPUHours, r.ConsecutiveMemoryHours,
       'Direct_Consecutive' AS DetectionMethod,
       CASE WHEN r.ConsecutiveCPUHours >= {min_rows} THEN 'OverProvisioned' ELSE 'Normal' END AS CPUStatus,
       CASE WHEN r.ConsecutiveMemoryHours >= {min_rows} THEN 'OverProvisioned' ELSE 'Normal' END AS MemoryStatus,
       round(m.cpu, 6) AS MeanCPU, round(m.memory, 6) AS MeanMemory,
       round(l.TotalHourlyCost, 8) AS TotalHourlyCost, CAST(0.7 AS DOUBLE) AS WasteRatio,
       round(l.TotalHourlyCost * 0.7, 6) AS PotentialSavings
FROM runs r JOIN lasts l USING (ResourceId)
JOIN (SELECT ResourceId, avg(AvgCPUUsage) AS cpu, avg(AvgMemoryUsage) AS memory FROM gcp_compute GROUP BY 1) m
  USING (ResourceId)
WHERE r.ConsecutiveCPUHours >= {min_rows} OR r.ConsecutiveMemoryHours >= {min_rows}"""


_STREAK_COLUMNS = ("ResourceId", "ProviderName", "ServiceName", "ResourceType", "ConsecutiveCPUHours",
                   "ConsecutiveMemoryHours", "DetectionMethod", "CPUStatus", "MemoryStatus", "MeanCPU",
                   "MeanMemory", "TotalHourlyCost", "WasteRatio", "PotentialSavings")


def _gcp_streaks(charges, **options):
    found = overprovisioned.gcp_low_streaks(rolled_stretches(charges), **options)
    return rounded(found.select(*_STREAK_COLUMNS), MeanCPU=6, MeanMemory=6, TotalHourlyCost=8, PotentialSavings=6)


@query("o1_low_usage_rows", using("charges") + """
SELECT ResourceId, ChargePeriodStart, BilledCost, SimulatedCPUUsage,
       (1 - SimulatedCPUUsage) * 100 AS WastePercentage, BilledCost * 0.6 AS PotentialSavings
FROM charges WHERE SimulatedCPUUsage IS NOT NULL AND SimulatedCPUUsage < 0.3""")
def _(charges):
    return overprovisioned.low_usage_charges(charges).select(
        "ResourceId", "ChargePeriodStart", "BilledCost", "SimulatedCPUUsage", "WastePercentage", "PotentialSavings")


@query("o2_low_usage_hours", using("low_hours") + """
SELECT ProviderName, ResourceId, ServiceName, LowUsageHours, round(TotalWastedCost, 3) AS TotalWastedCost,
       round(AvgCPU, 6) AS AvgCPU, round(AvgMemory, 6) AS AvgMemory, FirstLowUsage, LastLowUsage,
       round((1 - AvgCPU) * 100, 5) AS CPUWastePercent, round((1 - AvgMemory) * 100, 5) AS MemoryWastePercent
FROM low_hours""")
def _(charges):
    return rounded(low_hours(charges), TotalWastedCost=3, AvgCPU=6, AvgMemory=6, CPUWastePercent=5,
                   MemoryWastePercent=5)


@query("o2_low_usage_by_provider", using("low_hours") + """
SELECT ProviderName, count(*) AS Resources, round(sum(TotalWastedCost), 2) AS TotalCost,
       CAST(sum(LowUsageHours) AS BIGINT) AS TotalHours FROM low_hours GROUP BY 1""")
def _(charges):
    return rounded(overprovisioned.low_hours_by_provider(low_hours(charges)), TotalCost=2)


@query("o3_gcp_low_streaks", _gcp_streaks_sql(24))
def _(charges):
    return _gcp_streaks(charges)


@query("o3_gcp_low_streaks_of_200", _gcp_streaks_sql(200))
def _(charges):
    return _gcp_streaks(charges, min_rows=200)


@query("o3_gcp_low_streaks_gap_aware", _gcp_streaks_sql(24, gap_aware=True))
def _(charges):
    return _gcp_streaks(charges, gap_aware=True)


@query("o3_all_streak_lengths", using("rollup", extra=streaks("rollup", {
    "free_run": "TotalHourlyCost = 0", "idle_run": "coalesce(AvgCPUUsage, 0) < 0.3"})) + """
SELECT ResourceId, free_run, idle_run FROM runs""")
def _(charges):
    """Runs of two flags over every resource of both clouds, without a minimum."""
    return longest_runs(rolled_stretches(charges), {
        "free_run": F.col("TotalHourlyCost") == 0,
        "idle_run": F.coalesce("AvgCPUUsage", F.lit(0.0)) < 0.3}).drop("RowCount")


def _predicted_by_type(charges):
    """A deterministic stand-in for predicted classes, so that SQL can follow."""
    return _with_stand_in(of_cloud(rolled(charges), "AWS"))


def _with_stand_in(rollup):
    cpu = F.when(F.hour("HourlyTimestamp") < 20, "Low").otherwise("Medium")
    memory = F.when(F.col("TotalHourlyCost") < 3000, "Low").otherwise("High")
    return rollup.withColumns({"PredictedCPUClass": cpu, "PredictedMemoryClass": memory})


add("aws_classes", ("rollup",), f"""
SELECT *, CASE WHEN hour(HourlyTimestamp) < 20 THEN 'Low' ELSE 'Medium' END AS PredictedCPUClass,
       CASE WHEN TotalHourlyCost < 3000 THEN 'Low' ELSE 'High' END AS PredictedMemoryClass
FROM rollup WHERE {IS_AWS}""")
add("aws_compute", ("aws_classes",), f"SELECT * FROM aws_classes WHERE {IS_COMPUTE}")

_CLASS_LOW = {"ConsecutiveCPUHours": "PredictedCPUClass = 'Low'",
              "ConsecutiveMemoryHours": "PredictedMemoryClass = 'Low'"}


@query("o4_aws_class_streaks", using("aws_compute", extra=streaks("aws_compute", _CLASS_LOW)) + """
SELECT r.ResourceId, l.ProviderName, l.ServiceName, r.ConsecutiveCPUHours, r.ConsecutiveMemoryHours,
       'ML_Consecutive' AS DetectionMethod, 'Low (ML)' AS CPUValue,
       CASE WHEN r.ConsecutiveCPUHours >= 24 THEN 'OverProvisioned' ELSE 'Normal' END AS CPUStatus,
       CASE WHEN r.ConsecutiveMemoryHours >= 24 THEN 'OverProvisioned' ELSE 'Normal' END AS MemoryStatus,
       round(l.TotalHourlyCost, 8) AS TotalHourlyCost, round(l.TotalHourlyCost * 0.5, 6) AS PotentialSavings
FROM runs r JOIN lasts l USING (ResourceId)
WHERE r.ConsecutiveCPUHours >= 24 OR r.ConsecutiveMemoryHours >= 24""")
def _(charges):
    found = overprovisioned.aws_low_streaks(_predicted_by_type(charges))
    return rounded(found.select(
        "ResourceId", "ProviderName", "ServiceName", "ConsecutiveCPUHours", "ConsecutiveMemoryHours",
        "DetectionMethod", "CPUValue", "CPUStatus", "MemoryStatus", "TotalHourlyCost", "PotentialSavings"),
        TotalHourlyCost=8, PotentialSavings=6)


def _found_sql(source: str, flags: dict[str, str], ratio: float, method: str) -> str:
    parts = streaks(source, flags)
    inner = ", ".join(f"{n} AS ({t})" for n, t in parts.items())
    return f"""
WITH {inner}
SELECT l.ResourceId, l.ProviderName, l.ServiceName, '{method}' AS DetectionMethod, l.TotalHourlyCost,
       l.TotalHourlyCost * {ratio} AS PotentialSavings
FROM runs r JOIN lasts l USING (ResourceId)
WHERE r.ConsecutiveCPUHours >= 24 OR r.ConsecutiveMemoryHours >= 24"""


add("gcp_found", ("gcp_compute",), _found_sql("gcp_compute", _LOW, 0.7, "Direct_Consecutive"))
add("aws_found", ("aws_compute",), _found_sql("aws_compute", _CLASS_LOW, 0.5, "ML_Consecutive"))
add("both_found", ("gcp_found", "aws_found"), "SELECT * FROM gcp_found UNION ALL SELECT * FROM aws_found")


def _both_clouds(charges):
    return overprovisioned.union_of_clouds(
        overprovisioned.gcp_low_streaks(rolled_stretches(charges)),
        overprovisioned.aws_low_streaks(_predicted_by_type(charges)))


@query("o5_union_of_clouds", using("both_found") + """
SELECT ResourceId, ProviderName, ServiceName, DetectionMethod, round(PotentialSavings, 6) AS PotentialSavings
FROM both_found""")
def _(charges):
    return rounded(_both_clouds(charges).select(
        "ResourceId", "ProviderName", "ServiceName", "DetectionMethod", "PotentialSavings"), PotentialSavings=6)


@query("o6_detection_stats", using("both_found", "rollup") + f"""
SELECT t.Cloud, t.Total, coalesce(f.n, 0) AS OverProvisioned,
       round(coalesce(f.n, 0) / t.Total * 100, 8) AS Percent,
       round(coalesce(f.s, 0), 4) AS HourlySavings, round(coalesce(f.s, 0) * 720, 2) AS MonthlySavings,
       round(coalesce(f.s, 0) * 8760, 2) AS YearlySavings
FROM (SELECT CASE WHEN {IS_GCP} THEN 'GCP' ELSE 'AWS' END AS Cloud, count(*) AS Total
      FROM rollup WHERE {IS_COMPUTE} GROUP BY 1) t
LEFT JOIN (SELECT CASE WHEN {IS_GCP} THEN 'GCP' ELSE 'AWS' END AS Cloud, count(*) AS n,
                  sum(PotentialSavings) AS s FROM both_found GROUP BY 1) f USING (Cloud)""")
def _(charges):
    stats = overprovisioned.detection_stats_of_rollup(_with_stand_in(rolled(charges)))
    return rounded(stats, Percent=8, HourlySavings=4, MonthlySavings=2, YearlySavings=2)


def _estimated(charges):
    patterns = written(learning.learn_patterns(learning.clean_usage(charges)))
    aws = charges.filter(F.col("ProviderName") == "AWS")
    # Stored, so that its size is known and Spark need not shuffle the charges to join it.
    return learning.attach_estimates(aws, written(learning.estimate_services(charges, patterns)))


@query("o7_estimate_based_detection", using("low_estimates") + """
SELECT ResourceId, ServiceName, ChargePeriodStart, method, round(cpu_mean, 8) AS cpu_mean,
       round(memory_mean, 8) AS memory_mean, round(CPUWastePercent, 6) AS CPUWastePercent,
       round(MemoryWastePercent, 6) AS MemoryWastePercent, PotentialSavings FROM low_estimates""")
def _(charges):
    return rounded(overprovisioned.low_estimates(_estimated(charges)).select(
        "ResourceId", "ServiceName", "ChargePeriodStart", "method", "cpu_mean", "memory_mean",
        "CPUWastePercent", "MemoryWastePercent", "PotentialSavings"),
        cpu_mean=8, memory_mean=8, CPUWastePercent=6, MemoryWastePercent=6)


@query("o8_estimate_based_summary", using("low_estimates") + """
SELECT count(*) AS overprovisioned_count, round(avg(cpu_mean) * 100, 5) AS avg_cpu_usage,
       round(avg(memory_mean) * 100, 5) AS avg_memory_usage, round(avg(CPUWastePercent), 5) AS avg_cpu_waste,
       round(avg(MemoryWastePercent), 5) AS avg_memory_waste, round(avg(confidence), 6) AS avg_confidence,
       count(*) FILTER (WHERE method = 'exact_match') AS exact_match_count,
       count(*) FILTER (WHERE method = 'global_average') AS global_avg_count,
       count(*) FILTER (WHERE confidence >= 0.8) AS high_confidence,
       count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.8) AS medium_confidence,
       count(*) FILTER (WHERE confidence < 0.5) AS low_confidence,
       round(coalesce(sum(PotentialSavings), 0), 2) AS total_potential_savings,
       (SELECT count(*) FROM estimated) AS total_records,
       round(coalesce(sum(PotentialSavings), 0) * 12, 1) AS yearly_savings,
       round(count(*) / (SELECT count(*) FROM estimated) * 100, 8) AS detection_rate
FROM low_estimates""")
def _(charges):
    estimated = _estimated(charges)
    summary = overprovisioned.estimate_detection_summary(estimated, overprovisioned.low_estimates(estimated))
    return rounded(summary, avg_cpu_usage=5, avg_memory_usage=5, avg_cpu_waste=5, avg_memory_waste=5,
                   avg_confidence=6, total_potential_savings=2, yearly_savings=1, detection_rate=8)


def _predicted_by_hour(charges):
    """A deterministic stand-in for predicted usage."""
    return of_cloud(rolled(charges), "AWS").withColumns({
        "PredictedCPU": (F.hour("HourlyTimestamp") + 1) / 25.0,
        "PredictedMemory": F.least(F.col("TotalConsumedQuantity") / 50.0, F.lit(1.0))})


add("aws_predictions", ("rollup",), f"""
SELECT *, (hour(HourlyTimestamp) + 1) / 25.0 AS PredictedCPU,
       least(TotalConsumedQuantity / 50.0, 1.0) AS PredictedMemory
FROM rollup WHERE {IS_AWS}""")
add("flagged", ("aws_predictions",), """
SELECT *, PredictedCPU < 0.3 OR PredictedMemory < 0.3 AS IsOverProvisioned,
       CASE WHEN PredictedCPU < 0.3 OR PredictedMemory < 0.3 THEN TotalHourlyCost * 0.6 ELSE 0.0 END AS PotentialSavings
FROM aws_predictions""")


@query("o9_prediction_flags", using("flagged") + """
SELECT ProviderName, ServiceName, IsOverProvisioned, count(*) AS n, round(avg((1 - PredictedCPU) * 100), 5) AS cpu_waste,
       round(avg((1 - PredictedMemory) * 100), 5) AS memory_waste, round(sum(PotentialSavings), 2) AS savings
FROM flagged GROUP BY ALL""")
def _(charges):
    flagged = overprovisioned.flag_predictions(_predicted_by_hour(charges))
    return rounded(flagged.groupBy("ProviderName", "ServiceName", "IsOverProvisioned").agg(
        F.count(F.lit(1)).alias("n"), F.avg("CPUWastePercent").alias("cpu_waste"),
        F.avg("MemoryWastePercent").alias("memory_waste"), F.sum("PotentialSavings").alias("savings")),
        cpu_waste=5, memory_waste=5, savings=2)


@query("o10_class_flags", using("aws_classes") + """
SELECT PredictedCPUClass, PredictedMemoryClass,
       PredictedCPUClass = 'Low' OR PredictedMemoryClass = 'Low' AS IsOverProvisioned, count(*) AS n
FROM aws_classes GROUP BY ALL""")
def _(charges):
    return overprovisioned.flag_classes(_predicted_by_type(charges)).groupBy(
        "PredictedCPUClass", "PredictedMemoryClass", "IsOverProvisioned").agg(F.count(F.lit(1)).alias("n"))


@query("o11_prediction_summary", using("flagged") + """
SELECT count(*) AS total, count(*) FILTER (WHERE IsOverProvisioned) AS over_provisioned,
       count(*) FILTER (WHERE PredictedCPU < 0.3) AS cpu_below, count(*) FILTER (WHERE PredictedMemory < 0.3) AS memory_below,
       round(sum(PotentialSavings), 2) AS total_savings, round(avg(PredictedCPU), 6) AS cpu_mean,
       min(PredictedCPU) AS cpu_min, max(PredictedCPU) AS cpu_max, round(avg(PredictedMemory), 6) AS memory_mean,
       min(PredictedMemory) AS memory_min, max(PredictedMemory) AS memory_max,
       round(count(*) FILTER (WHERE IsOverProvisioned) / count(*) * 100, 8) AS over_provisioned_percent,
       round(sum(PotentialSavings) * 12, 1) AS yearly_savings, round(median(PredictedCPU), 8) AS cpu_median,
       round(median(PredictedMemory), 8) AS memory_median FROM flagged""")
def _(charges):
    summary = overprovisioned.prediction_summary(overprovisioned.flag_predictions(_predicted_by_hour(charges)))
    return rounded(summary, total_savings=2, cpu_mean=6, memory_mean=6, over_provisioned_percent=8,
                   yearly_savings=1, cpu_median=8, memory_median=8)


# --- unused ---------------------------------------------------------------------------

_CHARGE_COLUMNS = ("ResourceId", "ServiceName", "ChargePeriodStart", "BilledCost", "EffectiveCost",
                   "ConsumedQuantity", "UnusedReason", "WastedCost")
_CHARGE_LIST = ", ".join(_CHARGE_COLUMNS)


@query("u1_unused_commitment_rows", using("commitments") + f"SELECT {_CHARGE_LIST} FROM commitments")
def _(charges):
    return unused.unused_commitments(charges).select(*_CHARGE_COLUMNS)


@query("u1_unused_commitment_rows_with_cost",
       using("commitments") + f"SELECT {_CHARGE_LIST} FROM commitments WHERE EffectiveCost <> 0")
def _(charges):
    return unused.unused_commitments(charges, require_cost=True).select(*_CHARGE_COLUMNS)


@query("u2_zero_usage_rows", using("zero_charges") + f"SELECT {_CHARGE_LIST} FROM zero_charges")
def _(charges):
    return unused.zero_usage_charges(charges).select(*_CHARGE_COLUMNS)


@query("u2_zero_usage_rows_strict", using("charges") + """
SELECT ResourceId, ServiceName, ChargePeriodStart FROM charges
WHERE EffectiveCost = 0 AND BilledCost = 0 AND (ConsumedQuantity = 0 OR ConsumedQuantity IS NULL)""")
def _(charges):
    return unused.zero_usage_charges(charges, mode="strict").select("ResourceId", "ServiceName", "ChargePeriodStart")


@query("u3_first_per_resource", using("unused_charges") + f"SELECT {_CHARGE_LIST} FROM unused_charges")
def _(charges):
    return unused.unused_charges(charges).select(*_CHARGE_COLUMNS)


@query("u4_unused_commitments_in_rollup", using("rollup_commitments") + """
SELECT ResourceId, ProviderName, ServiceName, HourlyTimestamp, UnusedReason, DetectionMethod,
       round(WastedCost, 8) AS WastedCost FROM rollup_commitments""")
def _(charges):
    found = unused.unused_commitments_in_rollup(rolled(charges))
    return rounded(found.select("ResourceId", "ProviderName", "ServiceName", "HourlyTimestamp", "UnusedReason",
                                "DetectionMethod", "WastedCost"), WastedCost=8)


def _zero_sql(days: int, gap_aware: bool = False) -> str:
    return using("rollup", extra=streaks("rollup", _ZERO, gap_aware)) + f"""
SELECT r.ResourceId, l.ProviderName, l.ServiceName, r.ConsecutiveZeroHours,
       'Zero-Usage-' || r.ConsecutiveZeroHours || 'h' AS UnusedReason, 'Consecutive_Zero' AS DetectionMethod,
       CAST(0 AS DOUBLE) AS WastedCost, l.HourlyTimestamp
FROM runs r JOIN lasts l USING (ResourceId) WHERE r.ConsecutiveZeroHours >= {days * 24}"""


_ZERO_COLUMNS = ("ResourceId", "ProviderName", "ServiceName", "ConsecutiveZeroHours", "UnusedReason",
                 "DetectionMethod", "WastedCost", "HourlyTimestamp")


@query("u5_zero_usage_streaks", _zero_sql(3))
def _(charges):
    return unused.zero_usage_streaks(rolled_stretches(charges)).select(*_ZERO_COLUMNS)


@query("u5_zero_usage_streaks_of_80_days", _zero_sql(80))
def _(charges):
    return unused.zero_usage_streaks(rolled_stretches(charges), idle_days=80).select(*_ZERO_COLUMNS)


@query("u5_zero_usage_streaks_gap_aware", _zero_sql(3, gap_aware=True))
def _(charges):
    return unused.zero_usage_streaks(rolled_stretches(charges), gap_aware=True).select(*_ZERO_COLUMNS)


@query("u6_reason_distribution", using("commitments", "zero_charges") + """
, both_rules AS (SELECT * FROM commitments UNION ALL SELECT * FROM zero_charges)
SELECT UnusedReason, count(ResourceId) AS Count, round(sum(WastedCost), 2) AS Cost,
       round(count(ResourceId) / sum(count(ResourceId)) OVER () * 100, 8) AS CountPercent,
       round(sum(WastedCost) / sum(sum(WastedCost)) OVER () * 100, 8) AS CostPercent
FROM both_rules GROUP BY 1""")
def _(charges):
    from idlespan.operators.reports import reason_distribution
    both = timegrid.merge_tables(unused.unused_commitments(charges), unused.zero_usage_charges(charges))
    return rounded(reason_distribution(both), Cost=2, CountPercent=8, CostPercent=8)


@query("u7_commitment_stats", using("commitments") + """
SELECT CommitmentDiscountType, count(ResourceId) AS Count, round(sum(EffectiveCost), 2) AS Cost
FROM commitments WHERE CommitmentDiscountType IS NOT NULL GROUP BY 1""")
def _(charges):
    return rounded(unused.commitment_stats(unused.unused_commitments(charges)), Cost=2)


@query("u8_top_commitments", using("unused_charges") + """
SELECT ResourceId, ServiceName, CommitmentDiscountType, EffectiveCost, BilledCost FROM unused_charges
WHERE UnusedReason = 'Commitment-Unused' ORDER BY WastedCost DESC, ResourceId LIMIT 10""")
def _(charges):
    return unused.top_commitments(unused.unused_charges(charges)).select(
        "ResourceId", "ServiceName", "CommitmentDiscountType", "EffectiveCost", "BilledCost")


@query("u8_zero_usage_sample", using("zero_charges") + """
SELECT DISTINCT ON (ResourceId) ResourceId, UnusedReason FROM zero_charges ORDER BY ResourceId LIMIT 10""")
def _(charges):
    first = unused.first_per_resource([unused.zero_usage_charges(charges)])
    return unused.zero_usage_sample(first).select("ResourceId", "UnusedReason")


@query("u9_unused_stats", using("rollup", "rollup_commitments", extra=streaks("rollup", _ZERO)) + f"""
, zero AS (SELECT l.* FROM runs r JOIN lasts l USING (ResourceId) WHERE r.ConsecutiveZeroHours >= 72)
SELECT condition, gcp, aws, total, (SELECT count(*) FROM rollup) AS rollup_rows,
       round(total / (SELECT count(*) FROM rollup) * 100, 8) AS percent
FROM (SELECT 'commitment_unused' AS condition, count(*) FILTER (WHERE {IS_GCP}) AS gcp,
             count(*) FILTER (WHERE {IS_AWS}) AS aws, count(*) AS total FROM rollup_commitments
      UNION ALL SELECT 'zero_usage', count(*) FILTER (WHERE {IS_GCP}), count(*) FILTER (WHERE {IS_AWS}), count(*)
      FROM zero)""")
def _(charges):
    return rounded(unused.unused_stats(rolled_stretches(charges)), percent=8)


@query("u3_unused_resources", using("rollup", "rollup_commitments", extra=streaks("rollup", _ZERO)) + f"""
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ResourceId ORDER BY p, HourlyTimestamp, coalesce(ProviderName, ''),
    coalesce(BillingAccountId, ''), coalesce(ServiceName, ''), coalesce(ResourceType, ''),
    coalesce(CommitmentDiscountStatus, '')) AS pick
  FROM (SELECT 0 AS p, ResourceId, ProviderName, BillingAccountId, ServiceName, ResourceType,
               CommitmentDiscountStatus, HourlyTimestamp, UnusedReason, DetectionMethod,
               CAST(NULL AS BIGINT) AS ConsecutiveZeroHours, WastedCost, TotalHourlyCost FROM rollup_commitments
        UNION ALL
        SELECT 1, l.ResourceId, l.ProviderName, l.BillingAccountId, l.ServiceName, l.ResourceType,
               l.CommitmentDiscountStatus, l.HourlyTimestamp, 'Zero-Usage-' || r.ConsecutiveZeroHours || 'h',
               'Consecutive_Zero', r.ConsecutiveZeroHours, 0.0, l.TotalHourlyCost
        FROM runs r JOIN lasts l USING (ResourceId) WHERE r.ConsecutiveZeroHours >= 72))
SELECT ResourceId, ProviderName, ServiceName, ResourceType, UnusedReason, DetectionMethod, ConsecutiveZeroHours,
       round(WastedCost, 8) AS WastedCost, CommitmentDiscountStatus, round(TotalHourlyCost, 8) AS TotalHourlyCost
FROM ranked WHERE pick = 1""")
def _(charges):
    return rounded(plans.unused_report(charges), WastedCost=8, TotalHourlyCost=8)


@query("u10_free_charge_overview", using("charges") + """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE BilledCost > 0) AS billed_rows,
       count(*) FILTER (WHERE BilledCost = 0) AS free_rows,
       avg(ConsumedQuantity) FILTER (WHERE BilledCost = 0) AS quantity_mean,
       min(ConsumedQuantity) FILTER (WHERE BilledCost = 0) AS quantity_min,
       max(ConsumedQuantity) FILTER (WHERE BilledCost = 0) AS quantity_max,
       stddev_samp(ConsumedQuantity) FILTER (WHERE BilledCost = 0) AS quantity_std,
       count(*) FILTER (WHERE BilledCost = 0 AND ConsumedQuantity = 0) AS zero_quantity_rows,
       count(*) FILTER (WHERE BilledCost = 0 AND ConsumedQuantity > 0) AS used_quantity_rows,
       round(count(*) FILTER (WHERE BilledCost = 0) / count(*) * 100, 8) AS free_percent,
       quantile_cont(ConsumedQuantity, 0.5) FILTER (WHERE BilledCost = 0) AS quantity_median FROM charges""")
def _(charges):
    return rounded(unused.free_charge_overview(charges), free_percent=8)


@query("u10_free_charge_words", using("charges") + "\nUNION ALL ".join(
    f"SELECT '{w}' AS keyword, count(*) FILTER (WHERE contains(lower(ChargeDescription), '{w}')) AS matches "
    "FROM charges WHERE BilledCost = 0" for w in fixed.FREE_CHARGE_WORDS))
def _(charges):
    return unused.free_charge_words(charges)


@query("u10_free_charge_descriptions", using("charges") + """
SELECT ChargeDescription, count(*) AS Count,
       round(count(*) / (SELECT count(*) FROM charges WHERE BilledCost = 0) * 100, 8) AS Percent
FROM charges WHERE BilledCost = 0 GROUP BY 1 ORDER BY Count DESC, ChargeDescription LIMIT 20""")
def _(charges):
    from idlespan.operators.shares import top_values
    return rounded(top_values(charges.filter(F.col("BilledCost") == 0), "ChargeDescription", 20), Percent=8)


@query("u11_tagged_detections", using("commitments", "charges") + """
SELECT ResourceId, ChargePeriodStart, CloudProvider, PatternType, PotentialSavings, WastedCost FROM (
  SELECT ResourceId, ChargePeriodStart, ProviderName AS CloudProvider, 'OverProvisioning' AS PatternType,
         BilledCost * 0.6 AS PotentialSavings, NULL AS WastedCost
  FROM charges WHERE SimulatedCPUUsage < 0.3
  UNION ALL SELECT ResourceId, ChargePeriodStart, ProviderName, 'Unused', NULL, WastedCost FROM commitments)""")
def _(charges):
    low = unused.tag_detections(overprovisioned.low_usage_charges(charges), "OverProvisioning")
    idle = unused.tag_detections(unused.unused_commitments(charges), "Unused")
    return timegrid.merge_tables(low, idle).select(
        "ResourceId", "ChargePeriodStart", "CloudProvider", "PatternType", "PotentialSavings", "WastedCost")


@query("u12_cloud_patterns", using("unused_charges", "charges") + """
SELECT CloudProvider, PatternType, count(*) AS n, round(sum(savings), 2) AS savings, round(sum(waste), 2) AS waste
FROM (SELECT ProviderName AS CloudProvider, 'OverProvisioning' AS PatternType, BilledCost * 0.6 AS savings, NULL AS waste
      FROM charges WHERE SimulatedCPUUsage < 0.3
      UNION ALL SELECT ProviderName, 'Unused', NULL, WastedCost FROM unused_charges) GROUP BY ALL""")
def _(charges):
    found = plans.cloud_patterns(charges, over_provisioning=True)
    return rounded(found.groupBy("CloudProvider", "PatternType").agg(
        F.count(F.lit(1)).alias("n"), F.sum("PotentialSavings").alias("savings"),
        F.sum("WastedCost").alias("waste")), savings=2, waste=2)
