"""Closing summaries and the tables behind the charts (A8-A11 and R operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.learning import estimates_of, patterns_of
from catalog.registry import query, rounded
from catalog.sql import add, using
from idlespan.operators import learning, overprovisioned, reports, shares, timegrid, unused
from idlespan.operators.conversion import charges_of_provider

add("both_rules", ("commitments", "zero_charges"),
    "SELECT * FROM commitments UNION ALL SELECT * FROM zero_charges")
add("detections", ("commitments", "charges"), """
SELECT ProviderName AS CloudProvider, 'OverProvisioning' AS PatternType, BilledCost * 0.6 AS PotentialSavings,
       NULL AS WastedCost FROM charges WHERE SimulatedCPUUsage < 0.3
UNION ALL SELECT ProviderName, 'Unused', NULL, WastedCost FROM commitments""")


def both_rules(charges):
    return timegrid.merge_tables(unused.unused_commitments(charges), unused.zero_usage_charges(charges))


def detections(charges):
    return timegrid.merge_tables(
        unused.tag_detections(overprovisioned.low_usage_charges(charges), "OverProvisioning"),
        unused.tag_detections(unused.unused_commitments(charges), "Unused"))


@query("a9_pattern_crosstab", using("detections") + """
SELECT coalesce(CloudProvider, 'All') AS CloudProvider,
       count(*) FILTER (WHERE PatternType = 'OverProvisioning') AS OverProvisioning,
       count(*) FILTER (WHERE PatternType = 'Unused') AS Unused, count(*) AS "All"
FROM detections GROUP BY ROLLUP (CloudProvider)""")
def _(charges):
    return reports.pattern_crosstab(detections(charges))


@query("a10_savings_by_pattern", using("detections") + """
SELECT CloudProvider, PatternType, count(*) AS Findings, round(coalesce(sum(PotentialSavings), 0), 2) AS Savings,
       round(coalesce(sum(WastedCost), 0), 2) AS Waste FROM detections GROUP BY ALL""")
def _(charges):
    return rounded(reports.savings_by_pattern(detections(charges)), Savings=2, Waste=2)


@query("a11_return_on_investment", using("detections") + """
, sums AS (SELECT count(*) FILTER (WHERE PatternType = 'OverProvisioning') AS o, sum(PotentialSavings) AS s,
                  count(*) FILTER (WHERE PatternType = 'Unused') AS u, sum(WastedCost) AS w FROM detections)
SELECT o AS OverProvisioned, round(s, 2) AS OverProvisionedSavings, u AS Unused, round(w, 2) AS UnusedWaste,
       round(s + w, 2) AS TotalSavings, round((s + w) * 12, 1) AS YearlySavings, round(s + w - 150, 2) AS NetSavings,
       round((s + w - 150) / 150 * 100, 1) AS RoiPercent, round((s + w - 150) * 0.75, 2) AS Reinvestable FROM sums""")
def _(charges):
    result = reports.return_on_investment(
        overprovisioned.low_usage_charges(charges), unused.unused_commitments(charges))
    return rounded(result, OverProvisionedSavings=2, UnusedWaste=2, TotalSavings=2, YearlySavings=1, NetSavings=2,
                   RoiPercent=1, Reinvestable=2)


@query("a8_top_values", using("charges") + """
SELECT ResourceId, count(*) AS Count, round(count(*) / (SELECT count(*) FROM charges) * 100, 8) AS Percent
FROM charges GROUP BY 1 ORDER BY Count DESC, ResourceId LIMIT 20""")
def _(charges):
    return rounded(shares.top_values(charges, "ResourceId", 20), Percent=8)


@query("r1_reasons", using("unused_charges") + """
SELECT UnusedReason, count(ResourceId) AS Count, round(sum(WastedCost), 2) AS Cost,
       round(count(ResourceId) / sum(count(ResourceId)) OVER () * 100, 8) AS CountPercent,
       round(CASE WHEN sum(sum(WastedCost)) OVER () > 0
         THEN sum(WastedCost) / sum(sum(WastedCost)) OVER () * 100 ELSE 0 END, 8) AS CostPercent
FROM unused_charges GROUP BY 1""")
def _(charges):
    return rounded(reports.reason_distribution(unused.unused_charges(charges)), Cost=2, CountPercent=8, CostPercent=8)


@query("r2_top_services_and_others", using("both_rules") + """
, per_service AS (SELECT ServiceName, count(ResourceId) AS n, sum(WastedCost) AS c,
                         row_number() OVER (ORDER BY count(ResourceId) DESC, ServiceName) AS place
                  FROM both_rules WHERE ServiceName IS NOT NULL GROUP BY 1)
SELECT CASE WHEN place <= 3 THEN ServiceName ELSE 'Others' END AS Service, CAST(sum(n) AS BIGINT) AS Count,
       round(sum(c), 2) AS Cost FROM per_service GROUP BY 1""")
def _(charges):
    return rounded(reports.top_services_and_others(both_rules(charges), 3), Cost=2)


@query("r3_resource_types", using("both_rules") + """
SELECT ResourceType, count(*) AS Count, round(count(*) / sum(count(*)) OVER () * 100, 8) AS Percent
FROM both_rules GROUP BY 1""")
def _(charges):
    return rounded(shares.value_counts(both_rules(charges), "ResourceType"), Percent=8)


def _bins(value: str, source: str, bins: int) -> str:
    return f"""
, limits AS (SELECT min({value}) AS low, max({value}) AS high FROM {source})
SELECT CAST(least(floor(({value} - low) / ((high - low) / {bins}.0)), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
FROM {source}, limits WHERE {value} IS NOT NULL GROUP BY 1"""


add("wasted", ("commitments",), "SELECT * FROM commitments WHERE WastedCost > 0")


@query("r4_cost_box_statistics", using("wasted") + """
SELECT count(*) AS n, round(avg(WastedCost), 4) AS mean, min(WastedCost) AS min, max(WastedCost) AS max,
       round(quantile_cont(WastedCost, 0.25), 6) AS q25, round(quantile_cont(WastedCost, 0.5), 6) AS median,
       round(quantile_cont(WastedCost, 0.75), 6) AS q75 FROM wasted""")
def _(charges):
    costs = reports.commitment_costs(unused.unused_commitments(charges))
    return rounded(reports.box_statistics(costs, "WastedCost"), mean=4, q25=6, median=6, q75=6)


@query("r4_cost_histogram", using("wasted") + _bins("WastedCost", "wasted", 30))
def _(charges):
    return reports.histogram(reports.commitment_costs(unused.unused_commitments(charges)), "WastedCost", 30)


@query("r5_cloud_comparison", using("both_rules") + """
SELECT ProviderName, count(ResourceId) AS Count, round(sum(WastedCost), 2) AS TotalCost,
       round(sum(WastedCost) / count(ResourceId), 4) AS AvgCost FROM both_rules GROUP BY 1""")
def _(charges):
    return rounded(reports.cloud_comparison(both_rules(charges)), TotalCost=2, AvgCost=4)


@query("r6_match_methods", using("estimates") + """
SELECT method, count(*) AS Count, round(count(*) / sum(count(*)) OVER () * 100, 8) AS Percent
FROM estimates GROUP BY 1""")
def _(charges):
    return rounded(shares.value_counts(estimates_of(charges), "method"), Percent=8)


@query("r6_confidence_bands", using("estimates") + """
SELECT CASE WHEN confidence <= 0.3 THEN 'Low' WHEN confidence <= 0.5 THEN 'Medium'
            WHEN confidence <= 0.8 THEN 'High' ELSE 'Very High' END AS band, count(*) AS n FROM estimates GROUP BY 1""")
def _(charges):
    return reports.confidence_bands(estimates_of(charges))


@query("r7_usage_histogram", using("usage") + _bins("cpu", "usage", 20))
def _(charges):
    return reports.histogram(learning.clean_usage(charges), "cpu", 20)


@query("r7_usage_points", using("estimates") + """
SELECT aws_service, round(cpu_mean * 100, 6) AS cpu_percent, round(memory_mean * 100, 6) AS memory_percent, confidence
FROM estimates""")
def _(charges):
    return rounded(reports.usage_points(estimates_of(charges)), cpu_percent=6, memory_percent=6)


def _low(charges):
    aws = charges_of_provider(charges)
    estimated = learning.attach_estimates(aws, estimates_of(charges))
    return aws, overprovisioned.low_estimates(estimated)


@query("r8_detected_and_normal", using("low_estimates") + """
SELECT 'Over-Provisioned' AS status, (SELECT count(*) FROM low_estimates) AS n
UNION ALL SELECT 'Normal', (SELECT count(*) FROM aws_charges) - (SELECT count(*) FROM low_estimates)""")
def _(charges):
    total, low = _low(charges)
    return reports.detected_and_normal(total, low)


@query("r8_detected_services", using("low_estimates") + """
SELECT ServiceName, count(*) AS Count, round(count(*) / (SELECT count(*) FROM low_estimates) * 100, 8) AS Percent
FROM low_estimates GROUP BY 1 ORDER BY Count DESC, ServiceName LIMIT 10""")
def _(charges):
    return rounded(shares.top_values(_low(charges)[1], "ServiceName", 10), Percent=8)


@query("r8_detected_by_method", using("low_estimates") + """
SELECT method, count(*) AS Count, round(count(*) / sum(count(*)) OVER () * 100, 8) AS Percent
FROM low_estimates GROUP BY 1""")
def _(charges):
    return rounded(shares.value_counts(_low(charges)[1], "method"), Percent=8)


@query("r9_top_cpu_services", using("patterns") + """
SELECT service_name, round(cpu_mean * 100, 6) AS mean_percent FROM patterns ORDER BY cpu_mean DESC, service_name LIMIT 15""")
def _(charges):
    return rounded(reports.top_usage_services(patterns_of(charges), "cpu"), mean_percent=6)


@query("r9_top_memory_services", using("patterns") + """
SELECT service_name, round(memory_mean * 100, 6) AS mean_percent FROM patterns ORDER BY memory_mean DESC, service_name LIMIT 15""")
def _(charges):
    return rounded(reports.top_usage_services(patterns_of(charges), "memory"), mean_percent=6)
