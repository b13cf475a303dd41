"""SQL pieces the reference queries are put together from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from catalog.charges import CHARGES_SQL
from idlespan import fixed_values as fixed


def contains_any(column: str, words: Sequence[str]) -> str:
    hits = " OR ".join(f"contains(lower({column}), '{w}')" for w in words)
    return f"coalesce({hits}, false)"


def label(column: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN {contains_any(column, words)} THEN '{name}'" for name, words in rules)
    return f"CASE {whens} ELSE '{default}' END"


IS_GCP = contains_any("ProviderName", fixed.CLOUD_WORDS["GCP"])
IS_AWS = contains_any("ProviderName", fixed.CLOUD_WORDS["AWS"])
IS_COMPUTE = contains_any("ServiceName", fixed.COMPUTE_WORDS)

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "charges": ((), CHARGES_SQL),
    "raw": (("charges",), """
SELECT ResourceId AS "Resource ID", ServiceName AS "Service Name", ConsumedQuantity AS "Usage Quantity",
       ConsumedUnit AS "Usage Unit", Region AS "Region / Zone",
       SimulatedCPUUsage * 100 AS cpu_percent, SimulatedMemoryUsage * 100 AS memory_percent,
       ConsumedQuantity * 1024 AS inbound, ConsumedQuantity * 2048 AS outbound,
       ChargePeriodStart, ChargePeriodEnd, EffectiveCost AS unrounded, BilledCost AS rounded
FROM charges WHERE ProviderName = 'GCP'"""),
    "timed": (("charges",), """
SELECT *, CAST(floor(greatest(date_sub('second', ChargePeriodStart, ChargePeriodEnd) / 3600.0, 1)) AS BIGINT)
          AS OriginalDurationHours FROM charges"""),
    "expanded": (("timed",), """
SELECT *, BilledCost / OriginalDurationHours AS HourlyCost, ChargePeriodStart + to_hours(i) AS HourlyTimestamp
FROM (SELECT *, unnest(range(OriginalDurationHours)) AS i FROM timed)"""),
    "rollup": (("expanded",), """
SELECT ProviderName, BillingAccountId, ResourceId, HourlyTimestamp, ServiceName, ResourceType,
       CommitmentDiscountStatus, coalesce(sum(HourlyCost), 0) AS TotalHourlyCost, count(*) AS RecordCount,
       avg(SimulatedCPUUsage) AS AvgCPUUsage, avg(SimulatedMemoryUsage) AS AvgMemoryUsage,
       coalesce(sum(EffectiveCost), 0) AS TotalEffectiveCost, coalesce(sum(BilledCost), 0) AS TotalBilledCost,
       coalesce(sum(ConsumedQuantity), 0) AS TotalConsumedQuantity
FROM expanded GROUP BY ALL"""),
    "hourly": (("rollup",), """
SELECT HourlyTimestamp, ProviderName, ResourceId, ServiceName,
       coalesce(sum(TotalHourlyCost), 0) AS HourlyCost, count(ResourceId) AS RecordCount,
       avg(AvgCPUUsage) AS AvgCPUUsage, avg(AvgMemoryUsage) AS AvgMemoryUsage,
       coalesce(sum(TotalConsumedQuantity), 0) AS TotalConsumedQuantity
FROM rollup GROUP BY ALL"""),
    "low_hours": (("hourly",), """
SELECT ProviderName, ResourceId, ServiceName, count(HourlyTimestamp) AS LowUsageHours,
       coalesce(sum(HourlyCost), 0) AS TotalWastedCost, avg(AvgCPUUsage) AS AvgCPU,
       avg(AvgMemoryUsage) AS AvgMemory, min(HourlyTimestamp) AS FirstLowUsage,
       max(HourlyTimestamp) AS LastLowUsage
FROM hourly WHERE AvgCPUUsage < 0.3 OR AvgMemoryUsage < 0.3
GROUP BY ALL HAVING count(HourlyTimestamp) >= 24"""),
    "gcp_compute": (("rollup",), f"""
SELECT * REPLACE (coalesce(AvgCPUUsage, 0) AS AvgCPUUsage, coalesce(AvgMemoryUsage, 0) AS AvgMemoryUsage)
FROM rollup WHERE {IS_COMPUTE} AND {IS_GCP} AND ResourceId IS NOT NULL"""),
    "commitments": (("charges",), """
SELECT *, 'Commitment-Unused' AS UnusedReason, EffectiveCost AS WastedCost
FROM charges WHERE lower(CommitmentDiscountStatus) = 'unused'"""),
    "zero_charges": (("charges",), """
SELECT *, 'Zero-Cost-Zero-Usage' AS UnusedReason, CAST(0 AS DOUBLE) AS WastedCost
FROM charges WHERE ConsumedQuantity = 0"""),
    "unused_charges": (("commitments", "zero_charges"), """
SELECT * EXCLUDE (p, pick) FROM (
  SELECT *, row_number() OVER (PARTITION BY ResourceId ORDER BY p, ChargePeriodStart, ChargePeriodEnd,
    coalesce(ProviderName, ''), coalesce(BillingAccountId, ''), coalesce(ServiceName, ''),
    coalesce(ResourceType, ''), coalesce(CommitmentDiscountStatus, ''),
    coalesce(CommitmentDiscountType, ''), coalesce(Region, ''), BilledCost, EffectiveCost,
    ConsumedQuantity, PublisherName, InvoiceIssuerName, ConsumedUnit, ChargeDescription,
    SimulatedCPUUsage NULLS FIRST, SimulatedMemoryUsage NULLS FIRST) AS pick
  FROM (SELECT 0 AS p, * FROM commitments UNION ALL SELECT 1 AS p, * FROM zero_charges))
WHERE pick = 1"""),
    "rollup_commitments": (("rollup",), """
SELECT *, 'Commitment-Unused' AS UnusedReason, 'CommitmentStatus' AS DetectionMethod,
       TotalHourlyCost AS WastedCost
FROM rollup WHERE lower(CommitmentDiscountStatus) = 'unused'"""),
    "usage": (("charges",), """
SELECT ServiceName AS service_name, SimulatedCPUUsage / (CASE WHEN (SELECT max(SimulatedCPUUsage) FROM charges) > 1.5
         THEN 100.0 ELSE 1.0 END) AS cpu,
       SimulatedMemoryUsage / (CASE WHEN (SELECT max(SimulatedMemoryUsage) FROM charges
         WHERE SimulatedCPUUsage > 0 AND SimulatedCPUUsage <= 1) > 1.5 THEN 100.0 ELSE 1.0 END) AS memory
FROM charges
WHERE SimulatedCPUUsage > 0 AND SimulatedCPUUsage <= 1
  AND SimulatedMemoryUsage > 0 AND SimulatedMemoryUsage <= 1"""),
    "patterns": (("usage",), "SELECT service_name, count(*) AS sample_count, " + ", ".join(
        f"avg({m}) AS {m}_mean, quantile_cont({m}, 0.5) AS {m}_median, stddev_samp({m}) AS {m}_std, "
        f"min({m}) AS {m}_min, max({m}) AS {m}_max, quantile_cont({m}, 0.25) AS {m}_q25, "
        f"quantile_cont({m}, 0.5) AS {m}_q50, quantile_cont({m}, 0.75) AS {m}_q75"
        for m in ("cpu", "memory")) + " FROM usage WHERE service_name IS NOT NULL GROUP BY service_name"),
    "average": (("patterns",), "SELECT " + ", ".join(
        f"avg({m}_mean) AS {m}_mean, avg({m}_std) AS {m}_std, median({m}_mean) AS {m}_median, "
        f"min({m}_mean) AS {m}_min, max({m}_mean) AS {m}_max" for m in ("cpu", "memory")) + " FROM patterns"),
    "mapping": ((), "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{a}', '{g}')" for i, (a, g) in enumerate(fixed.SERVICE_MAPPING))
        + ") AS m(ord, aws_key, gcp_service)"),
    "matched": (("charges", "mapping"), """
SELECT s.aws_service, arg_min(m.gcp_service, CASE WHEN m.aws_key = s.aws_service THEN -1 ELSE m.ord END) AS target
FROM (SELECT DISTINCT ServiceName AS aws_service FROM charges) s
LEFT JOIN mapping m ON m.aws_key = s.aws_service
  OR contains(lower(s.aws_service), lower(m.aws_key)) OR contains(lower(m.aws_key), lower(s.aws_service))
GROUP BY 1"""),
    "estimates": (("matched", "patterns", "average"), """
SELECT aws_service, CASE WHEN p.service_name IS NOT NULL THEN target ELSE 'Global Average' END AS matched_gcp_service,
       CASE WHEN p.service_name IS NOT NULL THEN 'exact_match' ELSE 'global_average' END AS method,
       CAST(CASE WHEN p.service_name IS NOT NULL THEN 1.0 ELSE 0.3 END AS DOUBLE) AS confidence, """ + ", ".join(
        f"CASE WHEN p.service_name IS NOT NULL THEN p.{m}_{s} ELSE a.{m}_{s} END AS {m}_{s}"
        for m in ("cpu", "memory") for s in ("mean", "std", "median", "min", "max")) + """
FROM matched LEFT JOIN patterns p ON p.service_name = target CROSS JOIN average a"""),
    "aws_charges": (("charges",), "SELECT * FROM charges WHERE ProviderName = 'AWS'"),
    "estimated": (("aws_charges", "estimates"), """
SELECT c.*, e.* FROM aws_charges c LEFT JOIN estimates e ON c.ServiceName = e.aws_service"""),
    "low_estimates": (("estimated",), """
SELECT *, (1 - cpu_mean) * 100 AS CPUWastePercent, (1 - memory_mean) * 100 AS MemoryWastePercent,
       BilledCost * 0.6 AS PotentialSavings
FROM estimated WHERE cpu_mean < T OR memory_mean < T"""),
}


def add(name: str, needs: Sequence[str], text: str) -> None:
    _CTES[name] = (tuple(needs), text)


def using(*names: str, extra: Mapping[str, str] | None = None, threshold: float = 0.3) -> str:
    """A WITH clause of the named pieces and what they need, plus own ones."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _CTES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({_CTES[n][1]})".replace(" < T", f" < {threshold}") for n in order]
    parts += [f"{n} AS ({text})" for n, text in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"


_TIME_ORDER = ("HourlyTimestamp, coalesce(BillingAccountId, ''), coalesce(ServiceName, ''), "
               "coalesce(ResourceType, ''), coalesce(CommitmentDiscountStatus, ''), TotalHourlyCost")


def streaks(source: str, flags: Mapping[str, str], gap_aware: bool = False) -> dict[str, str]:
    """CTEs: ``marked`` rows, ``runs`` (longest run of each flag), ``lasts`` (last rows)."""
    gap = ("rn > 1 AND HourlyTimestamp <> previous + INTERVAL 1 HOUR" if gap_aware else "false")
    groups = ", ".join(
        f"sum(CASE WHEN NOT ({f}) OR ({gap}) THEN 1 ELSE 0 END) OVER w AS g_{n}" for n, f in flags.items())
    marked = f"""
SELECT *, {groups} FROM (
  SELECT *, row_number() OVER o AS rn, lag(HourlyTimestamp) OVER o AS previous FROM {source}
  WHERE ResourceId IS NOT NULL
  WINDOW o AS (PARTITION BY ResourceId ORDER BY {_TIME_ORDER}))
WINDOW w AS (PARTITION BY ResourceId ORDER BY rn ROWS UNBOUNDED PRECEDING)"""
    singles = [f"""SELECT ResourceId, max(n) AS {n} FROM (
  SELECT ResourceId, count(*) FILTER (WHERE {f}) AS n FROM marked GROUP BY ResourceId, g_{n}) GROUP BY 1"""
               for n, f in flags.items()]
    joined = f"SELECT * FROM ({singles[0]})"
    for single in singles[1:]:
        joined += f" JOIN ({single}) USING (ResourceId)"
    return {"marked": marked, "runs": joined,
            "lasts": "SELECT * FROM marked QUALIFY rn = max(rn) OVER (PARTITION BY ResourceId)"}
