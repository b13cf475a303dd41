"""Table layouts used by the library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_STRING = T.StringType()
_DOUBLE = T.DoubleType()
_NTZ = T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


RAW_GCP_BILLING = T.StructType([
    T.StructField("Resource ID", _STRING),
    T.StructField("Service Name", _STRING),
    T.StructField("Usage Quantity", _DOUBLE),
    T.StructField("Usage Unit", _STRING),
    T.StructField("Region / Zone", _STRING),
    T.StructField("CPU Utilization (%)", _DOUBLE),
    T.StructField("Memory Utilization (%)", _DOUBLE),
    T.StructField("Network Inbound Data (Bytes)", _DOUBLE),
    T.StructField("Network Outbound Data (Bytes)", _DOUBLE),
    T.StructField("Usage Start Date", _NTZ),
    T.StructField("Usage End Date", _NTZ),
    T.StructField("Cost per Quantity ($)", _DOUBLE),
    T.StructField("Unrounded Cost ($)", _DOUBLE),
    T.StructField("Rounded Cost ($)", _DOUBLE),
])

CHARGES = _table(
    ChargePeriodStart=_NTZ, ChargePeriodEnd=_NTZ,
    BilledCost=_DOUBLE, EffectiveCost=_DOUBLE, ConsumedQuantity=_DOUBLE,
    ProviderName=_STRING, PublisherName=_STRING, InvoiceIssuerName=_STRING,
    BillingAccountId=_STRING, ServiceName=_STRING, ResourceId=_STRING,
    ResourceType=_STRING, Region=_STRING, ConsumedUnit=_STRING, ChargeDescription=_STRING,
    CommitmentDiscountStatus=_STRING, CommitmentDiscountType=_STRING,
    SimulatedCPUUsage=_DOUBLE, SimulatedMemoryUsage=_DOUBLE,
    NetworkInboundBytes=_DOUBLE, NetworkOutboundBytes=_DOUBLE,
    UnroundedCost=_DOUBLE, CostPerQuantity=_DOUBLE,
)

_USAGE_STATS = _table(mean=_DOUBLE, median=_DOUBLE, std=_DOUBLE, min=_DOUBLE, max=_DOUBLE,
                      q25=_DOUBLE, q50=_DOUBLE, q75=_DOUBLE)

SERVICE_PATTERNS = T.StructType([
    T.StructField("service_name", _STRING),
    T.StructField("sample_count", T.LongType()),
    T.StructField("cpu", _USAGE_STATS),
    T.StructField("memory", _USAGE_STATS),
])

CHARGE_PERIOD_COLUMNS = ("ChargePeriodStart", "ChargePeriodEnd")
ROLLUP_INPUT_COLUMNS = ("ResourceId", "HourlyTimestamp", "HourlyCost", "ServiceName",
                        "BillingAccountId")

OVERPROVISIONED_COLUMNS = (
    "ResourceId", "ProviderName", "ServiceName", "ResourceType", "DetectionMethod",
    "CPUStatus", "MemoryStatus", "CPUValue", "MemoryValue", "TotalHourlyCost",
    "WasteRatio", "PotentialSavings",
)
UNUSED_COLUMNS = (
    "ResourceId", "ProviderName", "ServiceName", "ResourceType", "UnusedReason",
    "DetectionMethod", "ConsecutiveZeroHours", "WastedCost", "CommitmentDiscountStatus",
    "TotalHourlyCost",
)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise before any job runs if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def keep_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Project onto those of ``columns`` that exist, in the given order."""
    return df.select(*[c for c in columns if c in df.columns])


def first_existing(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate present in ``columns``."""
    return next((c for c in candidates if c in columns), None)


def find_column(columns: Sequence[str], *words: str) -> str | None:
    """The first column whose name contains every word, ignoring case."""
    return next(
        (c for c in columns if all(w.lower() in c.lower() for w in words)), None)


def find_usage_columns(columns: Sequence[str]) -> tuple[str | None, str | None]:
    """First CPU and first memory column that is a usage or utilization column."""
    def pick(resource: str) -> str | None:
        return next(
            (c for c in columns if resource in c.lower()
             and ("usage" in c.lower() or "utilization" in c.lower())), None)

    return pick("cpu"), pick("memory")
