"""Model inputs from rollup rows.

Feature columns carry the prefix ``f_`` so that they can stand next to the row's
own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlespan import fixed_values as fixed
from idlespan.functions import numbers, text
from idlespan.operators.quantiles import exact_quantiles
from idlespan.operators.rollup import STRETCH, hours_of_stretches
from idlespan.schema import first_existing

REGRESSION_CATEGORIES = ("f_service", "f_type")
REGRESSION_NUMBERS = ("f_cost", "f_hour", "f_weekday")
CLASSIFIER_CATEGORIES = ("f_category", "f_type")
CLASSIFIER_NUMBERS = ("f_log_cost", "f_hour", "f_weekday")

_DEFAULT_HOUR, _DEFAULT_WEEKDAY = 12, 3


def _clock(df: DataFrame) -> dict[str, Column]:
    """Hour of day and weekday (Monday is 0) of the first time column, with defaults."""
    name = first_existing(df.columns, fixed.TIME_COLUMNS)
    if name is None:
        hour, weekday = F.lit(_DEFAULT_HOUR), F.lit(_DEFAULT_WEEKDAY)
    else:
        hour = F.coalesce(F.hour(name), F.lit(_DEFAULT_HOUR))
        weekday = F.coalesce(F.weekday(name), F.lit(_DEFAULT_WEEKDAY))
    return {"f_hour": hour.cast("double"), "f_weekday": weekday.cast("double")}


def _cost(df: DataFrame) -> Column:
    name = first_existing(df.columns, ("TotalHourlyCost", "BilledCost"))
    return F.coalesce(numbers.number(F.col(name)), F.lit(0.0)) if name else F.lit(0.0)


def regression_features(df: DataFrame) -> DataFrame:
    """Service, resource type, cost and clock; unknown names are 'Unknown'."""
    kind = F.col("ResourceType") if "ResourceType" in df.columns else F.lit(None).cast("string")
    return df.withColumns({
        "f_service": F.coalesce(F.col("ServiceName"), F.lit("Unknown")),
        "f_type": F.coalesce(kind, F.lit("Unknown")),
        "f_cost": _cost(df), **_clock(df)})


def boosting_features(df: DataFrame) -> DataFrame:
    """As ``regression_features``, but a missing type is 'Other' and a missing type
    column is derived from the service name."""
    service = F.coalesce(F.col("ServiceName"), F.lit("Unknown"))
    kind = (F.coalesce(F.col("ResourceType"), F.lit("Other")) if "ResourceType" in df.columns
            else text.boosting_resource_type(service))
    return df.withColumns({"f_service": service, "f_type": kind, "f_cost": _cost(df), **_clock(df)})


def classifier_features(df: DataFrame, digits: int | None = None, apart: bool = True) -> DataFrame:
    """Service category, resource type, log cost (rounded to ``digits``, if given) and clock.

    The same category rule serves training and scoring.  Of a table of stretches, names
    and costs are worked out once for equal hours, which are then told ``apart``, unless
    not wanted.
    """
    kind = (F.coalesce(F.col("ResourceType"), F.lit("Unknown")) if "ResourceType" in df.columns
            else text.classifier_resource_type(F.col("ServiceName")))
    log_cost = F.coalesce(F.log1p(_cost(df)), F.lit(0.0))
    same_each_hour = df.withColumns({
        "f_category": text.service_category_with_fallback(F.col("ServiceName")),
        "f_type": kind,
        "f_log_cost": log_cost if digits is None else F.round(log_cost, digits)})
    return (hours_of_stretches(same_each_hour) if apart else same_each_hour).withColumns(_clock(df))


def with_counted_hours(df: DataFrame) -> DataFrame:
    """A table of stretches in whose rows ``f_hour`` goes up by one each hour; any other table in hours.

    It does not where clocks may be put forward or back, or where another column tells the time.
    """
    if STRETCH in df.columns and (first_existing(df.columns, fixed.TIME_COLUMNS) != "HourlyTimestamp"
                                  or dict(df.dtypes)["HourlyTimestamp"] != "timestamp_ntz"):
        return hours_of_stretches(df)
    return df


def usage_columns(df: DataFrame) -> tuple[str, str]:
    cpu = first_existing(df.columns, fixed.CPU_COLUMNS)
    memory = first_existing(df.columns, fixed.MEMORY_COLUMNS)
    if cpu is None or memory is None:
        raise ValueError("no usage columns to learn from")
    return cpu, memory


def training_rows(df: DataFrame) -> DataFrame:
    """Rows with both usages in (0, 1], as ``cpu`` and ``memory`` next to the row."""
    cpu, memory = usage_columns(df)
    typed = df.withColumns({"cpu": numbers.number(F.col(cpu)), "memory": numbers.number(F.col(memory))})
    return typed.filter((F.col("cpu") > 0) & (F.col("cpu") <= 1)
                        & (F.col("memory") > 0) & (F.col("memory") <= 1))


def with_usage_classes(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """Add ``cpu_class`` and ``memory_class``: Low below the 25th percentile, High from
    the 75th, Medium between.  A row counts as often as ``weight``, or else ``copies``, says."""
    weight = weight or ("copies" if "copies" in rows.columns else None)
    for metric in ("cpu", "memory"):
        limits = exact_quantiles(rows, [], metric, {"low": 0.25, "high": 0.75}, weight)
        rows = rows.withColumn("_limits", limits.select(F.struct("low", "high")).scalar())
        rows = rows.withColumn(
            f"{metric}_class",
            F.when(F.col(metric) < F.col("_limits")["low"], "Low")
            .when(F.col(metric) < F.col("_limits")["high"], "Medium").otherwise("High"))
    return rows.drop("_limits")
