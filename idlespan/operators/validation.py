"""How well learned patterns predict held-out rows.

Rows are (service_name, cpu, memory).  Identical rows are kept once with their
number of copies, and every measure weighs by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlespan.functions import numbers
from idlespan.operators.quantiles import exact_quantiles
from idlespan.operators.sampling import hash_split, with_copies

_METRICS = ("cpu", "memory")
_ROW = ("service_name", "cpu", "memory")


def clean_for_validation(charges: DataFrame, service: str = "ServiceName",
                         cpu: str = "SimulatedCPUUsage",
                         memory: str = "SimulatedMemoryUsage") -> DataFrame:
    """Rows with service and both usages known and above 0, percent brought to fractions."""
    rows = charges.select(F.col(service).alias("service_name"),
                          numbers.number(F.col(cpu)).alias("cpu"),
                          numbers.number(F.col(memory)).alias("memory")).dropna()
    scales = rows.agg(F.struct(*[
        F.when(F.max(m) > 1.5, 100.0).otherwise(1.0).alias(m) for m in _METRICS])).scalar()
    scaled = rows.withColumn("_scale", scales).select(
        "service_name", *[(F.col(m) / F.col("_scale")[m]).alias(m) for m in _METRICS])
    return scaled.filter((F.col("cpu") > 0) & (F.col("memory") > 0))


def split_by_service(rows: DataFrame, by: Sequence[Column] | None = None,
                     test_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Split every service's rows; services with fewer than 5 rows go to train whole.

    Result: distinct rows with ``copies``, ``train_copies`` and ``test_copies``.
    """
    hashed = by if by is not None else [F.col(c) for c in _ROW]
    return hash_split(with_copies(rows, _ROW), by=hashed, strata=["service_name"],
                      train_fraction=1.0 - test_ratio, min_rows=5, seed=seed)


def part(split: DataFrame, name: str) -> DataFrame:
    """The 'train' or 'test' rows with their number of ``copies``."""
    count = F.col(f"{name}_copies")
    return split.filter(count > 0).select(*_ROW, count.alias("copies"))


def train_means(train: DataFrame) -> DataFrame:
    """Per service: sample count and mean of both usages; all the estimates need."""
    weight = F.col("copies")
    total = F.sum(weight)
    return train.groupBy("service_name").agg(
        total.alias("sample_count"),
        *[(F.sum(F.col(m) * weight) / total).alias(f"{m}_mean") for m in _METRICS])


def train_patterns(train: DataFrame) -> DataFrame:
    """Per service: sample count, mean, deviation and median of both usages."""
    weight = F.col("copies")
    means = train_means(train)
    squares = train.join(means, "service_name").groupBy("service_name").agg(*[
        F.sqrt(F.try_divide(
            F.sum(weight * (F.col(m) - F.col(f"{m}_mean")) ** 2),
            F.nullif(F.sum(weight) - 1, F.lit(0)))).alias(f"{m}_std") for m in _METRICS])
    long = train.select("service_name", "copies", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in _METRICS])))
    medians = exact_quantiles(long, ["service_name", "metric"], "value", {"median": 0.5}, weight="copies")
    medians = medians.groupBy("service_name").agg(*[
        F.max(F.when(F.col("metric") == m, F.col("median"))).alias(f"{m}_median") for m in _METRICS])
    joined = means.join(squares, "service_name", "left").join(medians, "service_name", "left")
    return joined.select("service_name", "sample_count", *[
        f"{m}_{s}" for m in _METRICS for s in ("mean", "std", "median")])


def _estimated(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows with the train mean of their service, else the mean of all services' means."""
    averages = patterns.agg(F.struct(*[
        F.avg(f"{m}_mean").alias(m) for m in _METRICS])).scalar()
    known = patterns.select("service_name", *[F.col(f"{m}_mean").alias(f"_{m}") for m in _METRICS],
                            F.lit(True).alias("_found"))
    joined = rows.join(known, "service_name", "left").withColumn("_average", averages)
    found = F.coalesce(F.col("_found"), F.lit(False))
    return joined.withColumns({
        **{f"estimated_{m}": F.when(found, F.col(f"_{m}")).otherwise(F.col("_average")[m])
           for m in _METRICS},
        "match_method": F.when(found, "exact_match").otherwise("global_average"),
    })


def compare_rows(test: DataFrame, patterns: DataFrame) -> DataFrame:
    """Actual and estimated usage of the test rows, with ``copies``."""
    return _estimated(test, patterns).select(
        F.col("cpu").alias("actual_cpu"), "estimated_cpu",
        F.col("memory").alias("actual_memory"), "estimated_memory", "match_method", "copies")


def compare_services(test: DataFrame, patterns: DataFrame) -> DataFrame:
    """Actual and estimated mean usage per service."""
    weight = F.col("copies")
    actual = test.groupBy("service_name").agg(*[
        (F.sum(F.col(m) * weight) / F.sum(weight)).alias(m) for m in _METRICS])
    return _estimated(actual, patterns).select(
        "service_name", F.col("cpu").alias("actual_cpu"), "estimated_cpu",
        F.col("memory").alias("actual_memory"), "estimated_memory", "match_method",
        F.lit(1).cast("bigint").alias("copies"))


def error_metrics(compared: DataFrame, min_actual: float | None = None) -> DataFrame:
    """Per metric: MAE, RMSE, R² and MAPE in percent, weighed by ``copies``.

    R² compares with the mean of the actual values and can be negative.  With
    ``min_actual`` the MAPE takes only larger actual values (0 if there are none).
    """
    long = compared.select("copies", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"actual_{m}").alias("a"),
                 F.col(f"estimated_{m}").alias("e")) for m in _METRICS])))
    return _measures(long, min_actual)


def _measures(long: DataFrame, min_actual: float | None = None) -> DataFrame:
    """Errors of (metric, a, e, copies) rows."""
    weight, gap = F.col("copies"), F.col("a") - F.col("e")
    counted = F.lit(True) if min_actual is None else F.col("a") > min_actual
    relative = F.when(counted, weight * F.abs(F.try_divide(gap, F.col("a"))))
    n = F.col("samples")
    return long.groupBy("metric").agg(
        F.sum(weight).alias("samples"),
        F.sum(weight * F.abs(gap)).alias("_abs"),
        F.sum(weight * gap * gap).alias("_sq"),
        F.sum(weight * F.col("a")).alias("_a"),
        F.sum(weight * F.col("a") * F.col("a")).alias("_aa"),
        F.sum(relative).alias("_rel"),
        F.sum(F.when(counted, weight)).alias("_rel_n"),
    ).select(
        "metric", "samples",
        (F.col("_abs") / n).alias("mae"),
        F.sqrt(F.col("_sq") / n).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.col("_sq"), F.col("_aa") - F.col("_a") * F.col("_a") / n)).alias("r2"),
        F.coalesce(F.try_divide(F.col("_rel"), F.col("_rel_n")) * 100.0, F.lit(0.0)).alias("mape"))


def error_by_method(compared: DataFrame) -> DataFrame:
    """MAE and number of rows per match method."""
    weight = F.col("copies")
    return compared.groupBy("match_method").agg(
        F.sum(weight).alias("samples"),
        *[(F.sum(weight * F.abs(F.col(f"actual_{m}") - F.col(f"estimated_{m}"))) / F.sum(weight))
          .alias(f"{m}_mae") for m in _METRICS])


def match_counts(compared: DataFrame) -> DataFrame:
    """One row: rows, matches by method and the exact-match ratio in percent."""
    exact = F.sum(F.when(F.col("match_method") == "exact_match", F.col("copies")).otherwise(0))
    return compared.agg(
        F.sum("copies").alias("total_samples"), exact.alias("exact_match_count"),
    ).withColumns({
        "global_average_count": F.col("total_samples") - F.col("exact_match_count"),
        "exact_match_ratio": numbers.share_percent(F.col("exact_match_count"), F.col("total_samples")),
    })


def most_accurate_services(services: DataFrame, n: int = 5) -> DataFrame:
    """Services whose mean CPU usage was estimated best."""
    return (
        services.withColumn("cpu_error", F.abs(F.col("actual_cpu") - F.col("estimated_cpu")))
        .select("service_name", "actual_cpu", "estimated_cpu", "cpu_error")
        .orderBy("cpu_error", "service_name").limit(n))


def report_summary(metrics: DataFrame, counts: DataFrame) -> DataFrame:
    """One row of headline figures in percent, with the mean over CPU and memory."""
    def of(metric: str, measure: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(measure)))

    parts = []
    for m in _METRICS:
        parts += [(of(m, "mae") * 100.0).alias(f"{m}_mae_percent"),
                  (of(m, "rmse") * 100.0).alias(f"{m}_rmse_percent"),
                  of(m, "r2").alias(f"{m}_r2")]
    ratio = counts.select(F.struct("total_samples", "exact_match_ratio")).scalar()
    return metrics.agg(*parts).withColumn("_c", ratio).select(
        F.col("_c")["total_samples"].alias("test_samples"),
        F.col("_c")["exact_match_ratio"].alias("exact_match_ratio"),
        *[f"{m}_{s}" for m in _METRICS for s in ("mae_percent", "rmse_percent", "r2")],
        ((F.col("cpu_mae_percent") + F.col("memory_mae_percent")) / 2).alias("avg_mae_percent"),
        ((F.col("cpu_r2") + F.col("memory_r2")) / 2).alias("avg_r2"))
