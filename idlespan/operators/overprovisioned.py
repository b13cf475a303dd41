"""Finding over-provisioned resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlespan import fixed_values as fixed
from idlespan.functions import numbers, text, times
from idlespan.operators.conversion import of_cloud, with_cloud
from idlespan.operators.quantiles import exact_quantiles
from idlespan.operators.rollup import LAYOUT, STRETCH, hours_each
from idlespan.operators.streaks import longest_runs
from idlespan.operators.timegrid import merge_tables
from idlespan.schema import find_column, require_columns


def low_usage_charges(charges: DataFrame, cpu_threshold: float = fixed.CPU_THRESHOLD,
                      memory_threshold: float | None = None) -> DataFrame:
    """Charges whose CPU usage is known and low.

    The CPU column is the first with 'cpu' and 'usage' in its name.  Memory is
    only looked at when ``memory_threshold`` is given.
    """
    cpu = find_column(charges.columns, "cpu", "usage")
    if cpu is None:
        raise ValueError("no CPU usage column")
    low = F.col(cpu) < cpu_threshold
    if memory_threshold is not None:
        low = low & (F.col(require_memory(charges)) < memory_threshold)
    found = charges.filter(F.col(cpu).isNotNull() & low)
    found = found.withColumn("WastePercentage", numbers.waste_percent(F.col(cpu)))
    if "BilledCost" in charges.columns:
        found = found.withColumn("PotentialSavings", F.col("BilledCost") * fixed.ROW_SAVINGS_RATE)
    return found


def require_memory(df: DataFrame) -> str:
    memory = find_column(df.columns, "memory", "usage")
    if memory is None:
        raise ValueError("no memory usage column")
    return memory


def low_usage_hours(hourly: DataFrame, cpu_threshold: float = fixed.CPU_THRESHOLD,
                    memory_threshold: float = fixed.MEMORY_THRESHOLD,
                    min_hours: int = fixed.MIN_STREAK_ROWS) -> DataFrame:
    """Resources by their total number of low hours (CPU or memory), most costly first; ``hourly`` may be a table of stretches."""
    require_columns(hourly, ("AvgCPUUsage", "AvgMemoryUsage"))
    span, time = hours_each(hourly), F.col("HourlyTimestamp")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * span), F.sum(F.when(F.col(c).isNotNull(), span)))
    low = (F.col("AvgCPUUsage") < cpu_threshold) | (F.col("AvgMemoryUsage") < memory_threshold)
    return (
        hourly.filter(low)
        .groupBy("ProviderName", "ResourceId", "ServiceName")
        .agg(F.sum(F.when(time.isNotNull(), span).otherwise(0)).alias("LowUsageHours"),
             numbers.sum_or_zero(F.col("HourlyCost") * span).alias("TotalWastedCost"),
             mean("AvgCPUUsage").alias("AvgCPU"),
             mean("AvgMemoryUsage").alias("AvgMemory"),
             F.min(time).alias("FirstLowUsage"),
             F.max(times.plus_hours(time, span - 1)).alias("LastLowUsage"))
        .filter(F.col("LowUsageHours") >= min_hours)
        .withColumns({"CPUWastePercent": numbers.waste_percent(F.col("AvgCPU")),
                      "MemoryWastePercent": numbers.waste_percent(F.col("AvgMemory"))})
        .orderBy(F.desc("TotalWastedCost"))
    )


def top_offenders(low_hours: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` resources with the highest wasted cost."""
    return low_hours.orderBy(F.desc("TotalWastedCost"), "ProviderName", "ResourceId",
                             "ServiceName").limit(n)


def low_hours_totals(low_hours: DataFrame) -> DataFrame:
    """One row: wasted cost of the week, extrapolated to month and year, mean usage."""
    wasted = F.col("TotalWastedCost")
    return low_hours.agg(
        F.count(F.lit(1)).alias("Resources"),
        numbers.sum_or_zero(F.col("TotalWastedCost")).alias("TotalWastedCost"),
        F.avg("AvgCPU").alias("MeanCPU"), F.avg("AvgMemory").alias("MeanMemory"),
    ).withColumns({"MonthlyCost": wasted * fixed.WEEKS_PER_MONTH,
                   "YearlyCost": wasted * float(fixed.WEEKS_PER_YEAR)})


def low_hours_by_provider(low_hours: DataFrame) -> DataFrame:
    """Resources, wasted cost and low hours per provider."""
    return low_hours.groupBy("ProviderName").agg(
        F.count(F.lit(1)).alias("Resources"),
        numbers.sum_or_zero(F.col("TotalWastedCost")).alias("TotalCost"),
        F.sum("LowUsageHours").alias("TotalHours"))


def gcp_low_streaks(rollup: DataFrame, cpu_threshold: float = fixed.CPU_THRESHOLD,
                    memory_threshold: float = fixed.MEMORY_THRESHOLD,
                    min_rows: int = fixed.MIN_STREAK_ROWS,
                    gap_aware: bool = False) -> DataFrame:
    """GCP compute resources with a long run of low CPU or low memory rows.

    Missing usage counts as 0, hence as low.  Cost and names come from the
    resource's last row; savings are a share of that row's cost.
    """
    require_columns(rollup, ("AvgCPUUsage", "AvgMemoryUsage"))
    rows = compute_rows(of_cloud(rollup, "GCP"))
    filled = {c: F.coalesce(numbers.number(F.col(c)), F.lit(0.0))
              for c in ("AvgCPUUsage", "AvgMemoryUsage")}
    found = _streaks(
        rows.withColumns(filled),
        F.col("AvgCPUUsage") < cpu_threshold, F.col("AvgMemoryUsage") < memory_threshold,
        min_rows, gap_aware, means=("AvgCPUUsage", "AvgMemoryUsage"))
    return _priced(found, "Direct_Consecutive", fixed.GCP_WASTE_RATIO).withColumns({
        "CPUValue": F.format_string("%.1f%%", F.col("mean_AvgCPUUsage") * 100.0),
        "MemoryValue": F.format_string("%.1f%%", F.col("mean_AvgMemoryUsage") * 100.0),
    }).withColumnsRenamed({"mean_AvgCPUUsage": "MeanCPU", "mean_AvgMemoryUsage": "MeanMemory"})


def aws_low_streaks(predicted: DataFrame, min_rows: int = fixed.MIN_STREAK_ROWS,
                    gap_aware: bool = False) -> DataFrame:
    """AWS compute resources with a long run of rows predicted 'Low'."""
    rows = compute_rows(of_cloud(predicted, "AWS"))
    found = _streaks(rows, F.col("PredictedCPUClass") == "Low",
                     F.col("PredictedMemoryClass") == "Low", min_rows, gap_aware)
    return _priced(found, "ML_Consecutive", fixed.AWS_WASTE_RATIO).withColumns(
        {"CPUValue": F.lit("Low (ML)"), "MemoryValue": F.lit("Low (ML)")})


def compute_rows(rollup: DataFrame) -> DataFrame:
    if "ProviderName" not in rollup.columns:
        return rollup
    return rollup.filter(text.is_compute_service(F.col("ServiceName")))


def _streaks(rows: DataFrame, cpu_low: Column, memory_low: Column, min_rows: int,
             gap_aware: bool, means: tuple[str, ...] = ()) -> DataFrame:
    kept = [c for c in rows.columns if c not in ("Cloud", "ResourceId", STRETCH, *LAYOUT, *means)]
    runs = longest_runs(
        rows,
        {"ConsecutiveCPUHours": F.coalesce(cpu_low, F.lit(False)),
         "ConsecutiveMemoryHours": F.coalesce(memory_low, F.lit(False))},
        means=means, keep_last=kept, gap_aware=gap_aware)
    status = {
        f"{metric}Status": F.when(F.col(f"Consecutive{metric}Hours") >= min_rows, "OverProvisioned")
        .otherwise("Normal") for metric in ("CPU", "Memory")}
    long_enough = (F.col("ConsecutiveCPUHours") >= min_rows) | (
        F.col("ConsecutiveMemoryHours") >= min_rows)
    return runs.filter(long_enough).withColumns(status)


def _priced(found: DataFrame, method: str, ratio: float) -> DataFrame:
    cost = F.coalesce(numbers.number(F.col("TotalHourlyCost")), F.lit(0.0))
    return found.withColumns({
        "DetectionMethod": F.lit(method),
        "TotalHourlyCost": cost,
        "WasteRatio": F.lit(ratio),
        "PotentialSavings": cost * ratio,
    })


def union_of_clouds(*detections: DataFrame) -> DataFrame:
    return merge_tables(*detections)


def detection_stats(rollup: DataFrame, detections: DataFrame) -> DataFrame:
    """Per cloud: compute rows examined, resources found, rate and savings."""
    examined = with_cloud(compute_rows(rollup)).groupBy("Cloud").agg(
        F.count(F.lit(1)).alias("Total"))
    found = with_cloud(detections).groupBy("Cloud").agg(
        F.count(F.lit(1)).alias("OverProvisioned"),
        numbers.sum_or_zero(F.col("PotentialSavings")).alias("HourlySavings"))
    savings = F.coalesce(F.col("HourlySavings"), F.lit(0.0))
    count = F.coalesce(F.col("OverProvisioned"), F.lit(0))
    return examined.join(found, "Cloud", "left").select(
        "Cloud", "Total", count.alias("OverProvisioned"),
        numbers.share_percent(count, F.col("Total")).alias("Percent"),
        savings.alias("HourlySavings"),
        (savings * 24 * 30).alias("MonthlySavings"),
        (savings * 24 * 365).alias("YearlySavings"))


def detection_stats_of_rollup(rollup: DataFrame, cpu_threshold: float = fixed.CPU_THRESHOLD,
                              memory_threshold: float = fixed.MEMORY_THRESHOLD,
                              min_rows: int = fixed.MIN_STREAK_ROWS) -> DataFrame:
    """``detection_stats`` of GCP streaks by usage and AWS streaks by predicted class, in one pass.

    ``rollup`` has ``PredictedCPUClass`` and ``PredictedMemoryClass``, which count for AWS
    rows only.  Rows are counted along with the runs.
    """
    rows = with_cloud(compute_rows(rollup))
    gcp = F.col("Cloud") == "GCP"

    def low(usage: str, predicted: str, threshold: float) -> Column:
        measured = F.coalesce(numbers.number(F.col(usage)), F.lit(0.0)) < threshold
        return F.when(gcp, measured).otherwise(F.coalesce(F.col(predicted) == "Low", F.lit(False)))

    runs = longest_runs(rows, {"_cpu": low("AvgCPUUsage", "PredictedCPUClass", cpu_threshold),
                               "_memory": low("AvgMemoryUsage", "PredictedMemoryClass", memory_threshold)},
                        keep_last=["TotalHourlyCost"], within=("Cloud",), carried={"_seen": (F.lit(True), F.max)})
    found = F.col("ResourceId").isNotNull() & ((F.col("_cpu") >= min_rows) | (F.col("_memory") >= min_rows))
    cost = F.coalesce(numbers.number(F.col("TotalHourlyCost")), F.lit(0.0))
    saved = cost * F.when(gcp, fixed.GCP_WASTE_RATIO).otherwise(fixed.AWS_WASTE_RATIO)
    sums = runs.groupBy("Cloud").agg(
        F.sum("RowCount").alias("Total"), F.count_if(found).alias("OverProvisioned"),
        F.coalesce(F.sum(F.when(found, saved)), F.lit(0.0)).alias("HourlySavings"))
    return sums.select("Cloud", "Total", "OverProvisioned",
                       numbers.share_percent(F.col("OverProvisioned"), F.col("Total")).alias("Percent"), "HourlySavings",
                       (F.col("HourlySavings") * 24 * 30).alias("MonthlySavings"),
                       (F.col("HourlySavings") * 24 * 365).alias("YearlySavings"))


def low_estimates(estimated: DataFrame, cpu_threshold: float = fixed.CPU_THRESHOLD,
                  memory_threshold: float = fixed.MEMORY_THRESHOLD) -> DataFrame:
    """Charges whose estimated CPU or memory is low, with waste and savings."""
    low = (F.col("cpu_mean") < cpu_threshold) | (F.col("memory_mean") < memory_threshold)
    found = estimated.filter(low).withColumns({
        "CPUWastePercent": numbers.waste_percent(F.col("cpu_mean")),
        "MemoryWastePercent": numbers.waste_percent(F.col("memory_mean"))})
    cost = next((c for c in ("BilledCost", "EffectiveCost") if c in estimated.columns), None)
    if cost:
        found = found.withColumn("PotentialSavings", F.col(cost) * fixed.ROW_SAVINGS_RATE)
    return found


def estimate_detection_summary(estimated: DataFrame, low: DataFrame) -> DataFrame:
    """One row: detection rate, means, methods, confidence bands and savings."""
    total = estimated.agg(F.count(F.lit(1))).scalar()
    confidence = F.col("confidence")
    return low.agg(
        F.count(F.lit(1)).alias("overprovisioned_count"),
        (F.avg("cpu_mean") * 100.0).alias("avg_cpu_usage"),
        (F.avg("memory_mean") * 100.0).alias("avg_memory_usage"),
        F.avg("CPUWastePercent").alias("avg_cpu_waste"),
        F.avg("MemoryWastePercent").alias("avg_memory_waste"),
        F.avg("confidence").alias("avg_confidence"),
        F.count_if(F.col("method") == "exact_match").alias("exact_match_count"),
        F.count_if(F.col("method") == "global_average").alias("global_avg_count"),
        F.count_if(confidence >= 0.8).alias("high_confidence"),
        F.count_if((confidence >= 0.5) & (confidence < 0.8)).alias("medium_confidence"),
        F.count_if(confidence < 0.5).alias("low_confidence"),
        numbers.sum_or_zero(F.col("PotentialSavings")).alias("total_potential_savings"),
    ).withColumns({
        "total_records": total,
        "yearly_savings": F.col("total_potential_savings") * 12.0,
    }).withColumn("detection_rate", numbers.share_percent(
        F.col("overprovisioned_count"), F.col("total_records")))


def flag_predictions(predicted: DataFrame, cpu_threshold: float = fixed.CPU_THRESHOLD,
                     memory_threshold: float = fixed.MEMORY_THRESHOLD) -> DataFrame:
    """Mark rows whose predicted CPU or memory is low; savings only for marked rows."""
    cost = "TotalHourlyCost" if "TotalHourlyCost" in predicted.columns else "BilledCost"
    low = (F.col("PredictedCPU") < cpu_threshold) | (F.col("PredictedMemory") < memory_threshold)
    price = F.coalesce(numbers.number(F.col(cost)), F.lit(0.0)) * fixed.ROW_SAVINGS_RATE
    return predicted.withColumns({
        "IsOverProvisioned": low,
        "CPUWastePercent": numbers.waste_percent(F.col("PredictedCPU")),
        "MemoryWastePercent": numbers.waste_percent(F.col("PredictedMemory")),
        "PotentialSavings": F.when(low, price).otherwise(F.lit(0.0)),
    })


def flag_classes(predicted: DataFrame) -> DataFrame:
    """Mark rows where either predicted class is 'Low'."""
    return predicted.withColumn(
        "IsOverProvisioned",
        (F.col("PredictedCPUClass") == "Low") | (F.col("PredictedMemoryClass") == "Low"))


def prediction_summary(flagged: DataFrame, cpu_threshold: float = fixed.CPU_THRESHOLD,
                       memory_threshold: float = fixed.MEMORY_THRESHOLD) -> DataFrame:
    """One row: flagged share, distribution of the predictions, rows below the thresholds."""
    medians = {
        f"{metric}_median": exact_quantiles(flagged, [], column, {"m": 0.5}).scalar()
        for metric, column in (("cpu", "PredictedCPU"), ("memory", "PredictedMemory"))}
    aggregates = [F.count(F.lit(1)).alias("total"),
                  F.count_if("IsOverProvisioned").alias("over_provisioned"),
                  F.count_if(F.col("PredictedCPU") < cpu_threshold).alias("cpu_below"),
                  F.count_if(F.col("PredictedMemory") < memory_threshold).alias("memory_below"),
                  numbers.sum_or_zero(F.col("PotentialSavings")).alias("total_savings")]
    for metric, column in (("cpu", "PredictedCPU"), ("memory", "PredictedMemory")):
        aggregates += [F.avg(column).alias(f"{metric}_mean"),
                       F.min(column).alias(f"{metric}_min"),
                       F.max(column).alias(f"{metric}_max")]
    return flagged.agg(*aggregates).withColumns({
        "over_provisioned_percent": numbers.share_percent(F.col("over_provisioned"), F.col("total")),
        "yearly_savings": F.col("total_savings") * 12.0,
        **medians,
    })
