"""The tables behind the charts and the closing summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlespan import fixed_values as fixed
from idlespan.functions import numbers
from idlespan.operators.quantiles import exact_quantiles
from idlespan.operators.shares import count_and_waste


def pattern_crosstab(detections: DataFrame, patterns: tuple[str, ...] = ("OverProvisioning", "Unused"),
                     ) -> DataFrame:
    """Findings by cloud and pattern with totals ('All') on both sides."""
    counted = detections.filter(
        F.col("CloudProvider").isNotNull() & F.col("PatternType").isNotNull()
    ).cube("CloudProvider", "PatternType").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    cloud = F.when(F.col("_g") >= 2, "All").otherwise(F.col("CloudProvider"))
    pattern = F.when(F.col("_g") % 2 == 1, "All").otherwise(F.col("PatternType"))
    return (
        counted.select(cloud.alias("CloudProvider"), pattern.alias("PatternType"), "n")
        .groupBy("CloudProvider").pivot("PatternType", [*patterns, "All"]).sum("n").na.fill(0))


def savings_by_pattern(detections: DataFrame) -> DataFrame:
    """Possible savings and waste per cloud and pattern."""
    measures = [numbers.sum_or_zero(F.col(c)).alias(out) for c, out in (
        ("PotentialSavings", "Savings"), ("WastedCost", "Waste")) if c in detections.columns]
    return detections.groupBy("CloudProvider", "PatternType").agg(
        F.count(F.lit(1)).alias("Findings"), *measures)


def return_on_investment(over_provisioned: DataFrame, unused: DataFrame,
                         system_cost: float = fixed.SYSTEM_COST_PER_MONTH) -> DataFrame:
    """One row: monthly savings, the year's, and what remains after the system's own cost."""
    waste = unused.agg(F.struct(
        F.count(F.lit(1)).alias("n"), numbers.sum_or_zero(F.col("WastedCost")).alias("cost"))).scalar()
    total = F.col("TotalSavings")
    return over_provisioned.agg(
        F.count(F.lit(1)).alias("OverProvisioned"),
        numbers.sum_or_zero(F.col("PotentialSavings")).alias("OverProvisionedSavings"),
    ).withColumn("_w", waste).withColumns({
        "Unused": F.col("_w")["n"], "UnusedWaste": F.col("_w")["cost"],
    }).drop("_w").withColumn(
        "TotalSavings", F.col("OverProvisionedSavings") + F.col("UnusedWaste")
    ).withColumns({
        "YearlySavings": total * 12.0,
        "NetSavings": total - system_cost,
        "RoiPercent": (total - system_cost) / system_cost * 100.0,
        "Reinvestable": (total - system_cost) * fixed.REINVEST_SHARE,
    })


def reason_distribution(unused: DataFrame) -> DataFrame:
    """Findings and waste per reason, with their shares."""
    return count_and_waste(unused, "UnusedReason")


def top_services_and_others(unused: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` services with most findings, all other services as one row 'Others'."""
    per_service = unused.filter(F.col("ServiceName").isNotNull()).groupBy("ServiceName").agg(
        F.count("ResourceId").alias("Count"),
        numbers.sum_or_zero(F.col("WastedCost")).alias("Cost"))
    top = per_service.orderBy(F.desc("Count"), "ServiceName").limit(n).select(
        F.col("ServiceName").alias("_top"))
    named = per_service.join(top, F.col("ServiceName") == F.col("_top"), "left")
    return named.groupBy(F.coalesce("_top", F.lit("Others")).alias("Service")).agg(
        F.sum("Count").alias("Count"), F.sum("Cost").alias("Cost"))


def box_statistics(df: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, extremes and quartiles."""
    quartiles = exact_quantiles(df, [], value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    spread = quartiles.select(F.struct("q25", "median", "q75")).scalar()
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                  F.min(value).alias("min"), F.max(value).alias("max"),
                  ).withColumn("_q", spread).select("n", "mean", "min", "max", "_q.*")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in equal-width bins between minimum and maximum; empty bins have no row."""
    limits = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    placed = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v")).withColumn("_l", limits)
    low, high = F.col("_l")["low"], F.col("_l")["high"]
    return placed.groupBy(numbers.equal_width_bin(F.col("_v"), low, high, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def commitment_costs(unused: DataFrame) -> DataFrame:
    """Commitment findings that waste money: the rows behind the cost charts."""
    return unused.filter((F.col("UnusedReason") == "Commitment-Unused") & (F.col("WastedCost") > 0))


def cloud_comparison(unused: DataFrame) -> DataFrame:
    """Findings, waste and mean waste per provider."""
    return unused.filter(F.col("ProviderName").isNotNull()).groupBy("ProviderName").agg(
        F.count("ResourceId").alias("Count"),
        numbers.sum_or_zero(F.col("WastedCost")).alias("TotalCost"),
    ).withColumn("AvgCost", F.try_divide(F.col("TotalCost"), F.col("Count")))


def confidence_bands(estimates: DataFrame) -> DataFrame:
    """Estimates per confidence band; the upper bound belongs to a band."""
    confidence = F.col("confidence")
    band = (F.when((confidence >= 0) & (confidence <= 0.3), "Low")
            .when((confidence > 0.3) & (confidence <= 0.5), "Medium")
            .when((confidence > 0.5) & (confidence <= 0.8), "High")
            .when((confidence > 0.8) & (confidence <= 1.0), "Very High"))
    return estimates.withColumn("band", band).filter(F.col("band").isNotNull()).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"))


def usage_points(estimates: DataFrame) -> DataFrame:
    """CPU and memory of each estimate in percent, with its confidence."""
    return estimates.select("aws_service", (F.col("cpu_mean") * 100.0).alias("cpu_percent"),
                            (F.col("memory_mean") * 100.0).alias("memory_percent"), "confidence")


def detected_and_normal(total: DataFrame, found: DataFrame) -> DataFrame:
    """Two rows: how many rows were found and how many were not."""
    count = total.agg(F.count(F.lit(1))).scalar()
    return found.agg(F.count(F.lit(1)).alias("_found")).withColumn("_all", count).select(
        F.inline(F.array(
            F.struct(F.lit("Over-Provisioned").alias("status"), F.col("_found").alias("n")),
            F.struct(F.lit("Normal").alias("status"), (F.col("_all") - F.col("_found")).alias("n")))))


def top_usage_services(patterns: DataFrame, metric: str = "cpu", n: int = 15) -> DataFrame:
    """Services with the highest mean usage, in percent."""
    mean = F.coalesce(F.col(metric)["mean"], F.lit(0.0)) * 100.0
    return patterns.select("service_name", mean.alias("mean_percent")).orderBy(
        F.desc("mean_percent"), "service_name").limit(n)
