"""Learning usage per service where it is known and estimating it where it is not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlespan import fixed_values as fixed
from idlespan.functions import numbers
from idlespan.operators.quantiles import exact_quantiles

_METRICS = ("cpu", "memory")
_QUANTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}
_STATS = ("mean", "median", "std", "min", "max", "q25", "q50", "q75")
_ESTIMATED = ("mean", "std", "median", "min", "max")


def clean_usage(charges: DataFrame, service: str = "ServiceName",
                cpu: str | None = "SimulatedCPUUsage", memory: str | None = "SimulatedMemoryUsage") -> DataFrame:
    """(service_name, cpu, memory) of rows with usage in (0, 1] for both.

    A column whose maximum is above 1.5 is taken to be in percent.  The memory
    maximum is taken over rows that passed the CPU check.  Without one of the
    columns (None, as ``schema.find_usage_columns`` says) the other alone decides,
    and that usage is null.
    """
    given = {"cpu": cpu, "memory": memory}
    if not any(given.values()):
        raise ValueError("neither a CPU nor a memory column")
    rows = charges.select(F.col(service).alias("service_name"), *[
        (numbers.number(F.col(c)) if c else F.lit(None).cast("double")).alias(m) for m, c in given.items()])
    share = lambda c: (c > 0) & (c <= 1)
    # One pass: the memory maximum is taken for either scale of CPU, and the right one chosen.
    passed = (lambda c: share(c)) if cpu else (lambda c: F.lit(True))
    highest = rows.agg(F.struct(
        F.max("cpu").alias("cpu"),
        F.max(F.when(passed(F.col("cpu")), F.col("memory"))).alias("memory"),
        F.max(F.when(passed(F.col("cpu") / 100.0), F.col("memory"))).alias("memory_of_percent"))).scalar()
    present = [m for m, c in given.items() if c]
    known = rows.dropna(subset=present).withColumn("_high", highest)
    percent = F.col("_high.cpu") > 1.5
    memory_high = F.when(percent, F.col("_high.memory_of_percent")).otherwise(F.col("_high.memory"))
    scaled = known.select(
        "service_name", (F.col("cpu") / F.when(percent, 100.0).otherwise(1.0)).alias("cpu"),
        (F.col("memory") / F.when(memory_high > 1.5, 100.0).otherwise(1.0)).alias("memory"))
    for metric in present:
        scaled = scaled.filter(share(F.col(metric)))
    return scaled


def learn_patterns(usage: DataFrame) -> DataFrame:
    """Per service: sample count and distribution of CPU and memory usage."""
    rows = usage.filter(F.col("service_name").isNotNull())
    plain = rows.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("sample_count"),
        *[f(m).alias(f"{m}_{name}") for m in _METRICS for name, f in (
            ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    long = rows.select("service_name", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in _METRICS])).alias("m"))
    spread = exact_quantiles(long.select("service_name", "m.*"), ["service_name", "metric"],
                             "value", _QUANTILES)
    wide = spread.groupBy("service_name").agg(*[
        F.max(F.when(F.col("metric") == m, F.col(q))).alias(f"{m}_{q}")
        for m in _METRICS for q in _QUANTILES])
    # A left join lets Spark drop the quantiles where a caller does not use them.
    both = plain.join(wide, "service_name", "left")
    return both.select("service_name", "sample_count", *[
        F.struct(*[F.col(f"{m}_{'q50' if s == 'median' else s}").alias(s) for s in _STATS]).alias(m)
        for m in _METRICS])


def flat_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns with one column per statistic."""
    return patterns.select("service_name", "sample_count", *[
        F.col(m)[s].alias(f"{m}_{s}") for m in _METRICS for s in _STATS])


def pattern_summary(patterns: DataFrame) -> DataFrame:
    """One row: services, samples, and the spread of the services' means."""
    aggregates = [F.count(F.lit(1)).alias("services"), F.sum("sample_count").alias("total_samples")]
    for m in _METRICS:
        mean = F.col(m)["mean"]
        aggregates += [F.avg(mean).alias(f"{m}_mean"), F.median(mean).alias(f"{m}_median"),
                       F.min(mean).alias(f"{m}_min"), F.max(mean).alias(f"{m}_max")]
    return patterns.agg(*aggregates)


def top_patterns(patterns: DataFrame, n: int = 10) -> DataFrame:
    """Services with the most samples, with mean usage in percent."""
    return (
        patterns.select("service_name", "sample_count",
                        *[(F.coalesce(F.col(m)["mean"], F.lit(0.0)) * 100.0).alias(f"{m}_percent")
                          for m in _METRICS])
        .orderBy(F.desc("sample_count"), "service_name").limit(n))


def match_service(name: Column, mapping: Sequence[tuple[str, str]] = fixed.SERVICE_MAPPING) -> Column:
    """The mapped service: by exact key, else by the first key that contains the name
    or is contained in it, ignoring case; else null."""
    entries = F.array(*[
        F.struct(F.lit(key).alias("key"), F.lit(key.lower()).alias("lower"), F.lit(target).alias("target"))
        for key, target in mapping])
    lowered = F.lower(name)
    exact = F.filter(entries, lambda e: e["key"] == name)
    partial = F.filter(entries, lambda e: lowered.contains(e["lower"]) | e["lower"].contains(lowered))
    return F.coalesce(F.get(exact, 0)["target"], F.get(partial, 0)["target"])


def global_average(patterns: DataFrame) -> DataFrame:
    """One row: unweighted mean of means and of deviations, median, min and max of means."""
    aggregates = []
    for m in _METRICS:
        mean = F.col(m)["mean"]
        aggregates += [F.avg(mean).alias(f"{m}_mean"), F.avg(F.col(m)["std"]).alias(f"{m}_std"),
                       F.median(mean).alias(f"{m}_median"),
                       F.min(mean).alias(f"{m}_min"), F.max(mean).alias(f"{m}_max")]
    return patterns.agg(*aggregates)


def estimate_services(services: DataFrame, patterns: DataFrame,
                      mapping: Sequence[tuple[str, str]] = fixed.SERVICE_MAPPING,
                      service: str = "ServiceName") -> DataFrame:
    """Estimated usage of every distinct service name in ``services``.

    Services that map to a learned pattern take it (confidence 1.0), the others the
    global average (0.3).  Only distinct names are matched; charges get the result
    by an equi-join (``attach_estimates``).
    """
    names = services.select(F.col(service).alias("aws_service")).distinct()
    matched = names.withColumn("_target", match_service(F.col("aws_service"), mapping))
    known = patterns.select(F.col("service_name").alias("_target"),
                            *[F.col(m).alias(f"_{m}") for m in _METRICS],
                            F.lit(True).alias("_found"))
    average = global_average(patterns)
    fallback = average.select(F.struct(*average.columns)).scalar()
    joined = matched.join(known, "_target", "left").withColumn("_average", fallback)

    found = F.coalesce(F.col("_found"), F.lit(False))
    values = [
        F.when(found, F.col(f"_{m}")[s]).otherwise(F.col("_average")[f"{m}_{s}"]).alias(f"{m}_{s}")
        for m in _METRICS for s in _ESTIMATED]
    return joined.select(
        "aws_service",
        F.when(found, F.col("_target")).otherwise("Global Average").alias("matched_gcp_service"),
        F.when(found, "exact_match").otherwise("global_average").alias("method"),
        F.when(found, fixed.EXACT_MATCH_CONFIDENCE)
        .otherwise(fixed.GLOBAL_AVERAGE_CONFIDENCE).alias("confidence"),
        *values)


def attach_estimates(charges: DataFrame, estimates: DataFrame) -> DataFrame:
    """Charges with the estimate for their service (null for services without one)."""
    return charges.join(estimates, charges["ServiceName"] == estimates["aws_service"], "left")


def estimate_summary(estimates: DataFrame) -> DataFrame:
    """One row: methods, confidence and estimated usage over all estimates."""
    aggregates = [
        F.count(F.lit(1)).alias("services"),
        F.count_if(F.col("method") == "exact_match").alias("exact_match_count"),
        F.count_if(F.col("method") == "global_average").alias("global_average_count")]
    for column in ("confidence", "cpu_mean", "memory_mean"):
        name, scale = (column, 1.0) if column == "confidence" else (column[:-5], 100.0)
        aggregates += [(f(column) * scale).alias(f"{name}_{label}") for label, f in (
            ("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))]
    return estimates.agg(*aggregates).withColumns({
        f"{m}_percent": numbers.share_percent(F.col(f"{m}_count"), F.col("services"))
        for m in ("exact_match", "global_average")})
