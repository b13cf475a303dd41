"""Learned patterns, estimates and their validation (I operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.sql import add, using
from idlespan.operators import learning, validation
from idlespan.session import written

_STATS = ("mean", "median", "std", "min", "max", "q25", "q50", "q75")
_FLAT = [f"{m}_{s}" for m in ("cpu", "memory") for s in _STATS]
_ESTIMATED = [f"{m}_{s}" for m in ("cpu", "memory") for s in ("mean", "std", "median", "min", "max")]


def rounds(columns, digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def patterns_of(charges):
    return learning.learn_patterns(learning.clean_usage(charges))


def estimates_of(charges):
    """Patterns are learned and stored once, then applied; estimates are stored too, so that their size is known."""
    return written(learning.estimate_services(charges, written(patterns_of(charges))))


@query("i1_clean_usage", using("usage") + """
SELECT service_name, round(cpu, 10) AS cpu, round(memory, 10) AS memory FROM usage""")
def _(charges):
    return rounded(learning.clean_usage(charges), cpu=10, memory=10)


@query("i1_clean_usage_in_percent", using("charges") + """
, percent AS (SELECT ServiceName AS service_name, SimulatedCPUUsage * 100 AS c, SimulatedMemoryUsage * 150 AS m FROM charges),
cpu_ok AS (SELECT service_name, m, c / (CASE WHEN (SELECT max(c) FROM percent) > 1.5 THEN 100.0 ELSE 1.0 END) AS cpu
           FROM percent WHERE c IS NOT NULL),
kept AS (SELECT * FROM cpu_ok WHERE cpu > 0 AND cpu <= 1 AND m IS NOT NULL),
scaled AS (SELECT service_name, cpu, m / (CASE WHEN (SELECT max(m) FROM kept) > 1.5 THEN 100.0 ELSE 1.0 END) AS memory FROM kept)
SELECT service_name, round(cpu, 10) AS cpu, round(memory, 10) AS memory FROM scaled WHERE memory > 0 AND memory <= 1""")
def _(charges):
    percent = charges.withColumns({"SimulatedCPUUsage": F.col("SimulatedCPUUsage") * 100,
                                   "SimulatedMemoryUsage": F.col("SimulatedMemoryUsage") * 150})
    return rounded(learning.clean_usage(percent), cpu=10, memory=10)


@query("i2_service_patterns", using("patterns") + f"""
SELECT service_name, sample_count, {rounds(_FLAT, 8)} FROM patterns""")
def _(charges):
    return rounded(learning.flat_patterns(patterns_of(charges)), **{c: 8 for c in _FLAT})


_SUMMARY = [f"{m}_{s}" for m in ("cpu", "memory") for s in ("mean", "median", "min", "max")]


@query("i3_pattern_summary", using("patterns", "average") + f"""
SELECT (SELECT count(*) FROM patterns) AS services,
       (SELECT CAST(sum(sample_count) AS BIGINT) FROM patterns) AS total_samples, {rounds(_SUMMARY, 8)} FROM average""")
def _(charges):
    return rounded(learning.pattern_summary(written(patterns_of(charges))), **{c: 8 for c in _SUMMARY})


@query("i3_top_patterns", using("patterns") + """
SELECT service_name, sample_count, round(cpu_mean * 100, 6) AS cpu_percent, round(memory_mean * 100, 6) AS memory_percent
FROM patterns ORDER BY sample_count DESC, service_name LIMIT 10""")
def _(charges):
    return rounded(learning.top_patterns(patterns_of(charges)), cpu_percent=6, memory_percent=6)


@query("i4_service_match", using("matched") + "SELECT aws_service, target FROM matched")
def _(charges):
    names = charges.select(F.col("ServiceName").alias("aws_service")).distinct()
    return names.withColumn("target", learning.match_service(F.col("aws_service")))


@query("i5_global_average", using("average") + f"SELECT {rounds(_ESTIMATED, 8)} FROM average")
def _(charges):
    return rounded(learning.global_average(patterns_of(charges)), **{c: 8 for c in _ESTIMATED})


@query("i6_estimates", using("estimates") + f"""
SELECT aws_service, matched_gcp_service, method, confidence, {rounds(_ESTIMATED, 8)} FROM estimates""")
def _(charges):
    return rounded(estimates_of(charges), **{c: 8 for c in _ESTIMATED})


@query("i7_charges_with_estimates", using("estimated") + """
SELECT ResourceId, ServiceName, ChargePeriodStart, BilledCost, matched_gcp_service, method, confidence,
       round(cpu_mean, 8) AS cpu_mean, round(memory_mean, 8) AS memory_mean FROM estimated""")
def _(charges):
    aws = charges.filter(F.col("ProviderName") == "AWS")
    return rounded(learning.attach_estimates(aws, estimates_of(charges)).select(
        "ResourceId", "ServiceName", "ChargePeriodStart", "BilledCost", "matched_gcp_service", "method",
        "confidence", "cpu_mean", "memory_mean"), cpu_mean=8, memory_mean=8)


@query("i8_estimate_summary", using("estimates") + """
SELECT count(*) AS services, count(*) FILTER (WHERE method = 'exact_match') AS exact_match_count,
       count(*) FILTER (WHERE method = 'global_average') AS global_average_count,
       round(avg(confidence), 8) AS confidence_mean, median(confidence) AS confidence_median,
       min(confidence) AS confidence_min, max(confidence) AS confidence_max,
       round(avg(cpu_mean) * 100, 6) AS cpu_mean, round(median(cpu_mean) * 100, 6) AS cpu_median,
       round(min(cpu_mean) * 100, 6) AS cpu_min, round(max(cpu_mean) * 100, 6) AS cpu_max,
       round(avg(memory_mean) * 100, 6) AS memory_mean, round(median(memory_mean) * 100, 6) AS memory_median,
       round(min(memory_mean) * 100, 6) AS memory_min, round(max(memory_mean) * 100, 6) AS memory_max,
       round(count(*) FILTER (WHERE method = 'exact_match') / count(*) * 100, 8) AS exact_match_percent,
       round(count(*) FILTER (WHERE method = 'global_average') / count(*) * 100, 8) AS global_average_percent
FROM estimates""")
def _(charges):
    digits = {f"{m}_{s}": 6 for m in ("cpu", "memory") for s in ("mean", "median", "min", "max")}
    return rounded(learning.estimate_summary(estimates_of(charges)), confidence_mean=8, exact_match_percent=8,
                   global_average_percent=8, **digits)


# --- validation -------------------------------------------------------------------

def _hash_key():
    """Integer text of the usages, the same in both engines."""
    return [F.col("service_name"), *[F.round(F.col(m) * 1000000).cast("bigint") for m in ("cpu", "memory")]]


add("counted", ("charges",), """
SELECT ServiceName AS service_name, SimulatedCPUUsage AS cpu, SimulatedMemoryUsage AS memory, count(*) AS copies
FROM charges WHERE SimulatedCPUUsage > 0 AND SimulatedMemoryUsage > 0 AND ServiceName IS NOT NULL GROUP BY ALL""")
add("split", ("counted",), """
SELECT *, copies - train_copies AS test_copies FROM (
  SELECT service_name, cpu, memory, copies,
         CAST(greatest(least(CASE WHEN n < 5 THEN n ELSE floor(n * 0.8) END - (upto - copies), copies), 0) AS BIGINT)
           AS train_copies
  FROM (SELECT *, sum(copies) OVER (PARTITION BY service_name) AS n,
               sum(copies) OVER (PARTITION BY service_name ORDER BY h, cpu, memory ROWS UNBOUNDED PRECEDING) AS upto
        FROM (SELECT *, md5('42|' || service_name || '|' || CAST(round(cpu * 1000000) AS BIGINT) || '|'
                            || CAST(round(memory * 1000000) AS BIGINT)) AS h FROM counted)))""")
add("train_patterns", ("split",), """
SELECT service_name, CAST(count(*) AS BIGINT) AS sample_count, avg(cpu) AS cpu_mean, stddev_samp(cpu) AS cpu_std, median(cpu) AS cpu_median,
       avg(memory) AS memory_mean, stddev_samp(memory) AS memory_std, median(memory) AS memory_median
FROM (SELECT service_name, cpu, memory, unnest(range(train_copies)) FROM split) GROUP BY 1""")
add("compared", ("split", "train_patterns"), """
SELECT cpu AS actual_cpu, coalesce(p.cpu_mean, (SELECT avg(cpu_mean) FROM train_patterns)) AS estimated_cpu,
       memory AS actual_memory, coalesce(p.memory_mean, (SELECT avg(memory_mean) FROM train_patterns)) AS estimated_memory,
       CASE WHEN p.service_name IS NULL THEN 'global_average' ELSE 'exact_match' END AS match_method,
       test_copies AS copies
FROM split s LEFT JOIN train_patterns p USING (service_name) WHERE test_copies > 0""")
add("compared_rows", ("compared",), "SELECT * FROM (SELECT *, unnest(range(copies)) FROM compared)")
add("services", ("split", "train_patterns"), """
SELECT t.service_name, t.actual_cpu, coalesce(p.cpu_mean, (SELECT avg(cpu_mean) FROM train_patterns)) AS estimated_cpu,
       t.actual_memory, coalesce(p.memory_mean, (SELECT avg(memory_mean) FROM train_patterns)) AS estimated_memory,
       CASE WHEN p.service_name IS NULL THEN 'global_average' ELSE 'exact_match' END AS match_method
FROM (SELECT service_name, avg(cpu) AS actual_cpu, avg(memory) AS actual_memory
      FROM (SELECT service_name, cpu, memory, unnest(range(test_copies)) FROM split) GROUP BY 1) t
LEFT JOIN train_patterns p USING (service_name)""")


def _errors_sql(source: str, floor: bool = False) -> str:
    def one(m: str) -> str:
        a, e = f"actual_{m}", f"estimated_{m}"
        counted = f"FILTER (WHERE {a} > 0.01)" if floor else ""
        return f"""
SELECT '{m}' AS metric, CAST(count(*) AS BIGINT) AS samples, avg(abs({a} - {e})) AS mae,
       sqrt(avg(({a} - {e}) * ({a} - {e}))) AS rmse,
       1 - sum(({a} - {e}) * ({a} - {e})) / (sum({a} * {a}) - sum({a}) * sum({a}) / count(*)) AS r2,
       coalesce(avg(abs(({a} - {e}) / {a})) {counted} * 100, 0) AS mape FROM {source}"""
    return one("cpu") + " UNION ALL " + one("memory")


add("row_errors", ("compared_rows",), _errors_sql("compared_rows"))
add("service_errors", ("services",), _errors_sql("services", floor=True))


def split_of(charges):
    return validation.split_by_service(validation.clean_for_validation(charges), by=_hash_key())


def _compared(charges, services: bool = False):
    split = written(split_of(charges))
    patterns = written(validation.train_means(validation.part(split, "train")))
    test = validation.part(split, "test")
    return (validation.compare_services if services else validation.compare_rows)(test, patterns)


@query("i9_split_by_service", using("split") + """
SELECT service_name, round(cpu, 10) AS cpu, round(memory, 10) AS memory, copies, train_copies,
       CAST(test_copies AS BIGINT) AS test_copies FROM split""")
def _(charges):
    return rounded(split_of(charges), cpu=10, memory=10)


_TRAIN = [f"{m}_{s}" for m in ("cpu", "memory") for s in ("mean", "std", "median")]


@query("i10_train_patterns", using("train_patterns") + f"""
SELECT service_name, sample_count, {rounds(_TRAIN, 8)} FROM train_patterns""")
def _(charges):
    return rounded(validation.train_patterns(validation.part(written(split_of(charges)), "train")), **{c: 8 for c in _TRAIN})


@query("i11_row_validation", using("compared") + """
SELECT round(actual_cpu, 8) AS actual_cpu, round(estimated_cpu, 8) AS estimated_cpu,
       round(actual_memory, 8) AS actual_memory, round(estimated_memory, 8) AS estimated_memory,
       match_method, CAST(copies AS BIGINT) AS copies FROM compared""")
def _(charges):
    return rounded(_compared(charges), actual_cpu=8, estimated_cpu=8, actual_memory=8, estimated_memory=8)


@query("i12_error_metrics", using("row_errors") + """
SELECT metric, samples, round(mae, 8) AS mae, round(rmse, 8) AS rmse, round(r2, 6) AS r2, round(mape, 5) AS mape
FROM row_errors""")
def _(charges):
    return rounded(validation.error_metrics(_compared(charges)), mae=8, rmse=8, r2=6, mape=5)


@query("i12_error_by_method", using("compared_rows") + """
SELECT match_method, count(*) AS samples, round(avg(abs(actual_cpu - estimated_cpu)), 8) AS cpu_mae,
       round(avg(abs(actual_memory - estimated_memory)), 8) AS memory_mae FROM compared_rows GROUP BY 1""")
def _(charges):
    return rounded(validation.error_by_method(_compared(charges)), cpu_mae=8, memory_mae=8)


@query("i12_match_counts", using("compared_rows") + """
SELECT count(*) AS total_samples, count(*) FILTER (WHERE match_method = 'exact_match') AS exact_match_count,
       count(*) FILTER (WHERE match_method = 'global_average') AS global_average_count,
       round(count(*) FILTER (WHERE match_method = 'exact_match') / count(*) * 100, 8) AS exact_match_ratio
FROM compared_rows""")
def _(charges):
    return rounded(validation.match_counts(_compared(charges)), exact_match_ratio=8)


@query("i13_service_validation", using("services") + """
SELECT service_name, round(actual_cpu, 8) AS actual_cpu, round(estimated_cpu, 8) AS estimated_cpu,
       round(actual_memory, 8) AS actual_memory, round(estimated_memory, 8) AS estimated_memory, match_method
FROM services""")
def _(charges):
    return rounded(_compared(charges, services=True).drop("copies"), actual_cpu=8, estimated_cpu=8,
                   actual_memory=8, estimated_memory=8)


@query("i13_service_errors", using("service_errors") + """
SELECT metric, samples, round(mae, 8) AS mae, round(rmse, 8) AS rmse, round(r2, 4) AS r2, round(mape, 5) AS mape
FROM service_errors""")
def _(charges):
    return rounded(validation.error_metrics(_compared(charges, services=True), min_actual=0.01),
                   mae=8, rmse=8, r2=4, mape=5)


@query("i13_most_accurate_services", using("services") + """
SELECT service_name, round(abs(actual_cpu - estimated_cpu), 8) AS cpu_error FROM services
ORDER BY abs(actual_cpu - estimated_cpu), service_name LIMIT 5""")
def _(charges):
    return rounded(validation.most_accurate_services(_compared(charges, services=True)).select(
        "service_name", "cpu_error"), cpu_error=8)


@query("i14_report_summary", using("row_errors", "compared_rows") + """
SELECT c.samples AS test_samples,
       (SELECT round(count(*) FILTER (WHERE match_method = 'exact_match') / count(*) * 100, 8) FROM compared_rows)
         AS exact_match_ratio,
       round(c.mae * 100, 6) AS cpu_mae_percent, round(c.rmse * 100, 6) AS cpu_rmse_percent, round(c.r2, 6) AS cpu_r2,
       round(m.mae * 100, 6) AS memory_mae_percent, round(m.rmse * 100, 6) AS memory_rmse_percent,
       round(m.r2, 6) AS memory_r2, round((c.mae + m.mae) / 2 * 100, 6) AS avg_mae_percent,
       round((c.r2 + m.r2) / 2, 6) AS avg_r2
FROM row_errors c JOIN row_errors m ON c.metric = 'cpu' AND m.metric = 'memory'""")
def _(charges):
    compared = _compared(charges)
    summary = validation.report_summary(validation.error_metrics(compared), validation.match_counts(compared))
    names = [c for c in summary.columns if c != "test_samples"]
    return rounded(summary, **{c: 8 if c == "exact_match_ratio" else 6 for c in names})
