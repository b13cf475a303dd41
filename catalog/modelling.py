"""Features, splits, models and their measures (M operators).

Queries that fit models return what must hold of every fit, which SQL can say too.
"""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.hours import rolled, rolled_stretches
from catalog.registry import query, rounded
from catalog.sql import IS_AWS, IS_GCP, add, label, using
from idlespan import fixed_values as fixed
from idlespan.operators import features, models, overprovisioned
from idlespan.operators.conversion import of_cloud
from idlespan.operators.rollup import LAYOUT, hours_of_stretches
from idlespan.operators.sampling import hash_split, with_copies
from idlespan.session import shared_folder, written
from idlespan.sources.stores import load_models, save_models

_CLOCK = ("CAST(hour(HourlyTimestamp) AS DOUBLE) AS f_hour, "
          "CAST(isodow(HourlyTimestamp) - 1 AS DOUBLE) AS f_weekday")
add("train_rows", ("rollup",), f"""
SELECT *, AvgCPUUsage AS cpu, AvgMemoryUsage AS memory FROM rollup
WHERE {IS_GCP} AND AvgCPUUsage > 0 AND AvgCPUUsage <= 1 AND AvgMemoryUsage > 0 AND AvgMemoryUsage <= 1""")


def _stored_rollup(charges):
    """The rollup as a table of stretches, since fitting and scoring both read it."""
    return written(rolled_stretches(charges).drop(*LAYOUT))


def _summary(df, *names):
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


@query("m1_regression_features", using("rollup") + f"""
SELECT ResourceId, HourlyTimestamp, coalesce(ServiceName, 'Unknown') AS f_service,
       coalesce(ResourceType, 'Unknown') AS f_type, round(TotalHourlyCost, 8) AS f_cost, {_CLOCK} FROM rollup""")
def _(charges):
    return rounded(features.regression_features(rolled(charges)).select(
        "ResourceId", "HourlyTimestamp", "f_service", "f_type", "f_cost", "f_hour", "f_weekday"), f_cost=8)


@query("m1_boosting_features", using("rollup") + f"""
SELECT ServiceName, {label("ServiceName", fixed.BOOSTING_RESOURCE_TYPES, "Other")} AS f_type, f_hour, f_weekday,
       count(*) AS n FROM (SELECT *, {_CLOCK} FROM rollup) GROUP BY ALL""")
def _(charges):
    untyped = rolled(charges).drop("ResourceType")
    return _summary(features.boosting_features(untyped), "ServiceName", "f_type", "f_hour", "f_weekday")


@query("m2_classifier_features", using("rollup") + f"""
SELECT ResourceId, HourlyTimestamp,
       {label("ServiceName", fixed.SERVICE_CATEGORIES + fixed.GENERIC_CATEGORIES, "Other")} AS f_category,
       coalesce(ResourceType, 'Unknown') AS f_type, round(ln(1 + TotalHourlyCost), 7) AS f_log_cost, {_CLOCK}
FROM rollup""")
def _(charges):
    # Equal hours are rounded once.
    return features.classifier_features(rolled_stretches(charges), digits=7).select(
        "ResourceId", "HourlyTimestamp", "f_category", "f_type", "f_log_cost", "f_hour", "f_weekday")


def _codes_sql(unseen: bool) -> str:
    names = "SELECT ServiceName AS name FROM rollup WHERE " + IS_GCP
    if unseen:
        names += " UNION ALL SELECT 'Unknown'"
    fallback = "(SELECT code FROM codes WHERE name = 'Unknown')" if unseen else "0"
    return using("rollup") + f"""
, codes AS (SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS DOUBLE) AS code
            FROM (SELECT DISTINCT name FROM ({names})))
SELECT ServiceName, coalesce(code, {fallback}) AS code, count(*) AS n
FROM rollup LEFT JOIN codes ON name = ServiceName GROUP BY ALL"""


def _codes(charges, unseen):
    rows = features.regression_features(hours_of_stretches(_stored_rollup(charges)))
    fitted = models.fit_codes(of_cloud(rows, "GCP"), ["f_service"], unseen)
    coded = fitted.transform(rows).withColumn("code", F.col("f_service_code"))
    return _summary(coded, "ServiceName", "code")


@query("m3_name_codes_unseen_first", _codes_sql(False))
def _(charges):
    return _codes(charges, None)


@query("m3_name_codes_unseen_unknown", _codes_sql(True))
def _(charges):
    return _codes(charges, "Unknown")


@query("m4_standard_scaling", using("charges") + """
, codes AS (SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS DOUBLE) AS code
            FROM (SELECT DISTINCT ServiceName AS name FROM charges)),
coded AS (SELECT ResourceId, ChargePeriodStart, code, BilledCost AS cost, ConsumedQuantity AS quantity
          FROM charges JOIN codes ON name = ServiceName),
s AS (SELECT avg(code) AS m0, stddev_samp(code) AS s0, avg(cost) AS m1, stddev_samp(cost) AS s1, avg(quantity) AS m2,
             stddev_samp(quantity) AS s2 FROM coded)
SELECT ResourceId, ChargePeriodStart, round((code - m0) / s0, 6) AS service, round((cost - m1) / s1, 6) AS cost,
       round((quantity - m2) / s2, 6) AS quantity, code AS plain_code FROM coded, s""")
def _(charges):
    """What models are given: codes of names and numbers, both scaled, or the codes as they are."""
    names, amounts = ["ServiceName"], ["BilledCost", "ConsumedQuantity"]
    scaled = models._encoder(charges, names, amounts, None, scale_codes=True).transform(charges)
    vector = vector_to_array("features")
    own = scaled.select("ResourceId", "ChargePeriodStart", *amounts, "ServiceName", vector[0].alias("service"),
                        vector[1].alias("cost"), vector[2].alias("quantity"))
    plain = models._encoder(charges, names, amounts, None, scale_codes=False).transform(own)
    return rounded(plain.select("ResourceId", "ChargePeriodStart", "service", "cost", "quantity",
                                vector_to_array("features")[0].alias("plain_code")), service=6, cost=6, quantity=6)


@query("m5_training_rows", using("train_rows") + """
SELECT ServiceName, count(*) AS n, round(min(cpu), 8) AS low, round(max(memory), 8) AS high FROM train_rows GROUP BY 1""")
def _(charges):
    rows = features.training_rows(of_cloud(rolled(charges), "GCP"))
    return rounded(rows.groupBy("ServiceName").agg(
        F.count(F.lit(1)).alias("n"), F.min("cpu").alias("low"), F.max("memory").alias("high")), low=8, high=8)


add("counted_rows", ("train_rows",), """
SELECT ServiceName, CAST(hour(HourlyTimestamp) AS INTEGER) AS hour, CAST(round(cpu * 1000000) AS BIGINT) AS c,
       CAST(round(memory * 1000000) AS BIGINT) AS m, count(*) AS copies FROM train_rows GROUP BY ALL""")


def _counted(charges):
    rows = features.training_rows(of_cloud(rolled(charges), "GCP"))
    whole = rows.select("ServiceName", F.hour("HourlyTimestamp").alias("hour"),
                        F.round(F.col("cpu") * 1000000).cast("bigint").alias("c"),
                        F.round(F.col("memory") * 1000000).cast("bigint").alias("m"))
    return with_copies(whole, ["ServiceName", "hour", "c", "m"])


def _cut_sql(wanted: str, seed: int) -> str:
    return using("counted_rows") + f"""
SELECT ServiceName, hour, c, m, copies,
       CAST(greatest(least({wanted} - (upto - copies), copies), 0) AS BIGINT) AS train_copies
FROM (SELECT *, sum(copies) OVER () AS n, sum(copies) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto
      FROM (SELECT *, md5('{seed}|' || ServiceName || '|' || hour || '|' || c || '|' || m) AS h FROM counted_rows))"""


@query("m6_random_split", _cut_sql("floor(n * 0.8)", 42))
def _(charges):
    by = [F.col(c) for c in ("ServiceName", "hour", "c", "m")]
    return hash_split(_counted(charges), by=by).drop("test_copies")


@query("m6_sample", _cut_sql("least(n, 50000)", 7))
def _(charges):
    by = [F.col(c) for c in ("ServiceName", "hour", "c", "m")]
    return hash_split(_counted(charges), by=by, train_fraction=1.0, max_train_rows=50_000, seed=7).drop("test_copies")


def _classes(charges):
    """Usages are rounded so that both engines see the same values at the limits."""
    rows = features.training_rows(of_cloud(rolled(charges), "GCP"))
    return features.with_usage_classes(rounded(rows, cpu=9, memory=9))


add("train_rows_rounded", ("train_rows",), "SELECT * REPLACE (round(cpu, 9) AS cpu, round(memory, 9) AS memory) FROM train_rows")
add("classes", ("train_rows_rounded",), """
SELECT *, CASE WHEN cpu < (SELECT quantile_cont(cpu, 0.25) FROM train_rows_rounded) THEN 'Low'
               WHEN cpu < (SELECT quantile_cont(cpu, 0.75) FROM train_rows_rounded) THEN 'Medium' ELSE 'High' END AS cpu_class,
       CASE WHEN memory < (SELECT quantile_cont(memory, 0.25) FROM train_rows_rounded) THEN 'Low'
            WHEN memory < (SELECT quantile_cont(memory, 0.75) FROM train_rows_rounded) THEN 'Medium' ELSE 'High' END AS memory_class
FROM train_rows_rounded""")


@query("m9_usage_classes", using("classes") + """
SELECT ServiceName, cpu_class, memory_class, count(*) AS n FROM classes GROUP BY ALL""")
def _(charges):
    return _summary(_classes(charges), "ServiceName", "cpu_class", "memory_class")


@query("m12_confusion", using("classes") + """
SELECT cpu_class AS actual, memory_class AS predicted, count(*) AS n FROM classes GROUP BY ALL""")
def _(charges):
    return models.confusion(_classes(charges), "cpu_class", "memory_class")


@query("m12_classification_metrics", using("classes") + """
, c AS (SELECT k, count(*) FILTER (WHERE cpu_class = k) AS a, count(*) FILTER (WHERE memory_class = k) AS p,
               count(*) FILTER (WHERE cpu_class = k AND memory_class = k) AS t
        FROM classes, (VALUES ('Low'), ('Medium'), ('High')) v(k) GROUP BY k)
SELECT round(sum(t) / sum(a), 8) AS accuracy, round(avg(t / p), 8) AS precision, round(avg(t / a), 8) AS recall,
       round(avg(2 * t / (a + p)), 8) AS f1 FROM c""")
def _(charges):
    measured = models.classification_metrics(models.confusion(_classes(charges), "cpu_class", "memory_class"))
    return rounded(measured, accuracy=8, precision=8, recall=8, f1=8)


# --- measures of given predictions: SQL can follow -------------------------------------------------------

def _test_table(charges):
    """GCP rows with known usage, each a test row, with their features."""
    rows = features.training_rows(features.regression_features(of_cloud(rolled(charges), "GCP")))
    return rounded(rows, cpu=9, memory=9).withColumn("test_copies", F.lit(1).cast("bigint"))


def _given(**predictions):
    """A 'model' that says what an expression does."""
    return {metric: SQLTransformer(statement=f"SELECT *, {text} AS prediction FROM __THIS__") for metric, text in predictions.items()}


add("given", ("train_rows_rounded",), """
SELECT 'cpu' AS metric, cpu AS a, hour(HourlyTimestamp) / 24.0 AS e FROM train_rows_rounded
UNION ALL SELECT 'memory', memory, (isodow(HourlyTimestamp) + 2) / 10.0 FROM train_rows_rounded""")
_ERRORS = """
SELECT metric, count(*) AS samples, avg(abs(a - e)) AS mae, sqrt(avg((a - e) * (a - e))) AS rmse,
       1 - sum((a - e) * (a - e)) / sum((a - m) * (a - m)) AS r2, avg(abs((a - e) / a)) * 100 AS mape
FROM (SELECT *, avg(a) OVER (PARTITION BY metric) AS m FROM given) GROUP BY metric"""


def _given_errors(charges):
    said = _given(cpu="f_hour / 24.0D", memory="(f_weekday + 3) / 10.0D")
    return models.regression_metrics(said, _test_table(charges))


def _measured_fit(charges, **options):
    """Errors, on their test rows, of models fitted to the usage that the charges have."""
    fitted, rows = models.RegressionTrainer(**options).fit(_stored_rollup(charges))
    return models.regression_metrics(fitted, rows)


@query("m12_regression_metrics", using("given", extra={"errors": _ERRORS}) + """
SELECT metric, samples, round(mae, 7) AS mae, round(rmse, 7) AS rmse, round(r2, 6) AS r2, round(mape, 4) AS mape,
       CAST(n - floor(n * 0.8) AS BIGINT) AS fitted_samples, true AS fitted_as_expected
FROM errors, (SELECT count(*) AS n FROM train_rows)""")
def _(charges):
    """Errors of predictions that go by the clock. Errors of a fitted forest too: of every test row, in [0, 1], the mean one
    below the root of the squares."""
    measured = _given_errors(charges).withColumn("samples", F.col("samples").cast("bigint"))
    fitted = _measured_fit(charges, numTrees=5, maxDepth=4).select("metric", F.col("samples").cast("bigint").alias("fitted_samples"), (
        _within("mae", "rmse") & (F.col("mae") <= F.col("rmse")) & (F.col("r2") <= 1) & (F.col("mape") >= 0)).alias("fitted_as_expected"))
    return rounded(measured, mae=7, rmse=7, r2=6, mape=4).join(fitted, "metric")


_RECORDED = "(VALUES " + ", ".join(
    f"('{m}', {fixed.FOREST_BASELINE[f'{m}_mae']}::DOUBLE, {fixed.FOREST_BASELINE[f'{m}_r2']}::DOUBLE)"
    for m in ("cpu", "memory")) + ") AS b(metric, baseline_mae, baseline_r2)"


@query("m13_comparison_with_baseline", using("given", extra={"errors": _ERRORS}) + f"""
SELECT metric, round(mae, 7) AS mae, baseline_mae, round(baseline_mae - mae, 7) AS mae_improvement, round(r2, 6) AS r2,
       baseline_r2, round(r2 - baseline_r2, 6) AS r2_improvement, true AS fitted_as_expected
FROM errors JOIN {_RECORDED} USING (metric)""")
def _(charges):
    """Those errors next to the recorded ones, and those of fitted boosted trees: their gains are the differences."""
    compared = models.compare_with_baseline(_given_errors(charges))
    measured = written(_measured_fit(charges, boosting=True, maxIter=3, maxDepth=3))
    own = measured.select("metric", F.col("mae").alias("m"), F.col("r2").alias("r"))
    same = lambda gain, there: F.abs(F.col(gain) - there) < 1e-12
    fitted = models.compare_with_baseline(measured).join(own, "metric").select("metric", (
        same("mae_improvement", F.col("baseline_mae") - F.col("m"))
        & same("r2_improvement", F.col("r") - F.col("baseline_r2"))).alias("fitted_as_expected"))
    return rounded(compared, mae=7, mae_improvement=7, r2=6, r2_improvement=6).join(fitted, "metric")


_GIVEN_CLASS = "CASE WHEN hour(HourlyTimestamp) < 8 THEN 'Low' WHEN hour(HourlyTimestamp) < 20 THEN 'Medium' ELSE 'High' END"


@query("m10_class_metrics", using("classes") + f"""
, said AS (SELECT 'cpu' AS metric, cpu_class AS actual, {_GIVEN_CLASS} AS predicted FROM classes
           UNION ALL SELECT 'memory', memory_class, {_GIVEN_CLASS} FROM classes),
c AS (SELECT metric, k, count(*) FILTER (WHERE actual = k) AS a, count(*) FILTER (WHERE predicted = k) AS p,
             count(*) FILTER (WHERE actual = k AND predicted = k) AS t
      FROM said, (VALUES ('Low'), ('Medium'), ('High')) v(k) GROUP BY ALL)
SELECT metric, round(sum(t) / sum(a) * 100, 6) AS accuracy_percent, round(sum(t) / sum(a) * 100 - 33.33, 6) AS improvement,
       round(avg(t / p), 8) AS precision, round(avg(t / a), 8) AS recall, round(avg(2 * t / (a + p)), 8) AS f1 FROM c GROUP BY metric""")
def _(charges):
    """Accuracy, its lead over guessing, and class means of predictions that go by the clock."""
    rows = features.with_usage_classes(_test_table(charges))
    by_clock = "CASE WHEN f_hour < 8 THEN 0.0D WHEN f_hour < 20 THEN 1.0D ELSE 2.0D END"
    measured = models.class_metrics(_given(cpu=by_clock, memory=by_clock), rows)
    both = models.compare_with_guessing(measured).join(measured, "metric").select(
        "metric", "accuracy_percent", "improvement", "precision", "recall", "f1")
    return rounded(both, accuracy_percent=6, improvement=6, precision=8, recall=8, f1=8)


# --- fitted models: SQL cannot fit them, so these queries return what must hold of every good fit -------
#
# Usage here goes by the price of an hour, which both clouds have: what a model learned from GCP must come
# true on AWS rows, whose usage no model has seen.

_HALF = 2000.0


def _learnable(charges):
    price = F.try_divide("BilledCost", "ConsumedQuantity")
    measured = F.col("ProviderName") == "GCP"
    return charges.withColumns({
        "SimulatedCPUUsage": F.when(measured, price / (price + _HALF)),
        "SimulatedMemoryUsage": F.when(measured, _HALF / (price + _HALF))})


def _learnable_rollup(charges):
    return _stored_rollup(_learnable(charges))


def _true(cost="TotalHourlyCost"):
    """What the rule says of an hour of one charge."""
    cpu = F.col(cost) / (F.col(cost) + _HALF)
    return cpu, 1 - cpu


_AWS_ROWS = using("rollup") + f"""
SELECT ServiceName, count(*) AS n, count(*) AS as_expected, true AS close FROM rollup WHERE {IS_AWS} GROUP BY 1"""


def _expected(scored, condition, near):
    """Rows per service, how many of them are as they must be, and whether nine in ten of one charge are near the truth."""
    single = (F.col("RecordCount") == 1) & (F.col("TotalHourlyCost") > 0)
    return scored.groupBy("ServiceName").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(condition).alias("as_expected"),
        (F.count_if(single & near) >= 0.9 * F.count_if(single)).alias("close"))


def _within(*names):
    inside = F.lit(True)
    for name in names:
        inside = inside & F.col(name).between(0, 1)
    return inside


def _near(*names):
    gaps = [F.abs(F.col(name) - truth) for name, truth in zip(names, _true())]
    return F.greatest(*gaps) < 0.1


def _regression(charges, **options):
    table = _learnable_rollup(charges)
    trainer = models.RegressionTrainer(**options)
    fitted, rows = trainer.fit(table)
    return trainer, fitted, rows, table


_FULL_FOREST = {"numTrees": 100, "maxDepth": 20}


@query("m7_forest_regression", _AWS_ROWS)
def _(charges):
    """AWS rows with usage predicted by 100 trees of depth 20: all in [0, 1], flagged if and only if low, near the truth."""
    trainer, fitted, _, table = _regression(charges, **_FULL_FOREST)
    flagged = overprovisioned.flag_predictions(trainer.predict(fitted, of_cloud(table, "AWS")))
    low = (F.col("PredictedCPU") < 0.3) | (F.col("PredictedMemory") < 0.3)
    return _expected(flagged, _within("PredictedCPU", "PredictedMemory") & (F.col("IsOverProvisioned") == low),
                     _near("PredictedCPU", "PredictedMemory"))


@query("m8_boosted_regression", _AWS_ROWS)
def _(charges):
    """AWS rows with usage predicted by 100 boosted trees of depth 10: all kept within [0, 1], near the truth."""
    trainer, fitted, _, table = _regression(charges, boosting=True)
    return _expected(trainer.predict(fitted, of_cloud(table, "AWS")), _within("PredictedCPU", "PredictedMemory"),
                     _near("PredictedCPU", "PredictedMemory"))


_N_FEATURES = len(features.REGRESSION_CATEGORIES) + len(features.REGRESSION_NUMBERS)


@query("m12_feature_importance", f"SELECT {_N_FEATURES}::BIGINT AS features, 1.0::DOUBLE AS total, 0::BIGINT AS negative, 'f_cost' AS most")
def _(charges):
    """Importances of all features add up to one; the price matters most."""
    _, fitted, rows, _ = _regression(charges, **_FULL_FOREST)
    found = models.feature_importance(
        fitted["cpu"], [*features.REGRESSION_CATEGORIES, *features.REGRESSION_NUMBERS], rows)
    return found.agg(F.count_distinct("feature").alias("features"), F.round(F.sum("importance"), 8).alias("total"),
                     F.count_if(F.col("importance") < 0).alias("negative"), F.max_by("feature", "importance").alias("most"))


def _classifier(charges, **options):
    table = _learnable_rollup(charges)
    trainer = models.ClassTrainer(**options)
    fitted, rows = trainer.fit(table)
    return trainer, fitted, rows, table


@query("m10_forest_classification", using("rollup") + f"""
SELECT count(*) AS n, count(*) AS as_expected, 3::BIGINT AS classes, true AS close FROM rollup WHERE {IS_AWS}""")
def _(charges):
    """AWS rows with classes predicted by 100 trees of depth 20: flagged if and only if one is 'Low'; all classes occur;
    predicted usage rises from class to class."""
    trainer, fitted, _, table = _classifier(charges)
    flagged = overprovisioned.flag_classes(trainer.predict(fitted, of_cloud(table, "AWS")))
    cpu, memory = F.col("PredictedCPUClass"), F.col("PredictedMemoryClass")
    known = cpu.isin(*fixed.USAGE_CLASSES) & memory.isin(*fixed.USAGE_CLASSES)
    right = known & (F.col("IsOverProvisioned") == ((cpu == "Low") | (memory == "Low")))
    single = (F.col("RecordCount") == 1) & (F.col("TotalHourlyCost") > 0)
    mean = lambda name: F.avg(F.when(single & (cpu == name), _true()[0]))
    return flagged.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(right).alias("as_expected"), F.count_distinct(cpu).alias("classes"),
        ((mean("Low") + 0.1 < mean("Medium")) & (mean("Medium") + 0.1 < mean("High"))).alias("close"))


@query("m11_random_search", "SELECT * FROM (VALUES ('cpu', true), ('memory', true)) AS v(metric, as_expected)")
def _(charges):
    """Classifiers chosen from 15 settings of the whole space by cross-validation: far better than guessing."""
    _, fitted, rows, _ = _classifier(charges, tuning_draws=15)
    measured = models.class_metrics(fitted, rows)
    return measured.select("metric", (_within("accuracy", "precision", "recall", "f1") & (F.col("f1") > 0.7)).alias("as_expected"))


@query("o4_aws_model_streaks", "SELECT true AS found, 0::BIGINT AS wrong")
def _(charges):
    """AWS compute resources with long runs of rows a fitted model calls 'Low': some, each once, with a run of 24 or more."""
    trainer, fitted, _, table = _classifier(charges)
    rows = overprovisioned.compute_rows(of_cloud(table, "AWS"))
    found = overprovisioned.aws_low_streaks(trainer.predict(fitted, rows))
    runs = F.greatest(F.coalesce("ConsecutiveCPUHours", F.lit(0)), F.coalesce("ConsecutiveMemoryHours", F.lit(0)))
    judged = found.join(rows.select("ResourceId", F.lit(True).alias("known")).distinct(), "ResourceId", "left")
    per_resource = judged.groupBy("ResourceId").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.coalesce("known", F.lit(False)) & (runs >= 24)).alias("right"))
    return per_resource.agg((F.count(F.lit(1)) > 0).alias("found"), F.count_if((F.col("n") > 1) | ~F.col("right")).alias("wrong"))


@query("s13_model_store", using("rollup") + f"""
SELECT ServiceName, count(*) AS n, count(*) AS as_expected FROM rollup WHERE {IS_AWS} GROUP BY 1""")
def _(charges):
    """Predictions of models that were saved and loaded equal those of the models themselves, row by row."""
    trainer, fitted, _, table = _regression(charges, **_FULL_FOREST)
    loaded = load_models(save_models(fitted, shared_folder(charges.sparkSession)))
    own = trainer.predict(fitted, of_cloud(table, "AWS")).withColumnsRenamed(
        {"PredictedCPU": "OwnCPU", "PredictedMemory": "OwnMemory"})
    both = trainer.predict(loaded, own)
    same = (F.col("PredictedCPU") == F.col("OwnCPU")) & (F.col("PredictedMemory") == F.col("OwnMemory"))
    return both.groupBy("ServiceName").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("as_expected"))
