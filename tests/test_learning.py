"""Quantiles, splits, patterns, estimates and validation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from idlespan.operators import learning, validation
from idlespan.operators.quantiles import exact_quantiles
from idlespan.operators.sampling import hash_split, with_copies
from tests.helpers import same_rows


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_equal_numpy_on_skewed_groups(spark, seed):
    dice = random.Random(seed)
    groups = {"hot": [dice.choice([0.5, dice.random()]) for _ in range(3000)], "few": [0.1, 0.4], "one": [7.0]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("hot", None), ("none", None)]
    table = spark.createDataFrame(rows, "g string, v double")
    found = exact_quantiles(table, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()
    assert {r.g for r in found} == set(groups)
    for r in found:
        assert (r.a, r.b, r.c) == pytest.approx(tuple(np.percentile(groups[r.g], [25, 50, 90])))


def test_quantiles_with_weights_and_without_groups(spark):
    table = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 4)], "v double, w bigint")
    row = exact_quantiles(table, [], "v", {"m": 0.5, "q": 0.3}, weight="w").first()
    expected = np.percentile([1, 1, 1, 2, 9, 9, 9, 9], [50, 30])
    assert (row.m, row.q) == pytest.approx(tuple(expected))


def test_split_sizes_per_service(spark):
    sizes = {"four": 4, "five": 5, "many": 1003}
    rows = [(s, i) for s, n in sizes.items() for i in range(n)] + [("copies", 1)] * 100
    table = with_copies(spark.createDataFrame(rows, "s string, i int"), ["s", "i"])
    split = hash_split(table, by=[F.col("s"), F.col("i")], strata=["s"], min_rows=5)
    found = {r.s: (r.a, r.b) for r in split.groupBy("s").agg(
        F.sum("train_copies").alias("a"), F.sum("test_copies").alias("b")).collect()}
    assert found == {"four": (4, 0), "five": (4, 1), "many": (802, 201), "copies": (80, 20)}


def test_split_does_not_depend_on_partitioning(spark):
    table = with_copies(spark.range(5000).select((F.col("id") % 3).alias("s"), (F.col("id") % 700).alias("i")), ["s", "i"])
    by = [F.col("s"), F.col("i")]
    once = hash_split(table.repartition(7), by=by, strata=["s"])
    again = hash_split(table.coalesce(1), by=by, strata=["s"])
    assert same_rows(once, again)


def test_sample_has_the_exact_size(spark):
    table = with_copies(spark.range(1000).select((F.col("id") % 90).alias("i")), ["i"])
    taken = hash_split(table, by=[F.col("i")], train_fraction=1.0, max_train_rows=123)
    assert taken.agg(F.sum("train_copies")).first()[0] == 123


def test_percent_is_brought_to_fractions(spark):
    rows = [("s", 50.0, 0.5), ("s", 100.0, 1.2), ("s", 0.0, 0.4), ("s", None, 0.4), ("s", 120.0, 1.0)]
    table = spark.createDataFrame(rows, "ServiceName string, SimulatedCPUUsage double, SimulatedMemoryUsage double")
    assert sorted((r.cpu, r.memory) for r in learning.clean_usage(table).collect()) == [(0.5, 0.5)]


def test_patterns_of_a_single_row(spark):
    table = spark.createDataFrame([("s", 0.2, 0.4)], "service_name string, cpu double, memory double")
    row = learning.learn_patterns(table).first()
    assert (row.sample_count, row.cpu.mean, row.cpu["std"], row.memory.q75) == (1, 0.2, None, 0.4)


@pytest.mark.parametrize("name, expected", [
    ("Amazon S3", "Cloud Filestore"), ("aws lambda functions", "Cloud Run"), ("EC2", "App Engine"),
    # Contained in several keys: the first in the list wins.
    ("Amazon Elastic", "App Engine"), ("amazon", "App Engine"), ("Azure Blob", None), (None, None)])
def test_service_match(spark, name, expected):
    table = spark.createDataFrame([(name,)], "n string")
    assert table.select(learning.match_service(F.col("n"))).first()[0] == expected


def test_estimates_fall_back_to_the_global_average(spark):
    usage = spark.createDataFrame(
        [("Cloud Run", 0.2, 0.4), ("Cloud Run", 0.4, 0.6), ("Cloud SQL", 0.9, 0.5), ("Cloud SQL", 0.7, 0.5)],
        "service_name string, cpu double, memory double")
    services = spark.createDataFrame([("AWS Lambda",), ("Amazon EC2",), ("AWS Lambda",)], "ServiceName string")
    found = {r.aws_service: r for r in learning.estimate_services(services, learning.learn_patterns(usage)).collect()}
    lambda_, ec2 = found["AWS Lambda"], found["Amazon EC2"]
    assert (lambda_.matched_gcp_service, lambda_.method, lambda_.confidence) == ("Cloud Run", "exact_match", 1.0)
    assert lambda_.cpu_mean == pytest.approx(0.3)
    assert (ec2.matched_gcp_service, ec2.method, ec2.confidence) == ("Global Average", "global_average", 0.3)
    assert (ec2.cpu_mean, ec2.cpu_min, ec2.cpu_max) == pytest.approx((0.55, 0.3, 0.8))


def test_stored_golden_pattern_means(spark):
    """Global averages are plain means over services, whatever their sample counts."""
    rows = [("App Engine", 5023, 0.503553075851085, 0.2869311991134582), ("Other", 1, 0.1, None)]
    stats = "mean double, median double, std double, min double, max double, q25 double, q50 double, q75 double"
    data = [(s, n, (m, m, d, m, m, m, m, m), (m, m, d, m, m, m, m, m)) for s, n, m, d in rows]
    table = spark.createDataFrame(data, f"service_name string, sample_count bigint, cpu struct<{stats.replace(' double', ': double')}>, "
                                        f"memory struct<{stats.replace(' double', ': double')}>")
    row = learning.global_average(table).first()
    assert row.cpu_mean == pytest.approx((0.503553075851085 + 0.1) / 2)
    assert row.cpu_std == pytest.approx(0.2869311991134582)


def test_errors_equal_numpy(spark):
    actual, guess = np.array([0.2, 0.5, 0.5, 0.9]), np.array([0.3, 0.3, 0.3, 0.3])
    rows = [(0.2, 0.3, 0.2, 0.3, "exact_match", 1), (0.5, 0.3, 0.5, 0.3, "exact_match", 2),
            (0.9, 0.3, 0.9, 0.3, "global_average", 1)]
    table = spark.createDataFrame(rows, "actual_cpu double, estimated_cpu double, actual_memory double, "
                                        "estimated_memory double, match_method string, copies bigint")
    row = validation.error_metrics(table).filter("metric = 'cpu'").first()
    gap = actual - guess
    assert row.samples == 4
    assert row.mae == pytest.approx(np.abs(gap).mean()) and row.rmse == pytest.approx(np.sqrt((gap ** 2).mean()))
    assert row.r2 == pytest.approx(1 - (gap ** 2).sum() / ((actual - actual.mean()) ** 2).sum())
    assert row.mape == pytest.approx(np.abs(gap / actual).mean() * 100)
    assert validation.match_counts(table).first().exact_match_ratio == 75.0


def test_train_patterns_weigh_copies(spark):
    values = [0.1, 0.1, 0.1, 0.4, 0.7]
    table = spark.createDataFrame([("s", 0.1, 0.1, 3), ("s", 0.4, 0.4, 1), ("s", 0.7, 0.7, 1), ("one", 0.5, 0.5, 1)],
                                  "service_name string, cpu double, memory double, copies bigint")
    found = {r.service_name: r for r in validation.train_patterns(table).collect()}
    assert found["s"].cpu_mean == pytest.approx(np.mean(values))
    assert found["s"].cpu_std == pytest.approx(np.std(values, ddof=1))
    assert found["s"].memory_median == pytest.approx(np.median(values))
    assert found["one"].cpu_std is None


def test_service_without_train_rows_takes_the_mean_of_means(spark):
    patterns = spark.createDataFrame([("a", 10, 0.2, 0.2), ("b", 1, 0.6, 0.4)],
                                     "service_name string, sample_count bigint, cpu_mean double, memory_mean double")
    test = spark.createDataFrame([("a", 0.3, 0.3, 1), ("new", 0.3, 0.3, 1)],
                                 "service_name string, cpu double, memory double, copies bigint")
    found = {r.match_method: r.estimated_cpu for r in validation.compare_rows(test, patterns).collect()}
    assert found == pytest.approx({"exact_match": 0.2, "global_average": 0.4})


def test_classifier_features_of_stretches_are_worked_out_once(spark):
    from idlespan.operators import features, rollup
    from tests.helpers import charge_row, charge_table, same_rows

    charges = charge_table(spark, [charge_row(start_hour=h, hours=30.0, cost=c, service=s) for h, c, s in (
        (0, 3.0, "Compute Engine"), (5.5, 7.0, None), (20, 11.0, "Cloud SQL"))])
    hours, stretches = rollup.resource_hours_of_charges(charges), rollup.resource_stretches_of_charges(charges)
    found = features.classifier_features(stretches, digits=7)
    plain = features.classifier_features(hours)
    assert found.count() == 90 and same_rows(found.withColumn("f_log_cost", F.round("f_log_cost", 6)), plain.withColumn("f_log_cost", F.round("f_log_cost", 6)))
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= text.index("explode(_hours") < text.index("LOG1P")
