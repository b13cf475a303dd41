"""Whole routes in one call."""

import pytest
from pyspark.sql import functions as F

from idlespan.operators import models
from idlespan.plans import detection, routes
from idlespan.session import written
from idlespan.sources.stores import load_models
from tests.helpers import charge_row, charge_table


@pytest.fixture(scope="module")
def charges(spark):
    services = ("Compute Engine", "Cloud SQL", "Cloud Run")
    rows = [charge_row(h, resource=f"g{h % 5}", service=services[h % 3], cpu=0.05 + (h % 17) / 20, memory=0.1 + (h % 11) / 20,
                       cost=float(h % 13)) for h in range(500)]
    rows += [charge_row(h, resource="slow", cpu=0.1, memory=0.1) for h in range(60)]
    rows += [charge_row(h, resource="a1", provider="AWS", service="Amazon EC2", cpu=None, memory=None) for h in range(60)]
    rows += [charge_row(h, resource="a2", provider="AWS", service="Amazon EC2", cpu=None, memory=None, cost=0.0, quantity=0.0) for h in range(90)]
    return written(charge_table(spark, rows))


def test_validation(charges):
    found = routes.validated(charges)
    samples = {r.metric: r.samples for r in found["errors"].collect()}
    assert samples["cpu"] == samples["memory"] == found["rows"].agg(F.sum("copies")).first()[0] > 100
    assert found["summary"].first().test_samples == samples["cpu"] and found["best"].count() == 3
    assert found["services"].count() == found["service_errors"].first().samples == 3
    assert {r.match_method for r in found["by_method"].collect()} == {"exact_match"} and found["matches"].first().exact_match_count == samples["cpu"]


@pytest.mark.parametrize("trainer, flags", [
    (models.RegressionTrainer(numTrees=3, maxDepth=3), {"PredictedCPU"}),
    (models.RegressionTrainer(boosting=True, maxIter=3, maxDepth=3), {"PredictedCPU"}),
    (models.ClassTrainer(numTrees=3, maxDepth=3), {"PredictedCPUClass"})], ids=["forest", "boosting", "classes"])
def test_model_route(charges, tmp_path, trainer, flags):
    found = routes.modelled(charges, trainer, str(tmp_path))
    assert {r.metric for r in found["metrics"].collect()} == {r.metric for r in found["comparison"].collect()} == {"cpu", "memory"}
    assert flags <= set(found["flagged"].columns) and found["flagged"].count() == 150
    assert found["test"].agg(F.sum("test_copies")).first()[0] == 112
    assert set(load_models(f"{tmp_path}/models")) == {"cpu", "memory"}


def test_saved_detections(spark, charges, tmp_path):
    trainer = models.ClassTrainer(numTrees=3, maxDepth=3)
    fitted, _ = trainer.fit(written(detection.rollup_of(charges).drop("UsageDate", "UsageSpread")))
    for given in ({}, {"fitted": fitted, "trainer": trainer}):
        paths = routes.save_over_provisioned(charges, f"{tmp_path}/low{len(given)}", **given)
        back = spark.read.option("header", True).csv(paths["detections"])
        stats = {r.Cloud: r for r in spark.read.json(paths["statistics"]).collect()}
        found = {r.Cloud: r["count"] for r in back.groupBy("Cloud").count().collect()}
        assert "slow" in {r.ResourceId for r in back.collect()} and stats["AWS"].Total == 150
        assert all(stats[c].OverProvisioned == found.get(c, 0) for c in stats)
    paths = routes.save_unused(charges, f"{tmp_path}/unused")
    assert [(r.ResourceId, r.UnusedReason, r.Cloud) for r in spark.read.option("header", True).csv(paths["detections"]).collect()] == [
        ("a2", "Zero-Usage-90h", "AWS")]
    assert {r.condition: r.total for r in spark.read.json(paths["statistics"]).collect()} == {"commitment_unused": 0, "zero_usage": 1}
