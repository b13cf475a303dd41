"""Whole routes in one call: validation, models, and detections saved with their statistics.

Every function runs jobs; what several results share is stored once in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlespan import fixed_values as fixed
from idlespan.operators import models, overprovisioned, unused, validation
from idlespan.operators.conversion import of_cloud, with_cloud
from idlespan.operators.rollup import LAYOUT
from idlespan.plans.detection import rollup_of, stretches_of
from idlespan.schema import OVERPROVISIONED_COLUMNS, UNUSED_COLUMNS, keep_existing
from idlespan.session import written
from idlespan.sources.sinks import write_per_cloud, write_stats
from idlespan.sources.stores import save_models


def validated(charges: DataFrame, top: int = 5) -> dict[str, DataFrame]:
    """How well patterns learned from four fifths of the measured rows say what the others used.

    ``rows`` and ``services`` compare, ``errors`` and ``service_errors`` measure,
    ``by_method``, ``matches``, ``best`` and ``summary`` sum up.
    """
    split = written(validation.split_by_service(validation.clean_for_validation(charges)))
    patterns = written(validation.train_means(validation.part(split, "train")))
    test = validation.part(split, "test")
    rows, services = written(validation.compare_rows(test, patterns)), written(validation.compare_services(test, patterns))
    errors, matches = written(validation.error_metrics(rows)), written(validation.match_counts(rows))
    return {
        "rows": rows, "services": services, "errors": errors,
        "service_errors": validation.error_metrics(services, min_actual=0.01),
        "by_method": validation.error_by_method(rows), "matches": matches,
        "best": validation.most_accurate_services(services, top),
        "summary": validation.report_summary(errors, matches)}


def modelled(charges: DataFrame, trainer=None, folder: str | None = None) -> dict:
    """Learn usage from GCP, measure it on held-out rows, apply it to AWS, and flag what is over-provisioned.

    ``trainer`` is a ``RegressionTrainer`` (forests by default) or a ``ClassTrainer``.
    Returns ``models``, ``test`` rows, ``metrics``, their ``comparison`` with the recorded
    ones or with guessing, and ``flagged`` rows.  With ``folder`` the models are saved there.
    """
    trainer = trainer or models.RegressionTrainer(numTrees=100, maxDepth=20)
    classes = isinstance(trainer, models.ClassTrainer)
    rollup = written(rollup_of(charges).drop(*LAYOUT))
    fitted, table = trainer.fit(rollup)
    if folder is not None:
        save_models(fitted, f"{folder}/models")
    scored = trainer.predict(fitted, of_cloud(rollup, "AWS"))
    metrics = written(models.class_metrics(fitted, table) if classes else models.regression_metrics(fitted, table))
    return {
        "models": fitted, "test": models.weighted(table, "test"), "metrics": metrics,
        "comparison": models.compare_with_guessing(metrics) if classes else models.compare_with_baseline(metrics),
        "flagged": overprovisioned.flag_classes(scored) if classes else overprovisioned.flag_predictions(scored)}


def save_over_provisioned(charges: DataFrame, folder: str, fitted=None, trainer=None) -> dict[str, str]:
    """Long runs of low usage, one gzipped CSV folder per cloud, and their statistics.

    GCP goes by measured usage; with ``fitted`` models of a ``ClassTrainer`` AWS goes by
    predicted classes.  Returns the paths ``detections`` and ``statistics``.
    """
    rollup = rollup_of(charges)
    found = [overprovisioned.gcp_low_streaks(stretches_of(charges))]
    if fitted is not None:
        # Stored, as runs and statistics both read what the models say.
        scored = written(trainer.predict(fitted, rollup))
        found.append(overprovisioned.aws_low_streaks(scored))
    else:
        scored = rollup.withColumns({f"Predicted{m}Class": F.lit(None).cast("string") for m in ("CPU", "Memory")})
    detections = with_cloud(overprovisioned.union_of_clouds(*found))
    return _saved(keep_existing(detections, [*OVERPROVISIONED_COLUMNS, "Cloud"]),
                  overprovisioned.detection_stats_of_rollup(scored), folder)


def save_unused(charges: DataFrame, folder: str, idle_days: int = fixed.IDLE_DAYS) -> dict[str, str]:
    """Idle commitments and long runs without usage, one gzipped CSV folder per cloud, and their statistics."""
    rollup = stretches_of(charges)
    detections = with_cloud(unused.unused_resources(rollup, idle_days))
    return _saved(keep_existing(detections, [*UNUSED_COLUMNS, "Cloud"]), unused.unused_stats(rollup, idle_days), folder)


def _saved(shown: DataFrame, stats: DataFrame, folder: str) -> dict[str, str]:
    return {"detections": write_per_cloud(shown, f"{folder}/detections", cloud="Cloud"),
            "statistics": write_stats(stats, f"{folder}/statistics")}
