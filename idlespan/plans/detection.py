"""From charges to findings in one plan, without files between the steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlespan import fixed_values as fixed
from idlespan.operators import learning, overprovisioned, reports, timegrid, unused
from idlespan.operators.conversion import filter_cloud, of_cloud, provider_of_file
from idlespan.operators.rollup import hourly_aggregate, resource_hours_of_charges, resource_stretches_of_charges
from idlespan.schema import CHARGES, OVERPROVISIONED_COLUMNS, UNUSED_COLUMNS, keep_existing
from idlespan.session import written
from idlespan.sources.tables import SOURCE_FILE, typed


def rollup_of(charges: DataFrame) -> DataFrame:
    """The resource-hour rollup, partitioned for the streak operators."""
    return resource_hours_of_charges(charges, keep_usage_date=True)


def stretches_of(charges: DataFrame) -> DataFrame:
    """The same rollup as a table of stretches, which runs and sums need not tell apart."""
    return resource_stretches_of_charges(charges, keep_usage_date=True)


def low_usage_report(*charge_tables: DataFrame) -> DataFrame:
    """Merge, clean, roll up, aggregate by hour and list resources with many low hours."""
    charges = timegrid.parse_charges(timegrid.merge_tables(*charge_tables))
    return overprovisioned.low_usage_hours(hourly_aggregate(rollup_of(charges), ordered=False))


def over_provisioned_report(charges: DataFrame, models=None, trainer=None) -> DataFrame:
    """GCP resources by measured usage and, given models, AWS resources by predicted class."""
    rollup = rollup_of(charges)
    found = overprovisioned.gcp_low_streaks(rollup)
    if models is not None:
        scored = trainer.predict(models, overprovisioned.compute_rows(of_cloud(rollup, "AWS")))
        found = overprovisioned.union_of_clouds(found, overprovisioned.aws_low_streaks(scored))
    return keep_existing(found, OVERPROVISIONED_COLUMNS)


def unused_report(charges: DataFrame, idle_days: int = fixed.IDLE_DAYS) -> DataFrame:
    """Idle commitments and long runs without usage, one row per resource."""
    rollup = stretches_of(charges)
    # What is neither reported nor looked at by a rule is not shuffled: keys and costs already order a resource's rows.
    spare = ["AvgCPUUsage", "AvgMemoryUsage", *(["TotalBilledCost"] if "TotalEffectiveCost" in rollup.columns else [])]
    return keep_existing(unused.unused_resources(rollup.drop(*spare), idle_days), UNUSED_COLUMNS)


def estimated_low_usage(learned_from: DataFrame, charges: DataFrame,
                        mapping=fixed.SERVICE_MAPPING) -> DataFrame:
    """Learn usage per service from one table and flag another table's charges by it.

    Patterns and estimates, one row per service, are written to the shared folder:
    jobs run.  Spark then knows how small the estimates are and joins them without
    shuffling the charges, unless there are too many services to broadcast.
    """
    patterns = written(learning.learn_patterns(learning.clean_usage(learned_from)))
    estimates = written(learning.estimate_services(charges, patterns, mapping))
    return overprovisioned.low_estimates(learning.attach_estimates(charges, estimates))


def cloud_patterns(charges: DataFrame, over_provisioning: bool = False, unused_resources: bool = True,
                   split_clouds: bool = True, patterns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Charge-level findings per cloud; the flags choose the rules when planning.

    ``patterns`` names the clouds and the words of their providers, the built-in ones
    by default.  A name that matches several clouds is examined in each of them.
    """
    if split_clouds:
        clouds = patterns or fixed.CLOUD_FILTER_PATTERNS
        tables = {cloud: filter_cloud(charges, cloud, words) for cloud, words in clouds.items()}
    else:
        tables = {"ALL": charges}
    found = []
    for cloud, table in tables.items():
        if over_provisioning:
            found.append(unused.tag_detections(
                overprovisioned.low_usage_charges(table), "OverProvisioning", F.lit(cloud)))
        if unused_resources:
            found.append(unused.tag_detections(unused.unused_charges(table), "Unused", F.lit(cloud)))
    if not found:
        raise ValueError("no rule is enabled")
    return timegrid.merge_tables(*found)


def folder_patterns(text: DataFrame) -> DataFrame:
    """Findings of a folder read with ``read_folder``, each file's provider detected.

    As each file is examined by itself, a resource that occurs in two files is
    reported for both.
    """
    layout = T.StructType([*CHARGES.fields, T.StructField(SOURCE_FILE, T.StringType())])
    charges = typed(text, layout)
    providers = provider_of_file(charges, SOURCE_FILE)
    low = overprovisioned.low_usage_charges(charges).withColumn("PatternType", F.lit("OverProvisioning"))
    idle = unused.first_per_resource(
        [unused.unused_commitments(charges), unused.zero_usage_charges(charges)], within=(SOURCE_FILE,))
    found = timegrid.merge_tables(low, idle.withColumn("PatternType", F.lit("Unused")))
    return found.join(providers, SOURCE_FILE)


def savings_summary(detections: DataFrame) -> DataFrame:
    return reports.savings_by_pattern(detections)
