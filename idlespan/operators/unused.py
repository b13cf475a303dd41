"""Finding resources that are paid for or kept but not used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlespan import fixed_values as fixed
from idlespan.functions import numbers, text
from idlespan.operators.quantiles import exact_quantiles
from idlespan.operators.rollup import LAYOUT, STRETCH, hours_each
from idlespan.operators.streaks import longest_runs
from idlespan.operators.timegrid import merge_tables
from idlespan.schema import first_existing, require_columns

_IDENTITY = ("ProviderName", "BillingAccountId", "ServiceName", "ResourceType",
             "CommitmentDiscountStatus", "CommitmentDiscountType", "Region")
_TIMES = ("HourlyTimestamp", "ChargePeriodStart", "ChargePeriodEnd")
_AMOUNTS = ("TotalHourlyCost", "BilledCost", "EffectiveCost", "ConsumedQuantity")


def _is_unused_commitment() -> Column:
    return F.lower(F.col("CommitmentDiscountStatus")) == "unused"


def unused_commitments(charges: DataFrame, require_cost: bool = False) -> DataFrame:
    """Charges for commitments nobody used; ``require_cost`` leaves out free ones."""
    require_columns(charges, ("EffectiveCost", "CommitmentDiscountStatus"))
    found = charges.filter(_is_unused_commitment())
    if require_cost:
        found = found.filter(F.col("EffectiveCost") != 0)
    return found.withColumns({"UnusedReason": F.lit("Commitment-Unused"),
                              "WastedCost": F.col("EffectiveCost")})


def zero_usage_charges(charges: DataFrame, mode: str = "quantity") -> DataFrame:
    """Charges without consumption.

    ``quantity``: consumed quantity is 0.  ``strict``: both costs are 0 and the
    quantity is 0 or missing.
    """
    require_columns(charges, ("EffectiveCost", "BilledCost", "ConsumedQuantity"))
    quantity = F.col("ConsumedQuantity")
    if mode == "quantity":
        idle = quantity == 0
    elif mode == "strict":
        idle = ((F.col("EffectiveCost") == 0) & (F.col("BilledCost") == 0)
                & ((quantity == 0) | quantity.isNull()))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return charges.filter(idle).withColumns(
        {"UnusedReason": F.lit("Zero-Cost-Zero-Usage"), "WastedCost": F.lit(0.0)})


def first_per_resource(detections: Sequence[DataFrame], within: Sequence[str] = ()) -> DataFrame:
    """One row per resource (and ``within``); earlier tables win, then the earliest row.

    Rows without a resource collapse into one.  The smallest row is kept by an
    aggregate, so a resource with very many rows is reduced before the shuffle.
    """
    tables = [d.withColumn("_priority", F.lit(i)) for i, d in enumerate(detections)]
    merged = merge_tables(*tables)
    names = [c for c in merged.columns if c != "_priority"]
    keys = ["ResourceId", *within]
    order = F.struct("_priority", *_total_order(names), *_others_last(names, keys))
    chosen = merged.groupBy(*keys).agg(
        F.min_by(F.struct(*[c for c in names if c not in keys]), order).alias("_row"))
    return chosen.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in names])


def _total_order(columns: Sequence[str]) -> list[Column]:
    """Time, then names (null as empty), then amounts (null as -1)."""
    order = [F.coalesce(F.col(c), F.to_timestamp_ntz(F.lit("1900-01-01"))).alias(f"_o_{c}")
             for c in _TIMES if c in columns]
    order += [F.coalesce(F.col(c), F.lit("")).alias(f"_o_{c}") for c in _IDENTITY if c in columns]
    return order + [F.coalesce(F.col(c), F.lit(-1.0)).alias(f"_o_{c}")
                    for c in _AMOUNTS if c in columns]


def _others_last(columns: Sequence[str], keys: Sequence[str]) -> list[str]:
    used = {*_TIMES, *_IDENTITY, *_AMOUNTS, *keys}
    return [c for c in columns if c not in used]


def unused_charges(charges: DataFrame) -> DataFrame:
    """Both charge-level rules, one row per resource; commitment rows win."""
    return first_per_resource([unused_commitments(charges), zero_usage_charges(charges)])


def unused_commitments_in_rollup(rollup: DataFrame) -> DataFrame:
    """Rollup rows of unused commitments; waste is the hourly (else effective) cost."""
    require_columns(rollup, ("CommitmentDiscountStatus",))
    cost = first_existing(rollup.columns, ("TotalHourlyCost", "TotalEffectiveCost"))
    found = rollup.filter(_is_unused_commitment())
    wasted = F.lit(0.0)
    if cost:
        found = found.withColumn(cost, F.coalesce(numbers.number(F.col(cost)), F.lit(0.0)))
        wasted = F.col(cost)
    return found.withColumns({
        "UnusedReason": F.lit("Commitment-Unused"),
        "DetectionMethod": F.lit("CommitmentStatus"),
        "WastedCost": wasted,
    })


def _zero_rows(rollup: DataFrame) -> tuple[DataFrame, Column]:
    """The rollup with missing amounts as 0, and whether a row has neither cost nor consumption."""
    cost = first_existing(
        rollup.columns, ("TotalEffectiveCost", "TotalBilledCost", "TotalHourlyCost"))
    if cost is None:
        raise ValueError("no cost column")
    amounts = [c for c in (cost, "TotalConsumedQuantity") if c in rollup.columns]
    rows = rollup.withColumns(
        {c: F.coalesce(numbers.number(F.col(c)), F.lit(0.0)) for c in amounts})
    zero = F.lit(True)
    for column in amounts:
        zero = zero & (F.col(column) == 0)
    return rows, zero


def _as_zero_usage(runs: DataFrame, idle_days: int) -> DataFrame:
    hours = F.col("ConsecutiveZeroHours")
    return runs.filter(hours >= idle_days * 24).withColumns({
        "UnusedReason": F.concat(F.lit("Zero-Usage-"), hours.cast("string"), F.lit("h")),
        "DetectionMethod": F.lit("Consecutive_Zero"),
        "WastedCost": F.lit(0.0),
    })


def zero_usage_streaks(rollup: DataFrame, idle_days: int = fixed.IDLE_DAYS,
                       gap_aware: bool = False) -> DataFrame:
    """Resources with a run of rows without cost and consumption of ``idle_days`` or more.

    Cost is the first of effective, billed and hourly cost the table has; missing
    amounts count as 0.  Clouds are not separated.
    """
    rows, zero = _zero_rows(rollup)
    kept = [c for c in rows.columns if c not in ("ResourceId", STRETCH, *LAYOUT)]
    runs = longest_runs(rows, {"ConsecutiveZeroHours": zero}, keep_last=kept, gap_aware=gap_aware)
    return _as_zero_usage(runs, idle_days)


def unused_resources(rollup: DataFrame, idle_days: int = fixed.IDLE_DAYS) -> DataFrame:
    """Both rollup-level rules, one row per resource; commitment rows win.

    One pass: the earliest commitment row of each resource is carried along with its
    runs.  Commitment rows without a resource collapse into one.
    """
    require_columns(rollup, ("CommitmentDiscountStatus",))
    rows, zero = _zero_rows(rollup)
    names = [c for c in rows.columns if c not in (STRETCH, *LAYOUT)]
    kept = [c for c in names if c != "ResourceId"]
    # Rows are ordered with their own amounts, not with those filled in for the runs.
    given = rollup.select(*names)
    order = F.struct(*_total_order(names), *_others_last(names, ["ResourceId"]))
    rows = rows.withColumn("_given", F.when(_is_unused_commitment(), F.struct(*[F.col(c) for c in kept])))
    first = F.when(_is_unused_commitment(), F.struct(order.alias("at"), F.col("_given").alias("row")))
    runs = longest_runs(rows, {"ConsecutiveZeroHours": zero}, keep_last=kept, carried={"_commitment": (first, F.min)})

    has = F.col("_commitment").isNotNull()
    runs = runs.filter(has | (F.col("ResourceId").isNotNull() & (F.col("ConsecutiveZeroHours") >= idle_days * 24)))
    cost = first_existing(given.columns, ("TotalHourlyCost", "TotalEffectiveCost"))
    row = {c: F.when(has, F.col("_commitment.row")[c]).otherwise(F.col(c)) for c in kept}
    hours = F.when(~has, F.col("ConsecutiveZeroHours"))
    picked = runs.select("ResourceId", *[value.alias(c) for c, value in row.items()], hours.alias("ConsecutiveZeroHours"),
                         F.when(~has, F.col("RowCount")).alias("RowCount"))
    commitment = F.col("ConsecutiveZeroHours").isNull()
    wasted = F.when(commitment, F.coalesce(numbers.number(F.col(cost)), F.lit(0.0))).otherwise(0.0) if cost else F.lit(0.0)
    if cost:
        picked = picked.withColumn(cost, F.when(commitment, F.coalesce(numbers.number(F.col(cost)), F.lit(0.0))).otherwise(F.col(cost)))
    return picked.withColumns({
        "UnusedReason": F.when(commitment, "Commitment-Unused").otherwise(
            F.concat(F.lit("Zero-Usage-"), F.col("ConsecutiveZeroHours").cast("string"), F.lit("h"))),
        "DetectionMethod": F.when(commitment, "CommitmentStatus").otherwise("Consecutive_Zero"),
        "WastedCost": wasted})


def commitment_stats(commitments: DataFrame) -> DataFrame:
    """Rows and effective cost per commitment type."""
    return (
        commitments.filter(F.col("CommitmentDiscountType").isNotNull())
        .groupBy("CommitmentDiscountType")
        .agg(F.count("ResourceId").alias("Count"),
             numbers.sum_or_zero(F.col("EffectiveCost")).alias("Cost")))


def top_commitments(unused: DataFrame, n: int = 10) -> DataFrame:
    """Commitment rows with the highest waste; ties by resource, then time, names and amounts."""
    return (
        unused.filter(F.col("UnusedReason") == "Commitment-Unused")
        .orderBy(F.desc("WastedCost"), "ResourceId", *_total_order(unused.columns)).limit(n))


def zero_usage_sample(unused: DataFrame, n: int = 10) -> DataFrame:
    """The first zero-usage rows by resource, then time, names and amounts."""
    return (
        unused.filter(F.col("UnusedReason") == "Zero-Cost-Zero-Usage")
        .orderBy("ResourceId", *_total_order(unused.columns)).limit(n))


def unused_stats(rollup: DataFrame, idle_days: int = fixed.IDLE_DAYS) -> DataFrame:
    """Per condition: findings by cloud, in all, and in percent of all rollup rows.

    Counted before the rules are merged into one row per resource.  One pass:
    commitment rows are counted along with the runs.
    """
    require_columns(rollup, ("CommitmentDiscountStatus",))
    rows, zero = _zero_rows(rollup)
    clouds = {c.lower(): text.matches_cloud(F.col("ProviderName"), c) for c in ("GCP", "AWS")}
    counted = {"all": F.lit(True), **clouds}
    unused = F.coalesce(_is_unused_commitment(), F.lit(False))
    hours = hours_each(rollup).cast("bigint")
    carried = {f"_commitment_{n}": (F.when(unused & F.coalesce(c, F.lit(False)), hours).otherwise(0), F.sum) for n, c in counted.items()}
    runs = longest_runs(rows, {"_zero": zero}, keep_last=["ProviderName"], carried=carried)
    idle = F.col("ResourceId").isNotNull() & (F.col("_zero") >= idle_days * 24)
    sums = runs.agg(
        F.coalesce(F.sum("RowCount"), F.lit(0)).alias("rollup_rows"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in carried],
        *[F.count_if(idle & c).alias(f"_streak_{n}") for n, c in counted.items()])
    one = lambda condition, kind: F.struct(
        F.lit(condition).alias("condition"), *[F.col(f"_{kind}_{n}").alias(n if n != "all" else "total") for n in ("gcp", "aws", "all")])
    return sums.select("rollup_rows", F.inline(F.array(one("commitment_unused", "commitment"), one("zero_usage", "streak")))).select(
        "condition", "gcp", "aws", "total", "rollup_rows", numbers.share_percent(F.col("total"), F.col("rollup_rows")).alias("percent"))


def free_charge_overview(charges: DataFrame) -> DataFrame:
    """One row: billed and free charges, and how much the free ones consumed."""
    free = F.col("BilledCost") == 0
    quantity = F.when(free, F.col("ConsumedQuantity"))
    median = exact_quantiles(charges.filter(free), [], "ConsumedQuantity", {"m": 0.5}).scalar()
    return charges.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("BilledCost") > 0).alias("billed_rows"),
        F.count_if(free).alias("free_rows"),
        F.avg(quantity).alias("quantity_mean"),
        F.min(quantity).alias("quantity_min"),
        F.max(quantity).alias("quantity_max"),
        F.stddev_samp(quantity).alias("quantity_std"),
        F.count_if(quantity == 0).alias("zero_quantity_rows"),
        F.count_if(quantity > 0).alias("used_quantity_rows"),
    ).withColumns({
        "free_percent": numbers.share_percent(F.col("free_rows"), F.col("total_rows")),
        "quantity_median": median,
    })


def free_charge_words(charges: DataFrame) -> DataFrame:
    """How many free charges mention each explaining word, as (keyword, matches)."""
    free = charges.filter(F.col("BilledCost") == 0)
    description = F.lower(F.col("ChargeDescription"))
    counts = free.agg(*[
        F.count_if(F.coalesce(description.contains(F.lit(word)), F.lit(False))).alias(f"w{i}")
        for i, word in enumerate(fixed.FREE_CHARGE_WORDS)])
    pairs = F.array(*[F.struct(F.lit(word).alias("keyword"), F.col(f"w{i}").alias("matches"))
                      for i, word in enumerate(fixed.FREE_CHARGE_WORDS)])
    return counts.select(F.inline(pairs))


def tag_detections(found: DataFrame, pattern: str, provider: Column | None = None) -> DataFrame:
    """Mark findings with their cloud and the rule that made them."""
    cloud = provider if provider is not None else F.col("ProviderName")
    return found.withColumns({"CloudProvider": cloud, "PatternType": F.lit(pattern)})
