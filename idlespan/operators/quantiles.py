"""Exact quantiles without gathering a group in one task.

Spark's own exact ``percentile`` keeps every distinct value of a group in one
buffer.  Here equal values are counted first.  A histogram by a value's leading
binary digits says which of its ranges hold a wanted rank; only these are looked
at again, with finer ranges; and only the finest ranges that hold a rank are
sorted.  Ranges are the same for every group, so rows need no table of limits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idlespan.functions.numbers import order_code

#: Bits cut off a value's code: 256 ranges per power of two, then 65,536 in each of those that are looked into.
_COARSE, _FINE = 43, 27


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    quantiles: Mapping[str, float], weight: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per group, one column each.

    Null values are ignored; a group without values has no row.  ``weight`` names an
    integer column saying how often a row counts.  Rows are shuffled once, by group
    and value, each different value of a task once.
    """
    group = [f"_k{i}" for i in range(len(keys))]
    rows = df.filter(F.col(value).isNotNull()).select(
        *[F.col(k).alias(g) for k, g in zip(keys, group)], F.col(value).alias("_v"),
        *([F.col(weight).alias("_w")] if weight else []))
    counted = rows.groupBy(*group, "_v").agg((F.sum("_w") if weight else F.count(F.lit(1))).alias("_c"))
    coded = counted.withColumn("_code", order_code(F.col("_v")))
    coarse = coded.withColumn("_range", F.shiftright("_code", _COARSE))

    held = coarse.groupBy(*group, "_range").agg(F.sum("_c").alias("_held"))
    in_order = Window.partitionBy(*group).orderBy("_range")
    placed = held.withColumns({"_offset": F.sum("_held").over(in_order) - F.col("_held"),
                               "_total": F.sum("_held").over(Window.partitionBy(*group))})
    inside = _looked_into(coarse, placed.filter(_wanted(quantiles)), group, "_offset", "_total")

    fine = inside.withColumn("_part", F.shiftright("_code", _FINE))
    held = fine.groupBy(*group, "_range", "_part").agg(
        F.sum("_c").alias("_held"), F.first("_offset").alias("_offset"), F.first("_total").alias("_total"))
    in_order = Window.partitionBy(*group, "_range").orderBy("_part")
    placed = held.withColumn("_offset", F.col("_offset") + F.sum("_held").over(in_order) - F.col("_held"))
    hit = placed.filter(_wanted(quantiles)).drop("_range").withColumnRenamed("_part", "_range")
    last = _looked_into(coded.withColumn("_range", F.shiftright("_code", _FINE)), hit, group, "_offset", "_total")

    ordered = Window.partitionBy(*group, "_range").orderBy("_v")
    through = F.col("_offset") + F.sum("_c").over(ordered)
    ranked = last.withColumn("_through", through)
    measures = []
    for i, q in enumerate(quantiles.values()):
        measures += [F.min(F.when(F.col("_through") > rank, F.col("_v"))).alias(f"_{end}{i}")
                     for end, rank in zip(("lo", "hi"), _ranks(q))]
    found = ranked.groupBy(*group).agg(F.max("_total").alias("_total"), *measures)
    return found.select(*[F.col(g).alias(k) for k, g in zip(keys, group)], *[
        between(F.col(f"_lo{i}"), F.col(f"_hi{i}"), q, F.col("_total")).alias(name)
        for i, (name, q) in enumerate(quantiles.items())])


def between(low: Column, high: Column, quantile: float, total: Column) -> Column:
    """The quantile from the values at the ranks below and above its place among ``total`` values."""
    place = F.lit(float(quantile)) * (total - 1)
    return low + (high - low) * (place - F.floor(place))


def _ranks(quantile: float) -> tuple[Column, Column]:
    """Ranks (from 0) between which a quantile lies."""
    place = F.lit(float(quantile)) * (F.col("_total") - 1)
    return F.floor(place), F.ceil(place)


def _wanted(quantiles: Mapping[str, float]) -> Column:
    """True of a range that holds one of the wanted ranks."""
    wanted = F.lit(False)
    for q in quantiles.values():
        for rank in _ranks(q):
            wanted = wanted | ((rank >= F.col("_offset")) & (rank < F.col("_offset") + F.col("_held")))
    return wanted


def _looked_into(values: DataFrame, hit: DataFrame, group: Sequence[str], *more: str) -> DataFrame:
    """Values of the ranges in ``hit``, of which a group has two per quantile at most, with what is known of the range."""
    few = hit.select(*[F.col(g).alias(f"{g}h") for g in group], F.col("_range").alias("_rangeh"), *more)
    same = [F.col(g).eqNullSafe(F.col(f"{g}h")) for g in group] + [F.col("_range") == F.col("_rangeh")]
    return values.join(few, same).drop("_rangeh", *[f"{g}h" for g in group])
