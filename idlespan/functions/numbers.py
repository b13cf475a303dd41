"""Arithmetic shared by detectors and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(column: Column) -> Column:
    """Anything to double; text that is no number becomes null."""
    return column.try_cast("double")


def sum_or_zero(column: Column) -> Column:
    """A sum that is 0, not null, when every value is null."""
    return F.coalesce(F.sum(column), F.lit(0.0))


def waste_percent(usage: Column) -> Column:
    return (F.lit(1.0) - usage) * 100.0


def share_percent(part: Column, whole: Column) -> Column:
    """Part of a positive whole in percent, otherwise 0."""
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based histogram bin; the maximum belongs to the last bin.

    A single-valued column is spread over a unit-wide range around the value.
    """
    flat = high == low
    start = F.when(flat, low - 0.5).otherwise(low)
    width = F.when(flat, F.lit(1.0)).otherwise(high - low) / F.lit(float(bins))
    position = F.floor((value - start) / width)
    return F.least(F.greatest(position, F.lit(0)), F.lit(bins - 1)).cast("int")


def order_code(value: Column) -> Column:
    """A whole number that grows with a number: never falls where the value grows, equal only for nearly equal values.

    Exponent and leading digits of the value's binary form, found by arithmetic.
    Nulls stay null; NaN comes last.
    """
    size = F.abs(value.cast("double"))
    power = F.floor(F.log2(size))
    digits = F.floor((size / F.pow(F.lit(2.0), power) - 1) * 2.0 ** 51)
    code = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(5 * 10 ** 18)).otherwise((power + 1100) * (1 << 51) + digits)
    signed = F.when(value < 0, -code).otherwise(code)
    return F.when(F.isnan(value.cast("double")), F.lit(6 * 10 ** 18)).otherwise(signed).cast("long")
