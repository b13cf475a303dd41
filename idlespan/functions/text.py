"""Keyword rules over names and descriptions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from idlespan import fixed_values as fixed

Rules = Sequence[tuple[str, Sequence[str]]]


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True when the lower-cased text holds any word; null text gives False."""
    lowered = F.lower(text)
    hits = reduce(lambda a, b: a | b, [lowered.contains(F.lit(w)) for w in words])
    return F.coalesce(hits, F.lit(False))


def first_label(text: Column, rules: Rules, default: str) -> Column:
    """Label of the first rule with a word in the text, else ``default``."""
    chain = None
    for label, words in rules:
        hit = contains_any(text, words)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(F.lit(default))


def raw_resource_type(service: Column) -> Column:
    return first_label(service, fixed.RAW_RESOURCE_TYPES, "Other")


def service_category(service: Column) -> Column:
    return first_label(service, fixed.SERVICE_CATEGORIES, "Other")


def service_category_with_fallback(service: Column) -> Column:
    """The category list, then the generic words; used to train and to score."""
    rules = tuple(fixed.SERVICE_CATEGORIES) + tuple(fixed.GENERIC_CATEGORIES)
    return first_label(service, rules, "Other")


def classifier_resource_type(service: Column) -> Column:
    known = first_label(service, fixed.CLASSIFIER_RESOURCE_TYPES, "Other")
    return F.when(service.isNull(), "Unknown").otherwise(known)


def boosting_resource_type(service: Column) -> Column:
    return first_label(service, fixed.BOOSTING_RESOURCE_TYPES, "Other")


def is_compute_service(service: Column) -> Column:
    return contains_any(service, fixed.COMPUTE_WORDS)


def matches_cloud(provider: Column, cloud: str) -> Column:
    return contains_any(provider, fixed.CLOUD_WORDS[cloud])


def plain_number_text(value: Column) -> Column:
    """A double as text without an exponent between 1e-4 and 1e16.

    Spark switches to exponents at 1e-3 and 1e7; outside the wider range its own
    notation is kept.
    """
    text = value.cast("string")
    size = F.abs(value)
    exponent_range = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    padded = text.try_cast("decimal(38,20)").cast("string")
    trimmed = F.regexp_replace(padded, r"0+$", "")
    plain = F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)
    return F.when(exponent_range, plain).otherwise(text)
