"""Runnable queries over the test tables, each with equivalent SQL where SQL can say it."""

from catalog import anomalies, conversion, detection, hours, learning, modelling, reporting, storage  # noqa: F401
from catalog.registry import ORACLES, QUERIES  # noqa: F401
