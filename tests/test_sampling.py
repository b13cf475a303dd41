"""Splits of exact size against sorting everything, however deep the cut is looked for."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from idlespan.operators import sampling


def plain(rows, fraction, min_rows, most):
    """Rows of each stratum in the order of their hashes; a cut may fall inside the copies of one."""
    out, strata = {}, {}
    for s, k, copies in rows:
        strata.setdefault(s, []).append((hashlib.md5(f"42|{k}".encode()).hexdigest(), k, copies))
    for s, own in strata.items():
        n = sum(c for _, _, c in own)
        room = n if n < min_rows else int(n * fraction)
        room = min(room, most) if most is not None else room
        for _, k, copies in sorted(own):
            out[s, k] = min(room, copies)
            room -= out[s, k]
    return out


@pytest.mark.parametrize("sorted_rows", [100_000, 20, 1])
@pytest.mark.parametrize("fraction, min_rows, most", [(0.8, 0, None), (0.5, 40, None), (1.0, 0, 300)])
def test_splits_equal_sorting(spark, monkeypatch, sorted_rows, fraction, min_rows, most):
    monkeypatch.setattr(sampling, "SORTED_ROWS", sorted_rows)
    # Few digits first, so that even small strata are looked into several times.
    monkeypatch.setattr(sampling, "_DIGITS", 1)
    draw = random.Random(5)
    rows = [(s, f"{s}{i}", draw.randint(1, 4)) for s, n in (("large", 900), ("small", 30), (None, 60), ("one", 1)) for i in range(n)]
    table = spark.createDataFrame(rows, "s string, k string, copies bigint")
    made = sampling.hash_split(table, by=[F.col("k")], strata=["s"], train_fraction=fraction, min_rows=min_rows, max_train_rows=most).collect()
    assert {(r.s, r.k): r.train_copies for r in made} == plain(rows, fraction, min_rows, most)
    assert all(r.train_copies + r.test_copies == r.copies for r in made)
    whole = sampling.hash_split(table, by=[F.col("k")], train_fraction=fraction, min_rows=min_rows, max_train_rows=most).collect()
    assert {("x", r.k): r.train_copies for r in whole} == plain([("x", k, c) for _, k, c in rows], fraction, min_rows, most)


def test_split_of_nothing(spark):
    none = spark.createDataFrame([], "s string, k string, copies bigint")
    assert sampling.hash_split(none, by=[F.col("k")], strata=["s"]).count() == sampling.hash_split(none, by=[F.col("k")]).count() == 0
