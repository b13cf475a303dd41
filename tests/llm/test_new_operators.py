"""Sharding, prefix tries and hard negatives against brute force."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from idlespan.llm import negatives, prefix_trie, sharding


# Sharding

@pytest.mark.parametrize("settings", [{}, {"block_rows": 3}], ids=["one block", "several blocks"])
@pytest.mark.parametrize("shards", [1, 5, 40])
def test_shards_are_exact_and_gapless(odd, shards, settings):
    rows = sharding.sharded(odd, shards, **settings)
    assert rows.columns == [*[f"c{i}" for i in range(len(odd.columns))], "shard", "slot"]
    made = rows.collect()
    assert Counter(repr(tuple(r)[:-2]) for r in made) == Counter(repr(tuple(r)) for r in odd.collect())
    slots = {}
    for r in made:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_of_nothing_and_of_a_changed_table(none, odd):
    assert sharding.sharded(none, 4).count() == 0
    with pytest.raises(ValueError):
        sharding.sharded(odd, 0)


def test_blocks_of_many_rows_follow_each_other(spark):
    rows = sharding.sharded(spark.range(0, 5000, 1, 7), 3, block_rows=100, store=False)
    found = rows.groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("last"), F.count(F.lit(1)).alias("rows"))
    assert sorted(tuple(r)[1:] for r in found.collect()) == [(1666, 1665, 1666), (1667, 1666, 1667), (1667, 1666, 1667)]
    # The same seed gives the same places, another one others.
    again = sharding.sharded(spark.range(0, 5000, 1, 7), 3, block_rows=100, store=False)
    assert rows.exceptAll(again).count() == 0
    other = sharding.sharded(spark.range(0, 5000, 1, 7), 3, block_rows=100, store=False, seed=3)
    assert other.join(rows, ["c0", "shard", "slot"]).count() < 50


def test_matrix_rows_and_columns_add_up():
    counts, sizes = [5, 0, 17, 1, 300, 2, 40], sharding.shard_sizes(365, 9)
    matrix = sharding.Matrix(np.concatenate([[0], np.cumsum(counts)]), sizes, 2, 11)
    rows = [matrix.row(p) for p in range(len(counts))]
    assert [r.sum() for r in rows] == counts and (sum(rows) == sizes).all()
    for p, row in enumerate(rows):
        dealt = list(matrix.deals(p))
        shards = np.concatenate([d[0] for d in dealt]) if dealt else np.zeros(0, int)
        assert (np.bincount(shards, minlength=9) == row).all()


def test_every_dealing_is_equally_likely():
    """Six rows in partitions of 1, 2 and 3 rows, two shards of three rows: all 20 ways, each about as often."""
    seen = Counter()
    for seed in range(6000):
        matrix = sharding.Matrix(np.array([0, 1, 3, 6]), np.array([3, 3]), 1, seed)
        seen[tuple(int(s) for p in range(3) for d in matrix.deals(p) for s in d[0])] += 1
    assert len(seen) == 20
    assert sum((n - 300) ** 2 / 300 for n in seen.values()) < 43.8  # chi squared, 19 degrees of freedom, 0.1 %


def test_large_hypergeometric_draws(monkeypatch):
    """The way for populations beyond numpy's limit has the distribution of numpy's own draws."""
    draw = np.random.default_rng(5)
    monkeypatch.setattr(sharding, "_NUMPY_LIMIT", 0)
    good, bad, sample, n = 300, 700, 200, 4000
    found = np.array([sharding.hypergeometric(draw, good, bad, sample) for _ in range(n)])
    weight = lambda k: math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample)
    edges = [0, 51, 54, 57, 59, 61, 63, 66, 69, 201]
    expected = np.array([n * sum(weight(k) for k in range(a, b)) for a, b in itertools.pairwise(edges)])
    counts = np.histogram(found, edges)[0]
    assert ((counts - expected) ** 2 / expected).sum() < 26.1  # 8 degrees of freedom, 0.1 %
    monkeypatch.undo()
    huge = sharding.split(draw, np.array([3 * 10 ** 10, 10 ** 10, 5]), 2 * 10 ** 10)
    assert huge.sum() == 2 * 10 ** 10 and abs(huge[0] - 1.5 * 10 ** 10) < 10 ** 6


def test_sharding_puts_copies_everywhere(spark):
    """A third of all rows are the same: shards keep their sizes, and each gets about its part of the copies."""
    rows = spark.range(0, 3000, 1, 5).select(F.when(F.col("id") < 1000, F.lit("copy")).otherwise(F.col("id").cast("string")).alias("text"))
    found = sharding.sharded(rows, 10).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c0") == "copy").alias("copies")).collect()
    assert [r.n for r in found] == [300] * 10 and all(60 < r.copies < 140 for r in found)


# Prefix tries

def trie_of(conversations):
    """Plain: every prefix of every rebuilt conversation."""
    said = {}
    for conv_id, turns in conversations.items():
        base = conversations.get(conv_id - int(math.fmod(conv_id, 100)), [])
        h = zlib.crc32(str(conv_id).encode()) % 6
        said[conv_id] = tuple(base[:h] + turns[h:])
    members, children, nodes = {}, {}, []
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
            if d:
                children.setdefault(turns[:d - 1], set()).add(turns[:d])
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        saved[p] = own + sum(saved[c] for c in children.get(p, ()))
        leaves[p] = sum(leaves[c] for c in children.get(p, ())) or 1
        ends = ",".join(str(c) for c in sorted(members[p]) if said[c] == p)
        nodes.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]),
                      len(children.get(p, ())), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(nodes, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def made_trie(spark, rows, **settings):
    # Extra columns whose names clash with results and inner names.
    table = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("path"), F.lit("x").alias("Depth"), F.lit(2).alias("base"))
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.rebuilt(table), **settings).collect()), key=repr)


def grouped(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in out.items()}


@pytest.mark.parametrize("most", [1 << 9, 12, 1], ids=["in tasks", "partly", "in Spark"])
def test_trie_equals_every_prefix(spark, most):
    draw, rows = random.Random(4), []
    for c in [*range(0, 130, 3), *range(200, 230), 451, 452, -1, -205]:
        for turn in range(draw.choice([1, 2, 3, 4, 7, 9, 12])):
            rows.append((c, turn, ["user", "assistant"][turn % 2], draw.choice(["", "yes", "so", "ähm 😀"])))
    rows += [(300, None, None, None), (300, 1, "user", "a"), (300, 1, "user", "a"), (300, 1, "assistant", "b"), (None, 0, "user", "x"),
             (301, 0, "user", "word " * 4000), (500, 0, "us", "er"), (501, 0, "u", "ser")]
    # A third of all conversations are copies of one.
    rows += [(c, turn, "user", "same") for c in range(1000, 1060) for turn in range(8)]
    assert made_trie(spark, rows, subtree_ends=most) == trie_of(grouped(rows))


def test_trie_of_a_long_conversation_and_of_nothing(spark):
    rows = [(100, turn, "user", str(turn)) for turn in range(700)] + [(101, turn, "user", str(turn)) for turn in range(650)]
    assert made_trie(spark, rows) == trie_of(grouped(rows))
    assert made_trie(spark, []) == []
    # A turnless conversation: its lender is absent and it has no turns after its first h.
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0)
    assert made_trie(spark, [(lone, 0, "user", "x")]) == trie_of({lone: [("user", "x")]})
    assert made_trie(spark, [(lone, 0, "user", "x")])[0][:4] == (lone, 0, None, 1)


# Hard negatives

def mined_of(rows):
    """Plain Python integers."""
    taken = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        label = (label + 1) % 10 if i % 7 == 0 else label
        key = (label, np.array(whole, dtype="<i4").tobytes())
        if i not in taken or key < taken[i][0]:
            taken[i] = (key, label, whole)
    score = lambda a, b: sum(x * y for x, y in zip(taken[a][2], taken[b][2]))
    out = []
    for a in taken:
        if a % 50:
            continue
        order = sorted((-score(a, b), b) for b in taken if b != a)
        alike = [(b, -s) for s, b in order if taken[b][1] == taken[a][1]][:5]
        for p, ps in alike:
            window = [(b, -s) for s, b in order if taken[b][1] != taken[a][1] and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(a, p, n, b, ps, s) for n, (b, s) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, **settings):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select(
        "*", F.lit(1).alias("Norm"), F.lit("x").alias("vector"), F.lit(3).alias("row_block"))
    whole = negatives.whole_vectors(table, relabel=(7, 10))
    return sorted(tuple(r) for r in negatives.hard_negatives(whole, F.col("vec_id") % 50 == 0, **settings).collect())


@pytest.mark.parametrize("settings", [{}, {"block_rows": 40, "block_anchors": 3}], ids=["one block", "blocks"])
def test_negatives_equal_plain_integers(spark, settings):
    draw = random.Random(2)
    rows = [(i, [draw.uniform(-1, 1) + (0.4 if j < 4 else 0) for j in range(8)], draw.randrange(3)) for i in range(400)]
    rows += [(i, [0.5] * 8, i % 3) for i in range(400, 600)]  # a third of all vectors are the same: ties by id
    rows += [(600, None, 1), (650, [1.0, None], 1), (700, [float("nan")] * 8, 1), (750, [0.5] * 8, None), (None, [0.5] * 8, 1),
             (800, [], 1), (801, [0.5, 0.5], 1), (900, [float("inf")] * 8, 0), (1000, [0.25] * 90, 2), (1001, [0.25] * 90, 2)]
    rows += [rows[50], rows[51], (52, [0.5] * 8, 0)]  # repeated rows, and an id with two vectors
    assert mined(spark, rows, **settings) == mined_of(rows)


def test_negatives_without_anchors_or_rows(spark):
    assert mined(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []
    assert mined(spark, [(50, [0.5], 1)]) == []
    assert mined(spark, []) == []


@pytest.mark.parametrize("size", [1, 200, 40_000, 8_000_000])
def test_products_by_residues_are_exact(size):
    draw = np.random.default_rng(size)
    a, b = draw.integers(-size, size + 1, (30, 150)), draw.integers(-size, size + 1, (50, 150))
    a[0], b[0], b[1] = size, size, -size
    bound = 150 * size * size
    primes = negatives.primes_for(bound)
    made = negatives.residues_product([negatives.centred(a, p) for p in primes], [negatives.centred(b, p) for p in primes], primes)
    assert (made == a @ b.T).all() and math.prod(primes) > 2 * bound + 1


def test_scores_that_are_too_large():
    with pytest.raises(ValueError):
        negatives.primes_for(1 << 60)
