"""Exact and near duplicates, components, against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from idlespan.llm import exact_dedup, simhash
from idlespan.llm.components import components
from idlespan.llm.frames import picked
from tests.llm.conftest import ROWS


def groups_of(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return groups


@pytest.mark.parametrize("settings", [
    {}, {"capacity": 2}, {"capacity": 2, "key_bits": 3}, {"key_bits": 2, "capacity": 1, "keep_text": False},
    {"key_bits": 0, "keep_text": False}], ids=["plain", "small", "colliding", "overfull", "one key"])
def test_exact_duplicates(odd, settings):
    rows = exact_dedup.exact_duplicates(odd, **settings).select(
        "c0", "keep_id", "group_size", "kept", "text_sha256").collect()
    groups = groups_of(ROWS)
    assert len(rows) == len(ROWS) and sum(r.kept for r in rows) == len(groups)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = sorted((repr(i), repr(least[t]), len(ids)) for t, ids in groups.items() for i in ids)
    assert sorted((repr(r.c0), repr(r.keep_id), r.group_size) for r in rows) == expected
    assert len({r.text_sha256 for r in rows}) == len(groups)


def test_exact_duplicates_of_nothing(none):
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_directory_splits_until_nothing_is_overfull(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key")).unionByName(
        spark.range(200).select(F.col("id").alias("key")))  # 200 keys that share 56 bits
    buckets = exact_dedup.directory(keys, 16)
    rows = exact_dedup.placed(keys, buckets)
    assert rows.count() == 3200
    assert rows.groupBy("low").count().agg(F.max("count")).first()[0] <= 16
    assert buckets.agg(F.max("depth")).first()[0] > 56
    # Every key lies in its bucket's range of keys.
    held = rows.join(buckets, "low").select("key", F.call_function("shiftrightunsigned", "key", F.lit(64) - F.col("depth")).alias("own"), "leading", "depth")
    assert held.where("depth > 0 AND own <> leading").count() == 0


def test_rows_are_found_through_the_directory(spark, monkeypatch):
    """Several depths on some thousand texts; with a bucket taken out of the directory, or wrong ones, results are wrong."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3500).alias("text"))
    seen = []
    whole = exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: seen.append(whole(*a)) or seen[-1])
    made = exact_dedup.exact_duplicates(rows)
    assert made.count() == 4000 and made.where("kept").count() == 3500
    assert seen[0].count() > 12 and seen[0].select("depth").distinct().count() > 1
    least = seen[0].agg(F.min("low")).first()[0]
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: whole(*a).where(F.col("low") != least))
    assert exact_dedup.exact_duplicates(rows).count() < 4000
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: whole(*a).withColumn("leading", F.col("leading") + 1))
    assert exact_dedup.exact_duplicates(rows).count() != 4000


def test_index_entries_lie_in_ranges_of_buckets(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("key"), F.col("id").cast("string").alias("said"), F.struct(F.lit(False), "id", "id").alias("head"))
    buckets = exact_dedup.directory(rows.select("key"), 16)
    index = exact_dedup.build_index(rows, buckets)
    files = index.groupBy(F.input_file_name().alias("file")).agg(F.min("low").alias("a"), F.max("low").alias("b")).orderBy("a").collect()
    assert all(x.b <= y.a for x, y in zip(files, files[1:]))
    assert index.count() == 3000 and index.where("chain <> 0 OR links <> 1 OR n <> 1").count() == 0


def simhash_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def joined(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def test_near_duplicates(odd, none):
    rows = simhash.near_duplicates(odd).select("c0", "c1", F.col("fingerprint").alias("f"), "component_id", "kept").collect()
    assert len(rows) == len(ROWS) and all(r.f == simhash_of(r.c1) for r in rows)
    close = [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if ((a.f ^ b.f) & (2 ** 64 - 1)).bit_count() <= 2]
    roots = joined(len(rows), close)
    for i, r in enumerate(rows):
        own = [rows[j] for j in range(len(rows)) if roots[j] == roots[i]]
        assert r.component_id == min((x.c0 for x in own if x.c0 is not None), default=None)
        assert sum(x.kept for x in own) == 1
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("bits", [0, 2, 4])
def test_links_of_fingerprints(spark, bits):
    """Chains and clusters of fingerprints: the same components as all pairs give."""
    draw = random.Random(5)
    seen = [0, -1, 1 << 62]
    for _ in range(150):
        flips = sum(1 << draw.randrange(64) for _ in range(draw.randint(1, 3)))
        seen.append(((draw.choice(seen) ^ flips) + (1 << 63)) % (1 << 64) - (1 << 63))
    seen = sorted(set(seen))
    made = {r.node: r.root for r in components(simhash.near_pairs(
        spark.createDataFrame([(x,) for x in seen], "fingerprint long"), bits)).collect()}
    values = np.array(seen).view(np.uint64)
    roots = joined(len(seen), [(i, j) for i in range(len(seen)) for j in range(i) if np.bitwise_count(values[i] ^ values[j]) <= bits])
    assert [made.get(x, x) for x in seen] == [seen[r] for r in roots]


def test_components_of_chains_and_hubs(spark):
    draw = random.Random(3)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(140)] + [(i, i + 1) for i in range(1000, 1080)]
    edges += [(2000, i) for i in range(2001, 2200)] + [(5, 5), (None, 3)]
    made = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    roots = joined(2200, [e for e in edges if None not in e])
    assert made == {n: roots[n] for n in {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns_by_role(odd):
    assert picked(odd, doc_id="DOC_ID", name="c0").columns == ["doc_id", "name"]
    with pytest.raises(ValueError):
        picked(odd, doc_id="nothing")
