"""BPE, packing and token counts against the tokenizers library and plain counting."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from idlespan.llm import bpe, packing, token_counts
from idlespan.session import shared_folder
from tests.llm.conftest import ROWS

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
LETTERS = [*" \n\t\r\x0b\x1c\x85\xa0 　'sdtmlreé3١ñ😀中!?<|>_-ABabÀßΣİ", "<|endoftext|>", "'ll", " the", "  ", "é"]


def strange(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def tables():
    return bpe.vocabulary(BYTES)


def test_bpe_equals_library(tables):
    texts = [*strange(4000), *[t or "" for _, t in ROWS], "abc" * 2000, "é" * 900]
    ids, counts = (encoder := bpe._Encoder(tables))(pa.array(texts, pa.large_string()))
    library = Tokenizer.from_file(BYTES)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]
    assert encoder.decode(ids, counts).to_pylist() == [library.decode(e, skip_special_tokens=False) for e in expected]


def test_speculation_is_checked(tables):
    """Greedy matching alone is wrong for some words, and exactly those pairs are found out."""
    words = sorted({"".join(random.Random(i).choices("aeinrst", k=9)).encode() for i in range(500)})
    exact = [tables.merged(w) for w in words]
    ranks, counts = tables.encode_words(words)
    assert ranks.tolist() == [r for e in exact for r in e] and counts.tolist() == [len(e) for e in exact]
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    greedy, n = tables.proposed(flat, ends - [len(w) for w in words], ends)
    wrong = [w for w, e, g in zip(words, exact, np.split(greedy, np.cumsum(n)[:-1])) if g.tolist() != e]
    assert 0 < len(wrong) < len(words)
    assert all(tables.merged_by_heap(w) == e for w, e in zip(words, exact))


def test_bpe_on_odd_rows(odd, none, tables):
    rows = bpe.encode(odd, tables, decoded=True).select("c0", "c1", "ids", "decoded").collect()
    assert len(rows) == len(ROWS) and all(r.decoded == (r.c1 or "") for r in rows)
    again = bpe.decode(bpe.encode(odd, tables), tables).select("c1", "decoded").collect()
    assert all(r.decoded == (r.c1 or "") for r in again)
    assert bpe.encode(none, tables).count() == 0


def test_word_ids_equal_library():
    texts = [*strange(4000, 2), *[t or "" for _, t in ROWS]]
    with open(WORDS, encoding="utf-8") as file:
        ids, counts = packing.WordEncoder(file.read())(pa.array(texts, pa.large_string()), 1)
    expected = [[*e.ids, 1] for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def sequences(pieces):
    found = {}
    for p in pieces:
        found.setdefault(p.sequence_id, []).append(p)
    for own in found.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
    return list(found.values())


def test_packing_keeps_every_token(odd, none):
    rows = packing.pack_texts(odd, WORDS).collect()
    library, expected = Tokenizer.from_file(WORDS), {}
    for i, t in ROWS:
        expected.setdefault(i, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    for i, texts in expected.items():
        own = sorted((r for r in rows if r.c0 == i), key=lambda r: (r.doc_tokens, r.start))
        assert sum(r.length for r in own) * 4 == sum(map(len, texts))
        if len(texts) == 1:
            assert b"".join(r.piece_ids for r in own) == texts[0]
    sizes = [sum(p.length for p in own) for own in sequences(rows)]
    assert max(sizes) <= 2048 and all(n & (n - 1) == 0 for n in sizes)
    assert packing.pack_texts(none, WORDS).count() == 0


def test_packing_under_all_limits(spark):
    shapes = [(3000, 1), (50, 2), (5, 1), (700, 3)] * 20
    rows = [(i, [i] * n, [k % m == 0 for k in range(n)]) for i, (n, m) in enumerate(shapes)]
    rows += [(900, [], []), (901, None, None), (902, [1, 2], None), (903, [1, 2, 3], [True, None, True])]
    df = spark.createDataFrame(rows, "length int, ids array<int>, loss array<boolean>")
    pieces = packing.pack(df, packing.Limits(1024, 6, 300), loss="loss").collect()
    for own in sequences(pieces):
        assert sum(p.length for p in own) <= 1024 and len(own) <= 6 and sum(p.loss_tokens for p in own) <= 300
    for i, ids, loss in rows:
        own = sorted((p for p in pieces if p.c0 == i), key=lambda p: p.start)
        assert b"".join(p.piece_ids for p in own) == np.array(ids or [], "<u4").tobytes()
        assert sum(p.loss_tokens for p in own) == sum(bool(x) for x in loss or [])
        assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()


def test_piece_crc(spark):
    df = spark.createDataFrame([(1, [1, 70000])], "id int, ids array<int>")
    row = packing.pack(df).select(F.crc32("piece_ids").alias("c")).first()
    assert row.c == zlib.crc32(np.array([1, 70000], "<u4").tobytes())


def test_counts_by_deltas(spark):
    columns = "source string, lang string, tokenizer string, n_tokens long, documents string"
    first = spark.createDataFrame([("a", "en", "t1", 5, "x"), ("a", "en", "t1", 7, "x"), (None, "en", "t1", None, "x")], columns)
    gone = spark.createDataFrame([("a", "en", "t1", 5, "x")], columns)
    new = spark.createDataFrame([("b", "en", "t2", 9, "x")], columns)
    rollup = token_counts.Rollup(spark, shared_folder(spark))
    assert rollup.totals().count() == 0
    assert rollup.commit("one", token_counts.inserted(first)) and not rollup.commit("one", token_counts.inserted(first))
    assert rollup.commit("two", token_counts.deleted(gone))
    seven = spark.createDataFrame([("a", "en", "t1", 7, "x")], columns)
    assert rollup.commit("three", token_counts.revised(seven, new)) and not rollup.commit("two", token_counts.deleted(gone))
    assert rollup.commit("four", token_counts.inserted(first.limit(0)))
    assert {tuple(r) for r in rollup.totals().collect()} == {(None, "en", "t1", 1, 0), ("b", "en", "t2", 1, 9)}
    assert rollup.batches().count() == 4


def test_snapshots_and_unfinished_writes(spark):
    """Totals stay the same through compaction; what lacks its success mark is neither read nor taken for done."""
    rollup = token_counts.Rollup(spark, shared_folder(spark))
    rows = spark.createDataFrame([("a", "en", "t", n) for n in range(20)], "source string, lang string, tokenizer string, n_tokens long")
    assert rollup.totals().count() == 0
    rollup.compact()
    total = lambda: [tuple(r) for r in rollup.totals().collect()]
    for turn in range(3):
        assert rollup.commit(f"b{turn}", token_counts.inserted(rows))
        expected = [("a", "en", "t", 20 * (turn + 1), 190 * (turn + 1))]
        assert total() == expected
        rollup.compact()
        assert total() == expected and not rollup.commit(f"b{turn}", token_counts.inserted(rows))
    assert len(rollup._since()[1]) == 0 and rollup.batches().count() == 3

    path, root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, rollup.folder
    system = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = total()
    rollup.commit("late", token_counts.deleted(rows))
    part = [p for p in rollup._marked("commits") if p in rollup._since()[1]][0]
    system.delete(path(f"{root}/commits/{part}/_SUCCESS"), False)
    assert total() == before and rollup.batches().count() == 3
    assert rollup.commit("late", token_counts.deleted(rows)) and total() == [("a", "en", "t", 40, 380)]
    rollup.compact()
    newest = rollup._marked("snapshot_parts")[-1]
    system.delete(path(f"{root}/snapshot_parts/{newest}/_SUCCESS"), False)
    assert total() == [("a", "en", "t", 40, 380)]
    rollup.compact()
    assert rollup._marked("snapshot_parts")[-1] == newest and total() == [("a", "en", "t", 40, 380)]


@pytest.mark.parametrize("count, vocabulary", [
    (token_counts.byte_bpe_counts, "byte_bpe_50k.json"), (token_counts.word_bpe_counts, "word_bpe_49k.json")])
def test_counts_equal_library(odd, none, count, vocabulary):
    library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    library.no_truncation()
    library.no_padding()
    rows = count(odd, public_tokenizers.path(vocabulary)).collect()
    assert len(rows) == len(ROWS)
    assert all(r.n_tokens == len(library.encode(r.c1 or "", add_special_tokens=False).ids) for r in rows)
    assert count(none, public_tokenizers.path(vocabulary)).count() == 0


def test_uncommitted_batch_does_not_count(spark):
    rollup = token_counts.Rollup(spark, shared_folder(spark))
    counts = spark.createDataFrame([("a", "en", "t", 5)], "source string, lang string, tokenizer string, n_tokens long")
    rollup.commit("one", token_counts.inserted(counts))
    # A crash after the sums are stored and before the commit.
    token_counts.inserted(counts).groupBy("source", "lang", "tokenizer").agg(
        F.sum("sign").alias("documents"), F.sum("n_tokens").alias("tokens")).withColumn("part", F.lit("lost")).write.parquet(
        f"{rollup.folder}/deltas/lost")
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 1, 5)]
