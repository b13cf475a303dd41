"""The registered queries over the smallest tables: with their SQL, or against brute force."""

import base64
import hashlib
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from compare import difference
from idlespan.llm.queries import ORACLES, QUERIES
from idlespan.session import written
from tests.llm.test_duplicates import joined, simhash_of
from tests.llm.test_texts import counted

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    assert difference(QUERIES[name](spark, FOLDER), database.sql(ORACLES[name])) is None


@pytest.mark.parametrize("name", ["op2_quality_classifier", "op6_toxicity", "op11_sharding"])
def test_query_has_every_row(spark, database, name):
    ids = sorted(r.doc_id for r in QUERIES[name](spark, FOLDER).collect())
    assert ids == sorted(r[0] for r in database.sql("SELECT doc_id FROM documents").fetchall())


def documents(database):
    return {i: t or "" for i, t in database.sql("SELECT doc_id, text FROM documents").fetchall()}


def library(name):
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return lambda text: found.encode(text, add_special_tokens=False).ids


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_archives_hold_every_page(spark, database, tmp_path):
    """With pages whose payloads are equal, empty and null."""
    rows = database.sql("SELECT page_id, url, html FROM pages").fetchall()
    rows += [(10_000 + i, url, html) for i, (_, url, html) in enumerate(rows[:7])]
    rows += [(20_000 + i, "http://a/", None) for i in range(3)] + [(20_003, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(i, last.get(html or "", i))
    expected = set()
    for i, _, html in rows:
        payload, keeper = (html or "").encode(), last[html or ""]
        expected.add((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                      "response" if i == keeper else "revisit", None if i == keeper else keeper))
    found = QUERIES["op1_warc"](spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))


def test_token_totals_equal_library(spark, database):
    rows = database.sql("""SELECT doc_id, source, lang, coalesce(text, ''), quality, toxic FROM documents LEFT JOIN
        (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)""").fetchall()
    count, totals = {n: library(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k")}, Counter()
    documents = Counter()
    for _, source, lang, text, quality, toxic in rows:
        if toxic != 1:
            name = "word_bpe_49k" if quality == 0 else "byte_bpe_50k"
            documents[source, lang, name] += 1
            totals[source, lang, name] += len(count[name](text))
    found = {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in QUERIES["op4_token_counts"](spark, FOLDER).collect()}
    assert found == {k: (documents[k], totals[k]) for k in documents} and len({k[2] for k in found}) == 2


def test_ids_equal_library(spark, database):
    ids, texts = library("byte_bpe_50k.json"), documents(database)
    found = QUERIES["op5_bpe_round_trip"](spark, FOLDER).collect()
    assert len(found) == len(texts)
    for r in found:
        own = ids(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(own), digest(",".join(map(str, own)))) and r.decoded_sha256 == digest(texts[r.doc_id])


def test_near_duplicates_equal_all_pairs(spark, database):
    texts = documents(database)
    ids = sorted(texts)
    values = [simhash_of(texts[i]) & (2 ** 64 - 1) for i in ids]
    roots = joined(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2])
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash_near_dedup"](spark, FOLDER).collect()}
    assert found == {i: (f"{v:016x}", ids[r]) for i, v, r in zip(ids, values, roots)}


def test_rules_equal_plain_counts(spark, database):
    found = QUERIES["op9_quality_rules"](spark, FOLDER).collect()
    own = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found}
    assert own == {(i, *counted(t)) for i, t in documents(database).items()}
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in found)
    assert all(r.kept == (not r.base_failed and r.log_ratio >= -0.25) for r in found)


def gapless(pieces, key):
    """Pieces of every sequence lie side by side from 0, and of every example likewise."""
    for of, begin in (("sequence_id", "offset"), (key, "start")):
        ends = Counter()
        for p in sorted(pieces, key=lambda p: (p[of], p[begin])):
            assert p[begin] == ends[p[of]]
            ends[p[of]] += p.length
    return Counter({p.sequence_id: 0 for p in pieces}) + Counter()


def test_packed_documents_hold_every_token(spark, database):
    ids, texts = library("word_bpe_49k.json"), documents(database)
    pieces = QUERIES["op10_packing"](spark, FOLDER).collect()
    gapless(pieces, "doc_id")
    whole = {i: [*ids(t), 1] for i, t in texts.items()}
    for p in pieces:
        own = np.array(whole[p.doc_id][p.start:p.start + p.length], "<u4")
        assert p.ids_crc32 == zlib.crc32(own.tobytes()) and p.doc_tokens == len(whole[p.doc_id])
    held = Counter()
    for p in pieces:
        held[p.sequence_id] += p.length
    assert sum(held.values()) == sum(map(len, whole.values())) and max(held.values()) <= 2048


def test_packed_chats_hold_every_token_under_all_limits(spark, database):
    """Text of a conversation and its flags by the library, segment by segment; each limit stops some sequence."""
    ids = library("byte_bpe_50k.json")
    chats = {}
    for c, _, role, text in database.sql("""SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations ORDER BY conv_id, turn NULLS FIRST, role, text""").fetchall():
        escape = lambda x: x.replace("\\", "\\\\").replace("<|", "<\\|")
        for part, loss in ((f"<|im_start|>{escape(role)}\n", False), (escape(text), role == "assistant"), ("<|im_end|>\n", False)):
            chats.setdefault(c, []).extend((i, loss) for i in ids(part))
    pieces = QUERIES["packed_chats"](spark, FOLDER).collect()
    gapless(pieces, "conv_id")
    assert {p.conv_id for p in pieces} == set(chats)
    sums = {}
    for p in pieces:
        own = chats[p.conv_id][p.start:p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array([i for i, _ in own], "<u4").tobytes())
        assert (p.loss_tokens, p.doc_tokens) == (sum(f for _, f in own), len(chats[p.conv_id]))
        s = sums.setdefault(p.sequence_id, [0, 0, 0])
        for at, more in enumerate((p.length, 1, p.loss_tokens)):
            s[at] += more
    assert sum(s[0] for s in sums.values()) == sum(map(len, chats.values()))
    assert all(s[0] <= 2048 and s[1] <= 4 and s[2] <= 768 for s in sums.values())
    assert any(s[1] == 4 for s in sums.values()) and any(s[2] > 760 for s in sums.values())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, FOLDER))
        assert after.columns == columns
        assert after.count() > 0 and after.exceptAll(docs).count() == 0
        docs = after
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    assert docs.groupBy(normal.alias("t")).count().where("count > 1").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, FOLDER).count() == pieces.count()


def test_pipeline_on_no_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
