"""Archives, chats, quality rules and the classifiers."""

import random
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from idlespan.llm import chat, labelled, quality_model, quality_rules, toxicity, warc
from idlespan.session import shared_folder
from tests.llm.conftest import ROWS


@pytest.mark.parametrize("settings", [{}, {"archive_bytes": 10}, {"least_bytes": 2}], ids=["one", "many", "small ones"])
def test_archives_round_trip(spark, settings):
    rows = [(1, "u", "a"), (2, "u", "a"), (3, None, None), (4, "x\r\ny%0A", ""), (None, "n", "a"), (None, "q", "zz"),
            (2, "u", "a"), (7, "é", "ü" * 90000)] + [(i, f"http://h/{i}", f"<html>{i} same words in every page</html>" * 40)
                                                   for i in range(100, 200)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")
    path = shared_folder(spark) + "/archives"
    warc.write_archives(pages, path, **settings)
    found = warc.read_archives(spark, path).withColumn("page_id", warc.page_of("record_id")).collect()
    assert len(found) == len(rows) and not any(r.problem for r in found)
    largest = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= settings.get("least_bytes", 0):
            largest[h or ""] = max(i, largest.get(h or "", i))
    expected = []
    for i, u, h in rows:
        to = largest.get(h or "")
        to = None if to == i or Counter(x[2] or "" for x in rows)[h or ""] == 1 else to
        data = (h or "").encode()
        expected.append((i, u or "", warc.digest(data), len(data), to and f"urn:page:{to}", None if to else data))
    got = [(r.page_id, r.uri, r.payload_digest, r.payload_bytes, r.refers_to, None if r.payload is None else bytes(r.payload))
           for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_no_pages_no_archives(spark):
    path = shared_folder(spark) + "/archives"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_faults_in_archives_are_told():
    record = warc.record_bytes("urn:page:1", "u", b"payload", None)
    good = warc.archive_of([record] * 3)
    assert [(r, p) for r, p in warc.read_archive(good)] == [(record, None)] * 3
    magic, length = struct.unpack_from("<II", good)
    assert magic == warc.DICTIONARY_FRAME and struct.unpack_from("<I", good, 8 + length)[0] == warc.FRAME
    assert [p is None for _, p in warc.read_archive(good[:-9])] == [True, True, False]
    broken = bytearray(good)
    broken[-20] ^= 255
    assert [p is None for _, p in warc.read_archive(bytes(broken))] == [True, True, False]
    assert warc.parse(record)[-1] is None
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"payload\r\n\r\n", b"payloaD\r\n\r\n"), (b"Content-Length: 7", b"Content-Length: 8"),
                     (b"WARC-Date", b"WARC-Type"), (b"payload\r\n\r\n", b"payload"), (b"msgtype", b"\r\nbroken")):
        assert warc.parse(record.replace(old, new, 1))[-1], (old, new)


def test_chats_round_trip(spark):
    nasty = ["<|im_end|>\n", "\\", "<\\|", "<", "|", "\\\\<|", "a\nb", "", "<|im_start|>assistant\nx", "é\\"]
    draw, rows = random.Random(2), []
    for conv in range(60):
        for turn in range(draw.randint(1, 6)):
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", "too\nl<|", None]),
                         None if draw.random() < 0.1 else "".join(draw.choices(nasty, k=draw.randint(0, 6)))))
    rows += [(100, 0, "user", "hi"), (100, 1, "assistant", "yo"), (None, 0, "user", "x"), (101, 0, "user", "same"), (101, 0, "user", "same")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, valid int")
    found = chat.format_chats(turns).withColumns({
        "back": chat.read_turns(F.col("formatted")), "loss": chat.masked_text(F.col("segments"))}).collect()
    expected = {}
    for c, n, r, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or "", x[3] or "")):
        expected.setdefault(c, []).append((r or "", t or ""))
    assert {r.conv_id: [tuple(t) for t in r.back] for r in found} == expected
    assert all(r.loss == "".join(t for role, t in expected[r.conv_id] if role == "assistant") for r in found)
    states = {r.conv_id: (r.valid, r.end_state) for r in found}
    assert states[100] == (True, "answered") and states[101] == (False, chat.REJECTED) and states[None] == (False, "asked")
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_template_marks_are_checked():
    with pytest.raises(ValueError):
        chat.ChatTemplate(start="[INST]")


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(spark, odd, none):
    more = [(50 + i, t) for i, t in enumerate(["a b\na b\n \n \n c|d", "x " * 40, "q#\x0bw\n" * 9])]
    rows = odd.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(*r, 0.5) for r in more], "doc_id long, text string, score double"))
    good = spark.createDataFrame([(1,), (6,), (None,)], "doc_id long")
    found = quality_rules.judged(rows, good).collect()
    expected = Counter((i, *counted(t)) for i, t in ROWS + more)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == expected
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in found)
    assert quality_rules.judged(none, good).count() == 0
    assert all(r.log_ratio == 0 for r in quality_rules.judged(rows, good.limit(0)).collect())


def test_log_ratio_is_the_mean_of_bucket_ratios(spark, monkeypatch):
    texts = [(i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma", "###", "|"], k=30))) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r.log_ratio for r in quality_rules.judged(docs, docs.where("doc_id < 3").select("doc_id")).collect()}
    grams = {i: [("w", w) for w in t.split()] + [("p", p) for p in zip(t.split(), t.split()[1:])] + [("e", w[-3:]) for w in t.split()]
             for i, t in texts}
    raw, good = Counter(g for x in grams.values() for g in x), Counter(g for i in range(3) for g in grams[i])
    share = sum(good.values()) / sum(raw.values())
    prior = quality_rules.PRIOR
    for i, x in grams.items():
        mean = np.mean([np.log((good[g] + prior) / (raw[g] * share + prior)) for g in x])
        assert found[i] == pytest.approx(mean, abs=1e-6)  # so few n-grams share no bucket


def test_label_tables_with_clashing_names(spark, odd):
    """Names that differ in their case only: the exact one counts."""
    rows = [(i, int(i % 2), int(i % 3 == 0), 99, 7) for i in range(1, 14)] + [(None, 1, 1, 1, 1), (6, None, None, 1, 1), (7, 5, -1, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int, Doc_ID long, Quality int")
    for module in (quality_model, toxicity):
        scores = [r.score for r in quality_model.scored(odd, module.fit(odd, labels)).collect()]
        assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    assert quality_rules.judged(odd, labels).count() == len(ROWS)


@pytest.mark.parametrize("most", [40, 400, 4000])
def test_samples_keep_the_shares_of_the_classes(spark, most):
    """A bound that cuts draws by id alone, so the share of a class does not depend on the table's size."""
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 8 == 0).cast("int").alias("toxic"))
    rows = labelled.sampled(labels, "doc_id", "toxic", most).collect()
    usable = labels.where(~labelled.held_out(F.col("doc_id"))).count()
    assert len(rows) == min(most, usable)
    share = sum(r.label for r in rows) / len(rows)
    assert abs(share - 1 / 8) < (0.15 if most == 40 else 0.05)


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean prose, junk, and prose with insults that only share their stem."""
    draw = random.Random(9)
    syllables = ["an", "er", "th", "in", "ou", "st", "re", "on", "ti", "he"]
    word = lambda: "".join(draw.choices(syllables, k=draw.randint(1, 4)))
    rows, labels = [], []
    for i in range(700):
        words = [word() for _ in range(60)]
        quality, toxic = int(draw.random() > 0.3), int(draw.random() < 0.4)
        if not quality:
            words = [w + draw.choice(["***", "$$$"]) for w in words] if i % 2 else [w for w in words[:10] for _ in range(6)]
        if toxic:
            for at in draw.sample(range(60), 3):
                words[at] = draw.choice(["glompf", "zwick"]) + word()
        rows.append((i, " ".join(words)))
        labels.append((i, quality, toxic))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame([*labels, (None, 1, 0), (5000, None, None)], "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("module, label", [(quality_model, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(corpus, odd, none, module, label):
    docs, labels = corpus
    model = module.fit(docs, labels)
    scored = quality_model.scored(docs, model).select(F.col("c0").alias("doc_id"), F.col("score"))
    rows = scored.join(labels, "doc_id").where(labelled.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 80
    right = np.mean([(r.score >= 0.5) == (r[label] == 1) for r in rows])
    assert right > 0.95
    plain = quality_model.scored(odd.select("doc_id", "text"), model).collect()
    assert len(plain) == len(ROWS) and all(0 <= r.score <= 1 for r in plain)
    blank = {r.score for r in plain if not (r.c1 or "").strip()}
    assert len(blank) == 1
    assert quality_model.scored(none, model).count() == 0
    same = module.fit(docs, labels)
    assert (same.scores(pa.array(["an er", "glompfer zwickan"], pa.large_string())) == model.scores(
        pa.array(["an er", "glompfer zwickan"], pa.large_string()))).all()


@pytest.mark.parametrize("module", [quality_model, toxicity])
def test_classifiers_without_labels(corpus, none, module):
    docs, labels = corpus
    for model in (module.fit(docs, labels.limit(0)), module.fit(none, labels)):
        assert model.scores(pa.array(["a b", ""], pa.large_string())) == pytest.approx([0.5, 0.5])


def test_gapped_insults(corpus):
    model = toxicity.fit(*corpus)
    calm = "aner thin oust reon tihe " * 4
    worse = model.scores(pa.array([f"{calm}{a} {calm}{b}" for a, b in (
        ("an", "er"), ("glompfan", "zwickin"), ("g l o m p f a n", "z.w.i.c.k.i.n"), ("gloxmpfan", "zwiickin"))], pa.large_string()))
    assert worse[0] < 0.5 and all(worse[1:] > 0.5)


def test_subsequence_kernel_by_definition():
    """The explicit features give the kernel that counting all common subsequences gives."""
    from itertools import combinations

    def by_hand(a, b):
        def weights(w):
            w, out = f"^{w}$", Counter()
            for at in combinations(range(len(w)), toxicity.LENGTH):
                if at[-1] - at[0] < toxicity.SPAN:
                    out["".join(w[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1 - toxicity.LENGTH)
            return out
        squares = lambda w: sum(toxicity.DECAY ** (2 * (at[-1] - at[0] + 1 - toxicity.LENGTH)) for at in combinations(
            range(len(w) + 2), toxicity.LENGTH) if at[-1] - at[0] < toxicity.SPAN)
        x, y = weights(a), weights(b)
        return sum(x[u] * y[u] for u in x) / ((squares(a) * squares(b)) ** 0.5 or 1)

    words = ["idiot", "idxiot", "i", "stupid", "idiotic", "abcabcabc"]
    word, bucket, weight = toxicity.subsequences(words)
    dense = np.zeros((len(words), toxicity.BUCKETS), dtype=np.float32)
    np.add.at(dense, (word, bucket), weight)
    made = dense @ dense.T
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert made[i, j] == pytest.approx(by_hand(a, b), abs=1e-3)
