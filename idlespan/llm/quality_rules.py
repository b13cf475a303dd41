"""Quality rules without models: counts of each text, and a hashed n-gram likelihood ratio.

Two multinomials over hashed n-grams are estimated, one from trusted documents and
one from the whole corpus.  A document's mean log ratio between them says how much
it reads like the trusted ones.  All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlespan.llm.frames import picked, small
from idlespan.session import written

#: Buckets of single words, of word pairs and of word endings (three characters).
WORDS, PAIRS, ENDINGS = 1 << 14, 1 << 14, 1 << 12
#: Added to both counts of a bucket, so that rare n-grams say little.
PRIOR = 4.0
#: A document whose mean log ratio is lower is turned down.
THRESHOLD = -0.25
#: Words of a window, of which two equal ones are a repetition.
WINDOW = 8
_SPACE = "[\\x20\\x09-\\x0D]+"
_BLANK = "(?s)[\\x20\\x09-\\x0D]*"


def _with_words(texts: DataFrame) -> DataFrame:
    """``text`` without nulls, ``words``, ``n_words``, and hashes of words (``h1``) and of pairs from each word on (``h2``)."""
    return (
        texts.withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
        .withColumns({"n_words": F.size("words"), "h1": F.transform("words", lambda w: F.xxhash64(w))})
        .withColumn("h2", _paired("h1", 1)))


def _paired(hashes: str, step: int) -> Column:
    """Hash of each element with the one ``step`` further on; meaningless where there is none."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(F.col(hashes), i + F.lit(step))))


def _first(column: str, lost: int) -> Column:
    """The array without its last ``lost`` elements."""
    return F.slice(column, 1, F.greatest(F.size(column) - F.lit(lost), F.lit(0)))


def _grams() -> list[Column]:
    """Buckets of a document's words, pairs and endings, from ``_with_words``."""
    return [
        F.transform("h1", lambda h: F.pmod(h, F.lit(WORDS)).cast("int")),
        F.transform(_first("h2", 1), lambda h: (F.pmod(h, F.lit(PAIRS)) + F.lit(WORDS)).cast("int")),
        F.transform("words", lambda w: (F.pmod(F.xxhash64(F.right(w, F.lit(3))), F.lit(ENDINGS))
                                        + F.lit(WORDS + PAIRS)).cast("int"))]


def signs(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, with words and hashes.

    Words are what ASCII white space parts; null counts as empty.  ``n_dup_lines``
    counts lines with a word that equal an earlier one, ``n_repeat_words`` the words
    in windows of eight that are found twice or more in the text.  Windows are
    compared by hash first, and word by word where a hash repeats.  Each row is
    worked on alone, however long its text.
    """
    worded = _with_words(picked(df, doc_id=doc_id, text=text))
    lines = F.filter(F.split("text", "\n"), lambda line: ~line.rlike(f"^{_BLANK}$"))
    counted = worded.withColumns({"_lines": lines, "_h4": _paired("h2", 2)}).select(
        "doc_id", "words", "n_words", "h1", "h2",
        F.length(F.array_join("words", "")).alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        _paired("_h4", 4).alias("_h8")).withColumn("_h8", _first("_h8", WINDOW - 1))
    # Words are compared only for windows whose hash is found again.
    hashed = F.when(F.size(F.array_distinct("_h8")) < F.size("_h8"), F.array_sort(F.transform(
        "_h8", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))).otherwise(F.array().cast("array<struct<hash:bigint,at:int>>"))
    hash_at = lambda i: F.get(F.col("_hashed"), i)["hash"]
    again = F.filter("_hashed", lambda w, i: F.coalesce(w.hash == hash_at(i - 1), F.lit(False))
                     | F.coalesce(w.hash == hash_at(i + 1), F.lit(False)))
    windows = F.array_sort(F.transform("_again", lambda w: F.struct(
        F.array_join(F.slice("words", w.at + F.lit(1), WINDOW), " ").alias("window"), w.at.alias("at"))))
    beside = lambda i: F.get(F.col("_windows"), i)["window"]
    twice = F.filter("_windows", lambda w, i: F.coalesce(w.window == beside(i - 1), F.lit(False))
                     | F.coalesce(w.window == beside(i + 1), F.lit(False)))
    covered = F.transform("_places", lambda p, i: F.least(
        F.lit(WINDOW), F.coalesce(F.get(F.col("_places"), i + 1), p + F.lit(WINDOW)) - p))
    return (
        counted.withColumn("_hashed", hashed).withColumn("_again", again).withColumn("_windows", windows)
        .withColumn("_places", F.array_sort(F.transform(twice, lambda w: w.at)))
        .withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda s, n: s + n))
        .drop("_h8", "_hashed", "_again", "_windows", "_places"))


def weights(df: DataFrame, trusted: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, ``weights``: the log ratio of trusted to raw frequency of each bucket.

    ``trusted`` holds the ids of all trusted documents in ``doc_id``; null ids and
    repeated ones are nothing more.  Raw counts cover every document of ``df``,
    trusted ones among them.  Without trusted documents all weights are zero.
    Counts are added up before they are shuffled; there are as many as buckets.
    Texts are shuffled, to meet the trusted ids, only if there are too many of these
    to broadcast.  Runs jobs.
    """
    chosen = small(written(picked(trusted, doc_id=doc_id).where("doc_id IS NOT NULL").distinct().withColumn("good", F.lit(1))))
    rows = _with_words(picked(df, doc_id=doc_id, text=text)).join(chosen, "doc_id", "left")
    grams = rows.select("good", F.explode(F.concat(*_grams())).alias("bucket"))
    counts = written(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("good")))
    all_raw, all_good = (counts.agg(F.coalesce(F.sum(c), F.lit(0))).scalar() for c in ("raw", "good"))
    ratio = F.log((F.col("good") + PRIOR) / (F.col("raw") * all_good / F.greatest(all_raw, F.lit(1)) + PRIOR))
    size = WORDS + PAIRS + ENDINGS
    ratio = F.when(all_good > 0, ratio).otherwise(0.0)
    every = df.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket"))
    known = every.join(counts.select("bucket", ratio.alias("weight")), "bucket", "left")
    return written(known.agg(F.array_sort(F.collect_list(F.struct(
        "bucket", F.coalesce("weight", F.lit(0.0)).alias("weight")))).alias("pairs")).select(
        F.col("pairs.weight").alias("weights")))


def judged(df: DataFrame, trusted: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``df``: the ``signs``, ``base_failed``, ``log_ratio`` and ``kept``.

    ``log_ratio`` is the mean weight of the row's n-grams, 0 for a text without
    words.  A row is kept if it passes the base rules (20 words, at most 30 %
    repeated) and its ``log_ratio`` is at least ``threshold``.  Repeated rows are
    judged alike; an empty table gives an empty table; other columns do not matter.
    """
    table = weights(df, trusted, doc_id=doc_id, text=text)
    # As many numbers as there are buckets come to the driver and go into the plan as one constant array.
    numbers = ",".join(map(repr, table.first().weights))
    looked_up = F.split(F.lit(numbers), ",").cast("array<double>")
    total = F.lit(0.0)
    for grams in _grams():
        total = total + F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(looked_up, b))
    n_grams = F.lit(2) * F.col("n_words") + F.greatest(F.col("n_words") - 1, F.lit(0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        signs(df, doc_id=doc_id, text=text)
        .withColumns({"base_failed": failed, "log_ratio": F.round(total / F.greatest(n_grams, F.lit(1)), 9)})
        .withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))
        .select("doc_id", *[F.col(c).cast("long").alias(c) for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "log_ratio", "kept"))
