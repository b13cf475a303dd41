"""Exact duplicates by an extendible-hash index on shared files.

A text's key is a 64-bit hash; a bucket holds all keys with the same leading
bits.  The directory doubles, one bit more at a time, where a bucket is overfull.
Rows find their bucket through the directory.  Owner tasks hold ranges of buckets:
texts that share a key are compared byte by byte, and different ones are chained.
All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlespan.llm.frames import numbered, place
from idlespan.session import shared_folder, written

#: Keys of a bucket at most, and buckets that a directory has at most if keys are spread evenly (about twice as many
#: where they are not): a larger table has larger buckets, so its directory stays some 10 MB.
CAPACITY, MOST_BUCKETS = 64, 1 << 18
#: Bits by which the directory's histogram is finer than the average bucket asks for.
_FINER = 6


def normal(text: Column) -> Column:
    """White space runs as one blank; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _leading(key: Column, bits: int | Column) -> Column:
    """The first ``bits`` bits of a key."""
    if isinstance(bits, int):
        return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function(
        "shiftrightunsigned", key, F.lit(64) - bits))


def directory(keys: DataFrame, capacity: int | None = None) -> DataFrame:
    """(depth, leading, low) of the buckets for ``keys`` (each ``key`` once): parts of at most ``capacity`` keys.

    A bucket is a run of ``depth`` leading bits that fits while the run one bit
    shorter does not: what doubling the directory until nothing is overfull leads
    to.  ``low`` is the bucket's first key, by which owners hold ranges of buckets.
    Keys are counted by their leading bits, finer only where needed, so what is
    counted is far smaller than the keys.
    """
    total = keys.count()
    capacity = capacity or max(CAPACITY, total // MOST_BUCKETS)
    fine = min(64, max(0, (total // capacity).bit_length()) + _FINER)
    begin, found, open_keys = 0, [], keys
    while True:
        counted = open_keys.groupBy(_leading(F.col("key"), fine).alias("leading")).agg(F.count(F.lit(1)).alias("n"))
        levels = written(counted.select(F.explode(F.sequence(F.lit(begin), F.lit(fine))).alias("depth"), "leading", "n")
                         .select("depth", F.call_function("shiftrightunsigned", "leading", F.lit(fine) - F.col("depth"))
                                 .alias("leading"), "n")
                         .groupBy("depth", "leading").agg(F.sum("n").alias("n")))
        shorter = levels.where(F.col("n") > capacity).select(
            (F.col("depth") + 1).alias("depth"), F.col("leading").alias("above"))
        fit = levels.where(F.col("n") <= capacity)
        inner = fit.where(F.col("depth") > begin).withColumn("above", F.shiftrightunsigned("leading", 1))
        found += [fit.where(F.col("depth") == begin).select("depth", "leading"),
                  inner.join(shorter, ["depth", "above"], "left_semi").select("depth", "leading")]
        overfull = levels.where((F.col("depth") == fine) & (F.col("n") > capacity)).select("leading")
        if fine == 64 or overfull.isEmpty():
            break
        open_keys = open_keys.withColumn("leading", _leading(F.col("key"), fine)).join(
            overfull, "leading", "left_semi").select("key")
        # The overfull runs themselves are no buckets: the next pass starts one bit deeper.
        begin, fine = fine + 1, min(64, fine + 8)
    buckets = found[0]
    for more in found[1:]:
        buckets = buckets.unionByName(more)
    return written(buckets.withColumn("low", F.call_function("shiftleft", "leading", F.lit(64) - F.col("depth"))))


def placed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` with ``low``, the bucket that the directory names for their ``key``; rows of no bucket are lost.

    A key is looked up once for each depth that occurs, few of which there are.
    """
    depths = sorted(r.depth for r in buckets.select("depth").distinct().collect())  # 65 at most
    tried = F.array(*[F.struct(F.lit(d).alias("depth"), _leading(F.col("key"), d).alias("leading")) for d in depths])
    return rows.withColumn("_at", F.explode(tried)).join(
        buckets.select(F.struct("depth", "leading").alias("_at"), "low"), "_at").drop("_at")


def build_index(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """The index of ``rows`` (key, said, head, and anything else), stored by ranges of buckets in the shared folder.

    One entry for each different text (``said``): ``low, key, chain, links, head, n``,
    where ``head`` is the least of the rows' heads, ``n`` their number, ``chain`` the
    entry's place among the ``links`` texts that have its key.  Copies are counted
    in each task before bytes are moved and compared; owners get no texts.
    """
    entries = placed(rows, buckets).groupBy("low", "key", "said").agg(F.min("head").alias("head"), F.count(F.lit(1)).alias("n"))
    owned = entries.drop("said").repartitionByRange("low", "key")
    chain = W.partitionBy("low", "key")
    chained = owned.withColumns({
        "chain": F.row_number().over(chain.orderBy("head")) - 1, "links": F.count(F.lit(1)).over(chain)})
    path = shared_folder(rows.sparkSession) + "/index"
    # A head's fields may share a name, which files may not have: they are stored by place.
    fields = chained.schema["head"].dataType.fields
    named, placed_only = (T.StructType([T.StructField(name or f"_{i}", f.dataType) for i, (f, name) in enumerate(zip(fields, names))])
                          for names in ([f.name for f in fields], [None] * len(fields)))
    stored = chained.withColumn("head", F.col("head").cast(placed_only))
    stored.write.parquet(path)
    return rows.sparkSession.read.schema(stored.schema).parquet(path).withColumn("head", F.col("head").cast(named))


def exact_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True,
                     capacity: int | None = None, key_bits: int = 64) -> DataFrame:
    """``df``'s rows by position (c0, ...; the text only if ``keep_text``), with
    ``row_id, text_sha256, keep_id, group_size, kept``.

    Texts are equal if they are identical after runs of ASCII white space have
    become one blank; null counts as empty.  Of equal texts the row with the least
    doc_id stays (null ids come last, of repeated rows the first by ``row_id``).
    An empty table gives an empty table; other columns pass through.

    Runs jobs.  Rows with key and text go to the shared folder.  Texts are shuffled
    once, each once per task, to compare bytes, so a group of copies of any size is
    one entry per task.  Rows then look up their bucket in the directory and their
    entry in the bucket; a key with several texts is settled by comparing the row
    with the texts of its chain.  ``capacity`` is the keys of a bucket at most;
    ``key_bits`` shortens keys, for tests.
    """
    at, said = f"c{place(df, doc_id)}", f"c{place(df, text)}"
    mask = (1 << 64) - (1 << (64 - key_bits))
    own = numbered(df).withColumn("said", normal(F.col(said))).withColumns({
        "key": F.xxhash64("said").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")),
        "text_sha256": F.sha2(F.col("said").cast("binary"), 256), "row_id": F.monotonically_increasing_id()})
    # One form of the text is stored: its own if that is asked for.
    rows = written(own.drop("said" if keep_text else said))
    texts = rows.withColumn("said", normal(F.col(said))) if keep_text else rows
    head = F.struct(F.col(at).isNull().alias("last"), F.col(at).alias("doc_id"), "row_id")
    buckets = directory(rows.select("key").distinct(), capacity)
    index = build_index(texts.select("key", "said", head.alias("head")), buckets)

    passed = [c for c in numbered(df).columns if keep_text or c != said]
    out = [*passed, "row_id", "text_sha256", F.col("head.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
           (F.col("row_id") == F.col("head.row_id")).alias("kept")]
    single = index.where("links = 1").select("low", "key", "head", "n")
    found = placed(rows.drop("said"), buckets).join(single, ["low", "key"]).select(*out)
    chains = index.where("links > 1")
    if chains.isEmpty():
        return found
    # Along a chain, the row's bytes are compared with those of each entry's first row.
    first = texts.select(F.col("row_id").alias("_row"), "said")
    spelled = chains.join(first, F.col("head.row_id") == F.col("_row")).select("low", "key", "said", "head", "n")
    return found.unionByName(placed(texts, buckets).join(spelled, ["low", "key", "said"]).select(*out))
