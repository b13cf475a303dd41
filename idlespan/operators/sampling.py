"""Repeatable splits and samples of exact size.

Rows are ranked by a hash of their content, so the same table gives the same
split whatever its partitioning, also when a lost task is run again.  Identical
rows are kept as one row with a count (``copies``), and a count is split where
the cut falls inside it.  A group is ranked without gathering it: hashes are
counted per prefix, whole prefixes fall on one side, and the prefix that the cut
falls in is counted by more digits until it holds few rows, which are sorted.

Rows that differ in one whole number only may be *folded*: one row holds the first
number, and in ``RUN`` how many rows, each one higher, it stands for.  They are split
like the rows they stand for, but stored folded: which of them go to train are the
bits of a number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idlespan.session import written

#: Hex digits that a prefix grows by (65,536 prefixes), of how many, and distinct rows that are sorted in one task at most.
_DIGITS, _ALL_DIGITS = 4, 32
SORTED_ROWS = 100_000
#: Columns of a folded table: for how many rows, from its own number on, a row stands (31 at most); and, once it is split,
#: which of them go to train, as bits, and how many copies do of a row of its own that the cut falls in.
RUN, TRAIN, SHARE = "_run", "_train", "_share"
#: Tasks that put a folded table's rows together, for each shuffle partition of the session.
_FINER = 8


def content_hash(columns: Sequence[Column], seed: int) -> Column:
    """Hex digest over the text of the columns (null differs from empty)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *_texts(columns)))


def _texts(columns: Sequence[Column]) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns]


def with_copies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows over ``columns`` with the number of times each occurs."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))


def hash_split(
    distinct_rows: DataFrame,
    *,
    by: Sequence[Column],
    strata: Sequence[str] = (),
    train_fraction: float = 0.8,
    min_rows: int = 0,
    max_train_rows: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Add ``train_copies`` and ``test_copies`` to a table that has ``copies``.

    Per stratum of ``n`` rows (copies counted) exactly ``int(n * train_fraction)``
    go to train, or all of them when ``n < min_rows``; ``max_train_rows`` limits that
    number instead where given.  Runs a job for every four digits of the hash that
    are looked at, and stores one row per stratum each time.
    """
    group = list(strata)
    rows = distinct_rows.withColumn("_hash", content_hash(by, seed))
    wanted = F.floor(F.col("_n") * F.lit(train_fraction)).cast("bigint")
    if min_rows:
        wanted = F.when(F.col("_n") < min_rows, F.col("_n")).otherwise(wanted)
    if max_train_rows is not None:
        wanted = F.least(wanted, F.lit(max_train_rows).cast("bigint"))

    cuts, digits = _cuts(rows, group, wanted)
    joined = _with_cut(rows, cuts, group, "left").withColumn("_prefix", F.substring("_hash", 1, digits))
    at_cut = F.col("_prefix") == F.col("_cut")
    clear = joined.filter(F.col("_cut").isNull() | ~at_cut)
    clear = clear.withColumn(
        "train_copies",
        F.when(F.col("_cut").isNull() | (F.col("_prefix") < F.col("_cut")), F.col("copies"))
        .otherwise(F.lit(0).cast("bigint")))
    edge = joined.filter(at_cut).withColumn("train_copies", _share_at_cut(group, distinct_rows.columns))
    both = clear.unionByName(edge)
    return both.select(*distinct_rows.columns, "train_copies",
                       (F.col("copies") - F.col("train_copies")).alias("test_copies"))


def _cuts(rows: DataFrame, group: Sequence[str], wanted: Column) -> tuple[DataFrame, int]:
    """Where each group's ``wanted`` copies (of ``_n``) end: see ``_cut``; and of how many digits its prefix is."""
    digits = _DIGITS
    counted = _counted(rows, group, digits)
    room = counted.withColumn("_n", F.sum("_held").over(Window.partitionBy(*group))).withColumn("_room", wanted).drop("_n")
    cuts = _cut(room, group)
    # A stratum that goes to train whole has no prefix that the cut falls in.
    while digits < _ALL_DIGITS and (cuts.agg(F.max("_rows")).first()[0] or 0) > SORTED_ROWS:
        inside = _with_cut(rows, cuts, group, "inner").filter(F.substring("_hash", 1, digits) == F.col("_cut"))
        digits += _DIGITS
        cuts = _cut(_counted(inside, [*group, "_room"], digits), group)
    return cuts, digits


def _share_at_cut(group: Sequence[str], columns: Sequence[str]) -> Column:
    """Copies that go to train of rows whose prefix the cut falls in."""
    inside = Window.partitionBy(*group).orderBy("_hash", *columns)
    ahead = F.coalesce(
        F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return F.greatest(F.least(F.col("_room") - ahead, F.col("copies")), F.lit(0).cast("bigint"))


# --- folded tables ------------------------------------------------------------------

def with_copies_folded(df: DataFrame, columns: Sequence[str], over: str, run: Column, times: Column) -> DataFrame:
    """``with_copies`` of rows that each stand for ``run`` rows, ``over`` going up by one, ``times`` times; folded likewise.

    Runs that overlap are cut where one begins or ends, so that no row is there twice.
    """
    others = [c for c in columns if c != over]
    first = F.col(over).cast("int")
    counted = df.groupBy(*others, first.alias("_b"), (first + run).cast("int").alias("_e")).agg(F.sum(times).cast("bigint").alias("_n"))
    parts = _FINER * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Different runs only, of which there are few with the same other columns.
    held = counted.repartition(parts, *others).groupBy(*others).agg(F.collect_list(F.struct("_b", "_e", "_n")).alias("_runs"))
    at = lambda field: F.col("_runs")[field]
    one = F.size("_runs") == 1
    cuts = F.when(one, F.array(at("_b")[0], at("_e")[0])).otherwise(F.sort_array(F.array_distinct(F.concat(at("_b"), at("_e")))))
    told = held.withColumn("_cuts", cuts).select(
        *others, "_runs", "_cuts", F.posexplode(F.slice("_cuts", F.lit(1), F.size("_cuts") - 1)).alias("_nth", "_from"))
    here = F.filter("_runs", lambda r: (r["_b"] <= F.col("_from")) & (r["_e"] > F.col("_from")))
    added = F.aggregate(here, F.lit(0).cast("bigint"), lambda n, r: n + r["_n"])
    kind = dict(df.dtypes)[over]
    return told.withColumn("copies", F.when(one, at("_n")[0]).otherwise(added)).filter("copies > 0").select(
        *[F.col("_from").cast(kind).alias(over) if c == over else F.col(c) for c in columns], "copies",
        (F.get("_cuts", F.col("_nth") + 1) - F.col("_from")).alias(RUN))


def unfolded(folded: DataFrame, over: str, place: str = "_place") -> DataFrame:
    """The rows that a folded table stands for, with their ``place`` among those of one row."""
    names = [c for c in folded.columns if c != RUN]
    told = folded.select(*names, F.explode(F.sequence(F.lit(0), F.col(RUN) - 1)).alias(place))
    return told.withColumn(over, F.col(over) + F.col(place))


def hash_split_folded(folded: DataFrame, *, by: Sequence[str], over: str, train_fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """``hash_split`` of the rows that a folded table stands for, still folded (see ``split_rows``).  Runs jobs; stored.

    ``over`` must be a column of doubles, one of ``by``.
    """
    place = list(by).index(over)
    texts = _texts([F.col(c) for c in by])
    before = F.concat_ws("|", F.lit(str(seed)), *texts[:place])
    after = F.concat_ws("|", *texts[place + 1:]) if texts[place + 1:] else None
    # What rows of one have in common is put into words once: projections are not merged across this step.
    worded = folded.select("*", F.inline(F.array(F.struct(before.alias("_before"), *([after.alias("_after")] if after is not None else [])))))
    columns = [c for c in folded.columns if c != RUN]

    def digest(number: Column) -> Column:
        text = F.concat(number.cast("int").cast("string"), F.lit(".0"))
        return F.md5(F.concat_ws("|", F.col("_before"), text, *([F.col("_after")] if after is not None else [])))

    rows = unfolded(worded, over).select("copies", digest(F.col(over)).alias("_hash"))
    cuts, digits = _cuts(rows, [], F.floor(F.col("_n") * F.lit(train_fraction)).cast("bigint"))
    prefixes = F.transform(F.sequence(F.lit(0), F.col(RUN) - 1), lambda i: F.substring(digest(F.col(over) + i), 1, digits))
    cut = _with_cut(worded.withColumn("_prefixes", prefixes), cuts, [], "left")

    def bits(chosen) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.col(RUN) - 1), F.lit(0), lambda held, i: held.bitwiseOR(
            F.when(chosen(F.get("_prefixes", i)), F.call_function("shiftleft", F.lit(1), i)).otherwise(0)))

    # Without a cut all go to train.
    stored = written(cut.withColumns({
        TRAIN: bits(lambda p: F.col("_cut").isNull() | (p < F.col("_cut"))),
        "_edge": bits(lambda p: F.coalesce(p == F.col("_cut"), F.lit(False)))}).drop("_prefixes", "_before", "_after", "_cut"))
    whole = stored.filter("_edge = 0").select(*columns, RUN, TRAIN, F.lit(None).cast("bigint").alias(SHARE))
    # Rows with one that the cut may fall in are few; they are told apart.
    near = unfolded(stored.filter("_edge <> 0"), over)
    at_cut = near.filter(is_train("_edge")).withColumn("_hash", content_hash([F.col(c) for c in by], seed))
    clear = near.filter(~is_train("_edge")).select(*columns, F.lit(1).alias(RUN), is_train().cast("int").alias(TRAIN), F.lit(None).cast("bigint").alias(SHARE))
    shared = at_cut.select(*columns, F.lit(1).alias(RUN), F.lit(0).alias(TRAIN), _share_at_cut([], columns).alias(SHARE))
    return whole.unionByName(written(clear.unionByName(shared)))


def is_train(bits: str = TRAIN) -> Column:
    """Whether the row at ``_place`` of a folded row has its bit."""
    return F.call_function("shiftright", F.col(bits), F.col("_place")).bitwiseAND(F.lit(1)) == 1


def split_rows(split: DataFrame, over: str) -> DataFrame:
    """The rows of a folded table that was split, with ``train_copies`` and ``test_copies``."""
    train = F.coalesce(SHARE, F.when(is_train(), F.col("copies")).otherwise(F.lit(0).cast("bigint")))
    rows = unfolded(split, over).withColumn("train_copies", train)
    return rows.withColumn("test_copies", F.col("copies") - F.col("train_copies")).drop(TRAIN, SHARE, "_place")


def _counted(rows: DataFrame, keys: Sequence[str], digits: int) -> DataFrame:
    """Copies (``_held``) and distinct rows (``_rows``) per prefix of so many digits."""
    return rows.groupBy(*keys, F.substring("_hash", 1, digits).alias("_prefix")).agg(
        F.sum("copies").alias("_held"), F.count(F.lit(1)).alias("_rows"))


def _cut(counted: DataFrame, group: Sequence[str]) -> DataFrame:
    """The prefix of each group that holds its ``_room``-th copy, and the room that is left in it.  Stored, so Spark knows its size."""
    before = Window.partitionBy(*group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    here = (F.col("_before") <= F.col("_room")) & (F.col("_room") < F.col("_before") + F.col("_held"))
    return written(placed.filter(here).select(
        *group, F.col("_prefix").alias("_cut"), (F.col("_room") - F.col("_before")).alias("_room"), "_rows"))


def _with_cut(rows: DataFrame, cuts: DataFrame, group: Sequence[str], how: str) -> DataFrame:
    """``rows`` with ``_cut`` and ``_room`` of their group."""
    values = cuts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(group)], "_cut", "_room")
    if not group:
        # One row at most.
        struct = values.select(F.struct("_cut", "_room")).scalar()
        return rows.withColumn("_s", struct).select(*rows.columns, "_s._cut", "_s._room")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(group)]
    return rows.join(values, same, how).select(*rows.columns, "_cut", "_room")
