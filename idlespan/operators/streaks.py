"""Longest runs of flagged rows per resource.

A resource may own a large part of the table, so its rows are never sorted in one
task.  Rows are cut into blocks by resource and day; a window inside each block
yields a one-row summary, and summaries (at most one per resource and day) are
then joined up in time order:

``length``    rows in the block
``head``      rows before the first break, which may continue the previous run
``tail``      position of the last break, where the open run starts
``best``      longest run inside the block

Rows of a table of stretches (see ``rollup``) are cut where another row of their block
begins or ends.  Between two cuts the same rows return each hour in the same order, so one
hour is summed up, its repeats follow by arithmetic, and a day's parts are joined up as days are.

A break is the position after which a run can start: the row itself when it is
not flagged, or the row before it when a gap in time ends the run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idlespan.functions import times
from idlespan.operators.rollup import SPREAD, STRETCH, USAGE_DATE, hours_of_stretches

_TIE_BREAKERS = ("BillingAccountId", "ServiceName", "ResourceType", "CommitmentDiscountStatus")


def time_order(df: DataFrame, time: str = "HourlyTimestamp") -> list[Column]:
    """A total order of a resource's rows: time, then names (null as empty), then cost."""
    costs = [F.col(c) for c in ("TotalHourlyCost",) if c in df.columns]
    return [F.col(time), *_names(df).values(), *costs]


def _names(df: DataFrame) -> dict[str, Column]:
    return {f"_o_{c}": F.coalesce(F.col(c), F.lit("")) for c in _TIE_BREAKERS if c in df.columns}


def longest_runs(
    df: DataFrame,
    flags: Mapping[str, Column],
    *,
    key: str = "ResourceId",
    time: str = "HourlyTimestamp",
    means: Sequence[str] = (),
    keep_last: Sequence[str] = (),
    gap_aware: bool = False,
    within: Sequence[str] = (),
    carried: Mapping[str, tuple[Column, Callable[[Column], Column]]] | None = None,
) -> DataFrame:
    """Per key (and ``within``): the longest run of each flag, means over all rows, the last row.

    Runs count rows in time order: by default a missing hour does not end a run
    and two rows in the same hour count twice.  With ``gap_aware`` a run also ends
    wherever two rows are not exactly one hour apart.

    ``carried`` adds other rules to the same pass: (value of a row, aggregate) by
    name, where the aggregate of a block's aggregates is that of all rows, as with
    sums and minima.  Rows without a key are left out, unless something is carried:
    then they give a row without a key, of which only what is carried means anything.

    ``df`` may be a table of stretches; flags must then be the same in all its hours, and
    a carried sum counts ``hours_each``.
    """
    carried = carried or {}
    rows = df if carried else df.filter(F.col(key).isNotNull())
    if STRETCH in rows.columns and dict(rows.dtypes)[time] != "timestamp_ntz":
        rows = hours_of_stretches(rows, time)  # Clocks may be put forward or back.
    if USAGE_DATE not in rows.columns:
        rows = rows.withColumn(USAGE_DATE, F.col(time).cast("date"))
    keys = [key, *within]
    # Sorting looks at the first column most; a hash of the block tells nearly all
    # blocks apart there.  Blocks are still told apart by their key and day.
    rows = rows.withColumn("_block", F.xxhash64(key, USAGE_DATE))
    block = ["_block", *keys, USAGE_DATE, *[c for c in (SPREAD,) if c in rows.columns]]
    if STRETCH in rows.columns:
        parts = _part_summaries(_cut_alike(rows, block, time), flags, [*block, _PART], time, means, keep_last, gap_aware, carried)
        blocks = _joined(parts, flags, block, _PART, means, keep_last, gap_aware, carried)
    else:
        blocks = _part_summaries(rows, flags, block, time, means, keep_last, gap_aware, carried)
    return _join_blocks(blocks.drop("_block"), flags, key, keys, means, keep_last, gap_aware, carried)


#: First hour of a part, between two cuts of a block of stretches.
_PART = "_part"


def _cut_alike(rows: DataFrame, block: Sequence[str], time: str) -> DataFrame:
    """Stretches cut where another of their block begins or ends; a part's rows share ``_part`` and length."""
    begin, end = F.col("_begin"), F.col("_end")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), h)
    timed = rows.withColumn("_begin", F.hour(time)).withColumn("_end", begin + F.col(STRETCH))
    # The hours of a day are the bits of a number.
    cut = timed.withColumn("_cuts", F.bit_or(bit(begin).bitwiseOR(bit(end))).over(Window.partitionBy(*block)))
    cut = cut.withColumn("_cuts", F.col("_cuts").bitwiseAND(bit(end) - bit(begin + 1)))
    inner = F.filter(F.sequence(begin + 1, end - 1), lambda h: F.col("_cuts").bitwiseAND(bit(h)) != 0)
    starts = F.when(F.col("_cuts") == 0, F.array(begin)).otherwise(F.concat(F.array(begin), inner))
    # Rows without a time have no hours to follow each other.
    starts = F.when(begin.isNull(), F.array_repeat(F.lit(0), F.col(STRETCH))).otherwise(starts)
    names = [c for c in rows.columns if c not in (time, STRETCH)]
    told = cut.withColumn("_starts", starts).select(*names, time, "_begin", "_end", "_starts", F.posexplode("_starts").alias("_nth", _PART))
    length = F.coalesce(F.get("_starts", F.col("_nth") + 1), end) - F.col(_PART)
    return told.select(*names, _PART, times.plus_hours(F.col(time), F.col(_PART) - begin).alias(time),
                       F.when(begin.isNull(), 1).otherwise(length).alias(STRETCH))


def _part_summaries(rows, flags, part, time, means, keep_last, gap_aware, carried) -> DataFrame:
    """One summary per part, whose rows return as often as its stretches have hours."""
    stretched = STRETCH in rows.columns
    # Names to order by are columns of their own: windows over the same columns share one sort.
    order = [*_names(rows), *[c for c in ("TotalHourlyCost",) if c in rows.columns]]
    rows = rows.withColumns(_names(rows))
    in_part = Window.partitionBy(*part).orderBy(time, *order)
    so_far = in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    marked = rows.select(
        *part, time, *([STRETCH] if stretched else []), *[c for c in (*means, *keep_last) if c not in (*part, time)],
        F.row_number().over(in_part).alias("_n"),
        *([F.lead(F.lit(1)).over(in_part).isNull().alias("_is_last")] if keep_last else []),
        *([F.lag(time).over(in_part).alias("_previous")] if gap_aware else []),
        *[c for c in order if c not in (*means, *keep_last)],
        *[flag.alias(f"_on_{name}") for name, flag in flags.items()],
        *[value.alias(f"_of_{name}") for name, (value, _) in carried.items()],
    )
    position = F.col("_n")
    breaks = {}
    for name in flags:
        here = F.when(~F.col(f"_on_{name}"), position)
        if gap_aware:
            here = here.when(_apart(F.col("_previous"), F.col(time)), position - 1)
        breaks[name] = here
    marked = marked.withColumns({f"_break_{name}": expr for name, expr in breaks.items()})
    marked = marked.withColumns(
        {f"_open_{name}": F.max(f"_break_{name}").over(so_far) for name in flags})

    hours = F.col(STRETCH) if stretched else F.lit(1)
    measures = [F.count(F.lit(1)).alias("_length")]
    measures += [merge(F.col(f"_of_{name}")).alias(f"_of_{name}") for name, (_, merge) in carried.items()]
    for name in flags:
        run = position - F.coalesce(F.col(f"_open_{name}"), F.lit(0))
        starts = F.when(F.col(f"_break_{name}").isNotNull(), position - 1)
        measures += [F.max(run).alias(f"_best_{name}"),
                     F.min(starts).alias(f"_head_{name}"),
                     F.max(f"_break_{name}").alias(f"_tail_{name}")]
    for column in means:
        known = F.count(column) if not stretched else F.sum(F.when(F.col(column).isNotNull(), hours).otherwise(0))
        measures += [F.sum(F.col(column) * hours if stretched else column).alias(f"_sum_{column}"), known.alias(f"_cnt_{column}")]
    # Rows other than the part's last have no rank; a column that no one reads is left out.
    rank = F.when(F.col("_is_last"), position)
    last = {c: times.plus_hours(F.col(c), hours - 1) if stretched and c == time else F.col(c) for c in keep_last}
    measures += [F.max_by(value, rank).alias(f"_last_{c}") for c, value in last.items()]
    if gap_aware:
        measures += [F.min(time).alias("_from"), F.max(time).alias("_to")]
    if not stretched:
        return marked.groupBy(*part).agg(*measures)
    summed = marked.groupBy(*part).agg(*measures, F.max(STRETCH).alias("_times"))
    return _repeated(summed, flags, gap_aware)


def _repeated(parts: DataFrame, flags: Mapping[str, Column], gap_aware: bool) -> DataFrame:
    """Summaries of parts whose rows return ``_times`` times, an hour apart, from those of one time."""
    length, repeats = F.col("_length"), F.col("_times") - 1
    again = repeats > 0
    if gap_aware:
        # Only rows of one time are followed by the next hour's in an hour.
        again = again & ~_apart(F.col("_to"), times.plus_hours(F.col("_from"), F.lit(1)))
    measures = {"_length": length * F.col("_times")}
    for name in flags:
        head, tail, best = F.col(f"_head_{name}"), F.col(f"_tail_{name}"), F.col(f"_best_{name}")
        # A run at the end of one time goes on at the beginning of the next.
        onward = F.when(again, length - tail + head)
        measures[f"_best_{name}"] = F.when(tail.isNull(), length * F.col("_times")).otherwise(F.greatest(best, onward))
        measures[f"_tail_{name}"] = tail + repeats * length
    if gap_aware:
        measures["_to"] = times.plus_hours(F.col("_to"), repeats)
    return parts.withColumns(measures).drop("_times")


def _placed(parts, flags, in_order, gap_aware) -> tuple[DataFrame, Column]:
    """Summaries with the rows before them and what each flag's open run brings along, and whether a gap precedes."""
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn(
        "_before", F.coalesce(F.sum("_length").over(earlier), F.lit(0)))
    gap = F.lit(False)
    if gap_aware:
        placed = placed.withColumn("_previous", F.lag("_to").over(in_order))
        gap = F.coalesce(_apart(F.col("_previous"), F.col("_from")), F.lit(False))
    before = F.col("_before")
    placed = placed.withColumns({
        f"_abs_{name}": F.coalesce(before + F.col(f"_tail_{name}"), F.when(gap, before))
        for name in flags})
    return placed.withColumns(
        {f"_carry_{name}": before - F.coalesce(F.max(f"_abs_{name}").over(earlier), F.lit(0))
         for name in flags}), gap


def _best(name: str, gap: Column) -> Column:
    """The longest run of parts that are joined up."""
    carry = F.when(gap, F.lit(0)).otherwise(F.col(f"_carry_{name}"))
    joined = carry + F.coalesce(F.col(f"_head_{name}"), F.col("_length"))
    return F.max(F.greatest(F.col(f"_best_{name}"), joined))


def _joined(parts, flags, block, order, means, keep_last, gap_aware, carried) -> DataFrame:
    """One summary per block of the summaries of its parts."""
    placed, gap = _placed(parts, flags, Window.partitionBy(*block).orderBy(order), gap_aware)
    measures = [F.sum("_length").alias("_length")]
    measures += [merge(F.col(f"_of_{name}")).alias(f"_of_{name}") for name, (_, merge) in carried.items()]
    for name in flags:
        head = F.coalesce(F.when(gap, F.col("_before")), F.col("_before") + F.col(f"_head_{name}"))
        measures += [_best(name, gap).alias(f"_best_{name}"), F.min(head).alias(f"_head_{name}"), F.max(f"_abs_{name}").alias(f"_tail_{name}")]
    measures += [F.sum(f"_{kind}_{column}").alias(f"_{kind}_{column}") for column in means for kind in ("sum", "cnt")]
    measures += [F.max_by(f"_last_{c}", order).alias(f"_last_{c}") for c in keep_last]
    if gap_aware:
        measures += [F.min("_from").alias("_from"), F.max("_to").alias("_to")]
    return placed.groupBy(*block).agg(*measures)


def _join_blocks(blocks, flags, key, keys, means, keep_last, gap_aware, carried) -> DataFrame:
    by_day = Window.partitionBy(*keys).orderBy(USAGE_DATE)
    if carried:
        # Blocks without a key have no order: each stands alone, so that they do not meet in one task.
        spread = [c for c in (SPREAD,) if c in blocks.columns]
        alone = F.when(F.col(key).isNull(), F.xxhash64(USAGE_DATE, *spread)).otherwise(F.lit(0).cast("bigint"))
        blocks = blocks.withColumn("_alone", alone)
        by_day = Window.partitionBy(*keys, "_alone").orderBy(USAGE_DATE)
    placed, gap = _placed(blocks, flags, by_day, gap_aware)

    measures = [F.sum("_length").alias("RowCount")]
    measures += [merge(F.col(f"_of_{name}")).alias(name) for name, (_, merge) in carried.items()]
    measures += [_best(name, gap).alias(name) for name in flags]
    for column in means:
        measures.append(F.try_divide(F.sum(f"_sum_{column}"), F.sum(f"_cnt_{column}"))
                        .alias(f"mean_{column}"))
    measures += [F.max_by(f"_last_{c}", USAGE_DATE).alias(f"_last_{c}") for c in keep_last]
    result = placed.groupBy(*keys).agg(*measures)
    if keep_last:
        others = [c for c in result.columns if c not in keys and not c.startswith("_last_")]
        result = result.select(*keys, *[F.col(f"_last_{c}").alias(c) for c in keep_last if c not in keys], *others)
    return result


def _apart(previous: Column, current: Column) -> Column:
    """True unless the two times are exactly one hour apart (null when there is no previous)."""
    return F.timestamp_diff("SECOND", previous, current) != 3600
