"""Rollups per resource and hour, hourly aggregates and their summaries.

There are two ways to the resource-hour rollup with the same result:

``resource_hours`` groups a table that has already been expanded to hours.  Equal rows
of one day are packed into one before they are shuffled.

``resource_hours_of_charges`` starts from charges and expands late.  A charge is
cut into at most one piece per calendar day, equal pieces are added up, and the
pieces, not the hours, are shuffled (twice: to add equal ones up, and by day); a
daily charge then moves one or two rows over the network, not 24.  With
``keep_usage_date`` rows end up partitioned by (ResourceId, UsageDate, UsageSpread),
which the streak operators reuse without another shuffle.  Because equal pieces
were added up first, a resource that holds a large share of all charges reaches
a task only as its distinct pieces of one day.

Hours of a day that follow each other with the same measures are one row of a table
of stretches: the first hour's row, and in ``StretchHours`` how many hours it stands
for.  ``hourly_aggregate`` and the summaries take such a table as well, so that hours
are told apart last, by ``hours_of_stretches``, or not at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlespan.functions import numbers, times
from idlespan.operators.timegrid import with_hourly_cost
from idlespan.schema import ROLLUP_INPUT_COLUMNS, require_columns

USAGE_DATE = "UsageDate"
#: Parts a day's rows without a resource among tasks by provider and service; 0 where there is a resource.
SPREAD = "UsageSpread"
#: Columns that ``keep_usage_date`` adds.
LAYOUT = (USAGE_DATE, SPREAD)
#: Column of a table of stretches: for how many hours, from its own on, a row stands.
STRETCH = "StretchHours"
#: Tasks that expand pieces to hours, for each shuffle partition of the session: what follows holds the hours of a task.
FINER = 8

_BASE_KEYS = ("ProviderName", "BillingAccountId", "ResourceId", "HourlyTimestamp", "ServiceName")
_OPTIONAL_KEYS = ("ResourceType", "CommitmentDiscountStatus")
_SUMMED = {"EffectiveCost": "TotalEffectiveCost", "BilledCost": "TotalBilledCost",
           "ConsumedQuantity": "TotalConsumedQuantity"}
_AVERAGED = {"SimulatedCPUUsage": "AvgCPUUsage", "SimulatedMemoryUsage": "AvgMemoryUsage"}


def rollup_keys(columns: list[str]) -> list[str]:
    return [*_BASE_KEYS, *[c for c in _OPTIONAL_KEYS if c in columns]]


def resource_hours(expanded: DataFrame) -> DataFrame:
    """Costs, usage means and row counts per account, resource, service and hour."""
    require_columns(expanded, ROLLUP_INPUT_COLUMNS)
    present = expanded.columns
    keys = [k for k in rollup_keys(present) if k != "HourlyTimestamp"]
    sums = ["HourlyCost", *[c for c in _SUMMED if c in present]]
    means = [c for c in _AVERAGED if c in present]
    time = F.col("HourlyTimestamp")
    hour = F.coalesce(F.hour(time), F.lit(0))
    # A charge's hours of a day are equal rows but for the time: they become one row, counted by hour, before the shuffle.
    packed = expanded.select(*keys, *sums, *means, time.cast("date").alias("_day"), times.plus_hours(time, -hour).alias("_base"), hour.alias("_hour"))
    packed = packed.groupBy(*keys, "_day", "_base", *sums, *means).agg(*[F.count_if(F.col("_hour") == h).alias(f"_at{h}") for h in range(24)])
    counts = F.array(*[F.col(f"_at{h}") for h in range(24)])
    begins = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: (F.get("_counts", h) > 0) & ~F.equal_null(F.get("_counts", h), F.get("_counts", h - 1)))
    changes = F.filter(F.sequence(F.lit(1), F.lit(24)), lambda h: (h > F.col("_begin")) & ~F.equal_null(F.get("_counts", h), F.get("_counts", F.col("_begin"))))
    runs = packed.select(*keys, "_day", "_base", *sums, *means, counts.alias("_counts")).select("*", F.explode(begins).alias("_begin"))
    rows = F.get("_counts", F.col("_begin"))
    amounts = {"_rows": rows, **{f"_{c}": F.col(c) * rows for c in (*sums, *means)},
               **{f"_n_{c}": F.when(F.col(c).isNotNull(), rows).otherwise(0) for c in means}}
    pieces = runs.select(*keys, "_day", times.plus_hours(F.col("_base"), F.col("_begin")).alias("_first"),
                         (F.get(changes, F.lit(0)) - F.col("_begin")).alias("_length"), *[v.alias(n) for n, v in amounts.items()])
    partitions = FINER * int(expanded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretches = _stretches_of_pieces(pieces.repartition(partitions, *keys, "_day"), [*keys, "_day"], list(amounts))
    return hours_of_stretches(stretches.select(*rollup_keys(present), STRETCH, *_measures(sums, means)))


def _measures(sums: Sequence[str], means: Sequence[str]) -> list[Column]:
    """The rollup's measures of what was added up."""
    return [F.col("_HourlyCost").alias("TotalHourlyCost"), F.col("_rows").alias("RecordCount"),
            *[F.try_divide(f"_{c}", f"_n_{c}").alias(out) for c, out in _AVERAGED.items() if c in means],
            *[F.col(f"_{c}").alias(out) for c, out in _SUMMED.items() if c in sums]]


def resource_hours_of_charges(charges: DataFrame, distribute_cost: bool = True,
                              keep_usage_date: bool = False) -> DataFrame:
    """The resource-hour rollup of charges, expanded only after the shuffle."""
    return hours_of_stretches(resource_stretches_of_charges(charges, distribute_cost, keep_usage_date))


def resource_stretches_of_charges(charges: DataFrame, distribute_cost: bool = True,
                                  keep_usage_date: bool = False) -> DataFrame:
    """The resource-hour rollup of charges as a table of stretches."""
    present = charges.columns
    sums = ["HourlyCost", *[c for c in _SUMMED if c in present]]
    means = [c for c in _AVERAGED if c in present]
    keys = [k for k in rollup_keys(present) if k != "HourlyTimestamp"]

    pieces = _cut_at_midnight(with_hourly_cost(charges, distribute_cost))
    partial = [F.sum(c).alias(f"_{c}") for c in (*sums, *means)]
    partial += [F.count(c).alias(f"_n_{c}") for c in means]
    # Pieces grow into up to 24 rows each after this shuffle, so its partitions must
    # not be merged by their size before; naming the number keeps them apart.
    partitions = FINER * int(charges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Streaks want a resource's day in one place, but rows without a resource are no one's; otherwise
    # all keys may spread a day, so that one with very many services meets in no single task.
    spread = F.when(F.col("ResourceId").isNull(), F.pmod(F.xxhash64("ProviderName", "ServiceName"), F.lit(1024))).otherwise(
        F.lit(0).cast("bigint"))
    added = [SPREAD] if keep_usage_date else []
    layout = ["ResourceId", *added] if keep_usage_date else keys
    distinct_pieces = (
        pieces.groupBy(*keys, USAGE_DATE, "_first", "_length")
        .agg(F.count(F.lit(1)).alias("_rows"), *partial)
        .withColumns({SPREAD: spread} if keep_usage_date else {})
        .repartition(partitions, *layout, USAGE_DATE)
    )
    stretches = _stretches_of_pieces(distinct_pieces, [*keys, USAGE_DATE, *added], [
        "_rows", *[f"_{c}" for c in (*sums, *means)], *[f"_n_{c}" for c in means]])

    rolled = stretches.select(*rollup_keys(present), STRETCH, USAGE_DATE, *added, *_measures(sums, means))
    return rolled if keep_usage_date else rolled.drop(USAGE_DATE)


def hours_of_stretches(table: DataFrame, time: str = "HourlyTimestamp") -> DataFrame:
    """One row per hour of a table of stretches; any other table as it is."""
    if STRETCH not in table.columns:
        return table
    first, names = F.col(time), [c for c in table.columns if c != STRETCH]
    one_hour = F.expr("INTERVAL 1 HOUR")
    # Rows without a time keep their number.
    times_of = F.when(first.isNull(), F.array_repeat(first, F.col(STRETCH))).otherwise(
        F.sequence(first, times.plus_hours(first, F.col(STRETCH) - 1), one_hour))
    # Told apart under a name of their own, the hours are all that is added to a row.
    hours = table.withColumn("_hours", times_of).select(*[c for c in names if c != time], F.explode("_hours").alias(time))
    return hours.select(*names)


def _stretches_of_pieces(pieces: DataFrame, keys: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    """Stretches (``HourlyTimestamp``, ``StretchHours``) per key with the sums of ``amounts`` over the different
    pieces of a day that cover them.

    A day's pieces meet in one row, which is cut where a piece begins or ends: between two cuts every hour has
    the same sums.  They are added up once a stretch, so no table of hours is ever held or spilled.  Each amount is
    a list of its own, so Spark leaves out, from reading on, those that the caller does not use.
    """
    first = F.col("_first")
    # Hours are counted from midnight or, where clocks may be put forward or back, from 1970.
    begin = F.hour(first) if dict(pieces.dtypes)["_first"] == "timestamp_ntz" else F.floor(F.unix_micros(first) / 3_600_000_000).cast("int")
    begin = F.coalesce(begin, F.lit(0))
    minutes_off = F.pmod(F.unix_micros(first.cast("timestamp")), F.lit(3_600_000_000))
    # A day's hash goes first: where many days are grouped they are sorted, and it tells nearly all of them apart.
    days = pieces.withColumns({"_off": minutes_off, "_b": begin, "_e": begin + F.col("_length"), "_at": F.xxhash64(*keys)}).groupBy(
        "_at", *keys, "_off").agg(
        F.min(times.plus_hours(first, -begin)).alias("_base"), F.collect_list("_b").alias("_b"), F.collect_list("_e").alias("_e"),
        *[F.collect_list(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in amounts])
    at = lambda c, i: F.get(F.col(c), i)
    one = F.size("_b") == 1
    # Most days of a key have one piece, which is its own stretch.
    cuts = F.when(one, F.array(at("_b", F.lit(0)), at("_e", F.lit(0)))).otherwise(F.sort_array(F.array_distinct(F.concat("_b", "_e"))))
    stretches = days.withColumn("_cuts", cuts).select(
        *keys, "_base", "_b", "_e", *amounts, "_cuts", F.posexplode(F.slice("_cuts", F.lit(1), F.size("_cuts") - 1)).alias("_nth", "_from"))
    here = F.filter(F.sequence(F.lit(0), F.size("_b") - 1), lambda i: (at("_b", i) <= F.col("_from")) & (at("_e", i) > F.col("_from")))
    others = F.slice("_here", F.lit(2), F.greatest(F.size("_here") - 1, F.lit(0)))
    added = lambda c: F.aggregate(others, at(c, at("_here", F.lit(0))), lambda s, i: s + at(c, i))
    held = stretches.withColumn("_here", F.when(one, F.array(F.lit(0))).otherwise(here)).filter(F.size("_here") > 0)
    return held.select(
        *keys, times.plus_hours(F.col("_base"), F.col("_from")).alias("HourlyTimestamp"), (at("_cuts", F.col("_nth") + 1) - F.col("_from")).alias(STRETCH),
        *[F.when(F.size("_here") == 1, at(c, at("_here", F.lit(0)))).otherwise(added(c)).alias(c) for c in amounts])


def _cut_at_midnight(timed: DataFrame) -> DataFrame:
    """Cut each charge into one piece per day: first hour's time and hour count."""
    start, hours = F.col("ChargePeriodStart"), F.col("OriginalDurationHours")
    seconds_into_day = F.timestamp_diff("SECOND", F.date_trunc("DAY", start), start)
    last = times.plus_hours(start, hours - 1)
    day_span = F.date_diff(last.cast("date"), start.cast("date"))

    def hours_before_day(day: Column) -> Column:
        """Hours of the charge that begin before its ``day``-th midnight."""
        until_midnight = (day.cast("bigint") * 86400 - seconds_into_day) / 3600.0
        return F.least(F.ceil(until_midnight), hours)

    day = F.col("_day")
    begin = F.when(day == 0, F.lit(0).cast("bigint")).otherwise(hours_before_day(day))
    return (
        timed.withColumn("_day", F.explode(F.sequence(F.lit(0), day_span)))
        .withColumn("_begin", begin)
        .withColumn("_length", (hours_before_day(day + 1) - F.col("_begin")).cast("int"))
        .withColumn("_first", times.plus_hours(start, F.col("_begin")))
        .withColumn(USAGE_DATE, F.col("_first").cast("date"))
    )


# --- distinct counts ------------------------------------------------------------------
#
# Hours are added up to one row per resource and day before anything is counted once: with the
# layout's columns in the table that needs no shuffle.  One row of each resource is marked, so
# resources are a sum; the hours of a day are the bits of a number, by their offset in the hour.

_HOURS = ("_day", "_offset")


def hours_each(table: DataFrame) -> Column:
    """For how many hours each row of the table stands."""
    return F.col(STRETCH) if STRETCH in table.columns else F.lit(1)


def _countable(table: DataFrame) -> DataFrame:
    """The table; hours of clocks that may be put forward or back are told apart."""
    return table if dict(table.dtypes)["HourlyTimestamp"] == "timestamp_ntz" else hours_of_stretches(table)


def _by_day(table: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """One row per keys, resource and day, with ``_hours``: bits of the hours that occur."""
    time, span = F.col("HourlyTimestamp"), hours_each(table)
    day = table.withColumns({
        "_day": F.col(USAGE_DATE) if USAGE_DATE in table.columns else time.cast("date"),
        "_offset": F.unix_micros(time.cast("timestamp")) % 3_600_000_000})
    bits = F.bit_or(F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1), span) - 1, F.hour(time)))
    layout = [c for c in LAYOUT if c in table.columns]
    return day.groupBy(*keys, "ResourceId", *_HOURS, *layout).agg(bits.alias("_hours"), *[m.alias(n) for n, m in measures.items()])


def _mark_resources(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``_resource``: 1 at one row of each resource (and keys), else 0; rows without a resource have 0."""
    others = [c for c in rows.columns if c not in (*keys, "ResourceId", *LAYOUT)]
    listed = rows.groupBy(*keys, "ResourceId").agg(F.collect_list(F.struct(*others)).alias("_rows"))
    return listed.select(*keys, "ResourceId", F.posexplode("_rows").alias("_nth", "_row")).select(
        *keys, "_row.*", ((F.col("_nth") == 0) & F.col("ResourceId").isNotNull()).cast("bigint").alias("_resource"))


def rollup_by_provider(rollup: DataFrame) -> DataFrame:
    """Distinct resources and cost per provider."""
    resources = rollup.groupBy("ProviderName", "ResourceId").agg(F.sum(F.col("TotalHourlyCost") * hours_each(rollup)).alias("_cost"))
    return resources.groupBy("ProviderName").agg(
        F.count("ResourceId").alias("Resources"), numbers.sum_or_zero(F.col("_cost")).alias("TotalCost"))


def rollup_summary(rollup: DataFrame) -> DataFrame:
    """One row: sizes, time range, total cost and how far grouping shrank the table."""
    rollup = _countable(rollup)
    span = hours_each(rollup)
    days = _by_day(rollup.withColumn("_account", F.col("BillingAccountId")), ["_account"], {
        "_rows": F.sum(span), "_input": F.sum(F.col("RecordCount") * span), "_cost": F.sum(F.col("TotalHourlyCost") * span),
        "_from": F.min("HourlyTimestamp"), "_to": F.max(times.plus_hours(F.col("HourlyTimestamp"), span - 1))})
    accounts = _mark_resources(days.drop("_hours", *_HOURS), []).groupBy("_account").agg(
        *[F.sum(c).alias(c) for c in ("_resource", "_rows", "_input", "_cost")], F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    return accounts.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("GroupedRows"),
        F.sum("_input").alias("InputRows"),
        F.coalesce(F.sum("_resource"), F.lit(0)).alias("UniqueResources"),
        F.count("_account").alias("UniqueAccounts"),
        F.min("_from").alias("FirstHour"),
        F.max("_to").alias("LastHour"),
        numbers.sum_or_zero(F.col("_cost")).alias("TotalCost"),
    ).withColumn("CompressionRatio", F.try_divide(F.col("InputRows"), F.col("GroupedRows")))


def hourly_aggregate(rollup: DataFrame, ordered: bool = False, keep_layout: bool = False) -> DataFrame:
    """Cost and usage per hour, provider, resource and service.

    Usage is the plain mean of the rollup's means; ``RecordCount`` ignores rows
    without a resource.  ``ordered`` sorts the whole result by all keys, which costs
    more than the aggregate itself.  Of a table of stretches the result is one too,
    unless it is sorted; ``keep_layout`` leaves it the layout's columns, by which it is
    partitioned.
    """
    present = rollup.columns
    if STRETCH in present:
        stretches = _hourly_stretches(rollup, keep_layout and not ordered)
        if not ordered:
            return stretches
        named = [c for c in ("Region",) if c in present]
        return hours_of_stretches(stretches).orderBy("HourlyTimestamp", "ProviderName", "ResourceId", "ServiceName", *named)
    keys = ["HourlyTimestamp", "ProviderName", "ResourceId", "ServiceName",
            *[c for c in ("Region", *LAYOUT) if c in present]]
    measures = [numbers.sum_or_zero(F.col("TotalHourlyCost")).alias("HourlyCost"),
                F.count("ResourceId").alias("RecordCount")]
    measures += [F.avg(c).alias(c) for c in _AVERAGED.values() if c in present]
    if "TotalConsumedQuantity" in present:
        measures.append(numbers.sum_or_zero(F.col("TotalConsumedQuantity"))
                        .alias("TotalConsumedQuantity"))
    # The layout's columns follow from the others; named, they spare a shuffle.
    grouped = rollup.groupBy(*keys).agg(*measures).drop(*LAYOUT)
    return grouped.orderBy(*[k for k in keys if k not in LAYOUT]) if ordered else grouped


def _hourly_stretches(rollup: DataFrame, keep_layout: bool = False) -> DataFrame:
    """``hourly_aggregate`` of a table of stretches, whose rows are pieces of a day."""
    present = rollup.columns
    more = [c for c in ("Region",) if c in present]
    keys = ["ProviderName", "ResourceId", "ServiceName", *more]
    means = [c for c in _AVERAGED.values() if c in present]
    sums = {"TotalHourlyCost": "HourlyCost"} | ({"TotalConsumedQuantity": "TotalConsumedQuantity"} if "TotalConsumedQuantity" in present else {})
    layout = [c for c in LAYOUT if c in present]
    day = layout if USAGE_DATE in layout else [*layout, "_day"]
    pieces = rollup.select(
        *keys, *layout, F.col("HourlyTimestamp").cast("date").alias("_day"), F.col("HourlyTimestamp").alias("_first"), F.col(STRETCH).alias("_length"),
        *[F.col(c).alias(f"_{c}") for c in (*sums, *means)], F.col("ResourceId").isNotNull().cast("bigint").alias("_rows"),
        *[F.col(c).isNotNull().cast("bigint").alias(f"_n_{c}") for c in means])
    summed = _stretches_of_pieces(pieces, [*keys, *day], ["_rows", *[f"_{c}" for c in (*sums, *means)], *[f"_n_{c}" for c in means]])
    consumed = [F.col("_TotalConsumedQuantity").alias("TotalConsumedQuantity")] if "TotalConsumedQuantity" in sums else []
    return summed.select("HourlyTimestamp", *keys, *(layout if keep_layout else []), STRETCH, F.col("_TotalHourlyCost").alias("HourlyCost"), F.col("_rows").alias("RecordCount"),
                         *[F.try_divide(f"_{c}", f"_n_{c}").alias(c) for c in means], *consumed)


def _hours_and_resources(hourly: DataFrame, keys: Sequence[str], means: Sequence[str] = ()) -> DataFrame:
    """Per keys: rows, cost, distinct hours and resources, and sums and counts to take means of."""
    hourly = _countable(hourly)
    span = hours_each(hourly)
    known = lambda c: F.sum(F.when(F.col(c).isNotNull(), span).otherwise(0))
    measures = {"_rows": F.sum(span), "_costs": known("HourlyCost"), "_cost": F.sum(F.col("HourlyCost") * span)}
    for c in means:
        measures |= {f"_sum_{c}": F.sum(F.col(c) * span), f"_n_{c}": known(c)}
    days = _mark_resources(_by_day(hourly, keys, measures), keys).groupBy(*keys, *_HOURS).agg(
        F.bit_or("_hours").alias("_hours"), *[F.sum(c).alias(c) for c in ("_resource", *measures)])
    hours = F.sum(F.when(F.col("_day").isNotNull(), F.bit_count("_hours")).otherwise(0))
    return days.groupBy(*keys).agg(F.coalesce(hours, F.lit(0)).cast("bigint").alias("_hours"), *[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) if c in ("_rows", "_resource") else F.sum(c).alias(c) for c in ("_resource", *measures)])


def hourly_summary_totals(hourly: DataFrame) -> DataFrame:
    """One row: cost, distinct hours and resources, mean usage of the hourly table."""
    means = [c for c in _AVERAGED.values() if c in hourly.columns]
    sums = _hours_and_resources(hourly, [], means)
    return sums.select(
        F.col("_rows").alias("TotalRecords"), F.col("_hours").alias("UniqueHours"), F.col("_resource").alias("UniqueResources"),
        F.coalesce("_cost", F.lit(0.0)).alias("TotalCost"),
        *[F.try_divide(f"_sum_{c}", f"_n_{c}").alias(f"Mean{c[3:]}") for c in means])


def provider_comparison(hourly: DataFrame) -> DataFrame:
    """Cost, distinct resources and hours, and rows per provider."""
    return _hours_and_resources(hourly, ["ProviderName"]).select(
        "ProviderName", F.coalesce("_cost", F.lit(0.0)).alias("TotalCost"), F.try_divide("_cost", "_costs").alias("AvgCost"),
        F.col("_resource").alias("UniqueResources"), F.col("_hours").alias("UniqueHours"), F.col("_rows").alias("TotalRecords"))
