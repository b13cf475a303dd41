"""Reading charge tables and profiling them."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlespan import fixed_values as fixed
from idlespan.functions import numbers, times
from idlespan.operators.timegrid import merge_tables
from idlespan.schema import CHARGES

SOURCE_FILE = "SourceFile"
_HEADER_JOBS = 16


def read_charges(spark: SparkSession, path: str, schema: T.StructType = CHARGES) -> DataFrame:
    """A typed charge table from CSV with a header; bad values become null.

    Columns are matched by name and those the file lacks are null.
    """
    return typed(read_text_csv(spark, path), schema)


def typed(text: DataFrame, schema: T.StructType = CHARGES) -> DataFrame:
    """Cast an all-text table to a layout."""
    columns = []
    for field in schema.fields:
        column = F.col(f"`{field.name}`") if field.name in text.columns else F.lit(None).cast("string")
        if isinstance(field.dataType, T.TimestampNTZType):
            column = times.parse_timestamp(column, "string")
        elif not isinstance(field.dataType, T.StringType):
            column = column.try_cast(field.dataType)
        columns.append(column.alias(field.name))
    return text.select(*columns)


def read_text_csv(spark: SparkSession, path: str | Sequence[str],
                  columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with header as text columns, to be cast later.

    Naming the columns avoids the small job that reads the header.  A byte-order
    mark before the first name is dropped.
    """
    names = columns or spark.read.option("header", True).csv(path).columns
    names = [n.lstrip("﻿") for n in names]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.csv`` of a folder as one text table with the file's path in ``SourceFile``.

    Files with the same header are read together, whatever their number; tables
    with different headers are stacked by column name.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    files = [row.path for row in listed.select("path").orderBy("path").collect()]
    if not files:
        raise FileNotFoundError(f"no CSV files in {folder}")

    def header_of(file: str) -> tuple[str, ...]:
        """A job that reads one line; many run at a time."""
        return tuple(spark.read.option("header", True).csv(file).columns)

    by_header: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(_HEADER_JOBS) as pool:
        for file, header in zip(files, pool.map(header_of, files)):
            by_header.setdefault(header, []).append(file)
    return merge_tables(*[
        read_text_csv(spark, paths, header).select("*", F.col("_metadata.file_path").alias(SOURCE_FILE))
        for header, paths in by_header.items()])


def parse_time_columns(df: DataFrame) -> DataFrame:
    """Columns named after a date, period or time to timestamps; bad values become null."""
    found = {name: times.parse_timestamp(F.col(name), kind) for name, kind in df.dtypes
             if any(w in name.lower() for w in fixed.TIME_COLUMN_WORDS)
             and kind in ("string", "date", "timestamp", "timestamp_ntz")}
    return df.withColumns(found) if found else df


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, number and percentage of nulls; one pass over the data."""
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count_if(F.col(name).isNull()).alias(f"_n{i}") for i, name in enumerate(df.columns)])
    entries = F.array(*[
        F.struct(F.lit(name).alias("column"), F.lit(kind).alias("dtype"),
                 F.col(f"_n{i}").alias("null_count"),
                 numbers.share_percent(F.col(f"_n{i}"), F.col("_rows")).alias("null_pct"))
        for i, (name, kind) in enumerate(df.dtypes)])
    return counted.select(F.inline(entries))


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, total and mean of the first column named after a cost."""
    aggregates = [F.count(F.lit(1)).alias("total_records"),
                  F.lit(len(df.columns)).alias("total_columns")]
    cost = next((c for c in df.columns if "cost" in c.lower()), None)
    if cost:
        aggregates += [numbers.sum_or_zero(F.col(cost)).alias("total_cost"),
                       F.avg(cost).alias("avg_cost")]
    return df.agg(*aggregates)
