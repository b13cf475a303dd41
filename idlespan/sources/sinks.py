"""Writing results.  Every function runs a job."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, gzip: bool = False, mode: str = "errorifexists") -> str:
    """A folder of CSV files with headers, optionally compressed."""
    writer = df.write.mode(mode).option("header", True)
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.csv(path)
    return path


def write_per_cloud(df: DataFrame, path: str, cloud: str = "CloudProvider",
                    mode: str = "errorifexists") -> str:
    """One subfolder per cloud; readers that ask for one cloud open only its files."""
    df.write.mode(mode).option("header", True).option("compression", "gzip").partitionBy(cloud).csv(path)
    return path


def write_stats(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Statistics as JSON lines."""
    df.write.mode(mode).json(path)
    return path
