"""Reading named tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPREAD_BYTES = 2 << 20
SPREAD_MOST = 128 << 20  # a core


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table; any path Spark can read."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def spread(df: DataFrame, least_bytes: int = SPREAD_BYTES) -> DataFrame:
    """A scan dealt out to all cores if its files make fewer tasks than there are cores.

    One file with one row group is one task however many cores wait. Tables that are large, have as many files as there
    are cores, or are too small to matter stay as they are. Filters and columns still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    alone = least_bytes <= size < cores * SPREAD_MOST and len(df.inputFiles()) < cores
    return df.repartition(cores) if alone else df
