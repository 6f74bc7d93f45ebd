"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` when its scan yields fewer partitions than the
    cluster can run at once (e.g. one unsplittable file or a single Parquet
    row group), so that expensive per-row work is not done by one task.

    On a large input the scan already has thousands of splits and this is a
    no-op; nothing is shuffled.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
