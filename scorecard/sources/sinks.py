"""Writers (SNK1-SNK4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAT_COLUMNS = ["label", "model", "concept", "dimension", "question", "score"]


def write_json(df: DataFrame, path: str, mode: str = "overwrite",
               partition_by: list[str] | None = None) -> str:
    """SNK1/SNK2: JSON lines, UTF-8, NULL fields kept (``"score": null``)."""
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)
    return path


def write_long_tables(tables: dict[str, DataFrame], path: str, run_date: str,
                      mode: str = "overwrite") -> str:
    """SNK2 for the long score tables: Parquet, one folder per table,
    partitioned by ``run_date`` so later reads prune by day.  A run replaces its
    own day and leaves the others; ``mode="append"`` adds to the day."""
    for name, df in tables.items():
        (df.withColumn("run_date", F.lit(run_date).cast("date"))
         .write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_date").parquet(f"{path}/{name}"))
    return path


def normalize_and_export(df1: DataFrame, df2: DataFrame, path: str | None = None) -> DataFrame:
    """SNK3: tag ``file1``/``file2``, union, keep the 6 flat columns, write CSV.

    Returns the exported frame (the source tag is not part of the export,
    as in the reference).  NULL cells are written as empty fields.
    """
    combined = (df1.withColumn("source", F.lit("file1"))
                .unionByName(df2.withColumn("source", F.lit("file2")))
                .select(*FLAT_COLUMNS))
    if path is not None:
        combined.write.mode("overwrite").option("header", True).csv(path)
    return combined
