"""File comparison and wide-by-rater views (PV4-PV8).

Analytics stay long; pivots are the last step and always get their
column values explicitly (no extra distinct job, stable schema).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import grid_mean, quoted, row_grid_mean
from .flatten import tag_sources

CELL_KEYS = ["label", "model", "concept", "dimension", "question"]
WIDE_KEYS = ["label", "concept", "dimension", "question"]
AGGREGATE_MODEL = "aggregate_models"


def compare_datasets(df1: DataFrame, df2: DataFrame, keys: list[str] = CELL_KEYS) -> DataFrame:
    """PV4 + PV5: mean score per key and source, ``difference = file2 - file1``.

    Cells without any score are dropped (as ``pivot_table`` does); NULL key
    parts are kept as their own group.
    """
    tagged = tag_sources(df1, df2).where(F.col("score").isNotNull())
    piv = tagged.groupBy(*keys).pivot("source", ["file1", "file2"]).agg(F.avg("score"))
    return piv.withColumn("difference", F.col("file2") - F.col("file1"))


def aggregate_models(long: DataFrame, models: list[str], keys: list[str] = WIDE_KEYS,
                     digits: int | None = None) -> DataFrame:
    """PV7: per key, the mean over the chosen raters' scores (NULLs ignored;
    no score -> NULL), as long rows with ``model = 'aggregate_models'``.
    ``digits`` takes the exact grid mean (order-independent, so equal means
    are equal bit for bit and rank as ties)."""
    sub = long.where(F.col("model").isin(models))
    return (sub.groupBy(*keys).agg(grid_mean("score", digits).alias("score"))
            .withColumn("model", F.lit(AGGREGATE_MODEL)))


def with_aggregate(long: DataFrame, models: list[str], keys: list[str] = WIDE_KEYS,
                   digits: int | None = None) -> DataFrame:
    """Long rows plus the aggregate pseudo-rater (PV7 then PV8's column set).

    One aggregation per cell, so the input is read and shuffled once; what it
    collects is the raters of a cell (one row each)."""
    chosen = F.col("model").isin(models)
    cells = long.groupBy(*keys).agg(
        F.collect_list(F.struct("model", "score")).alias("_rows"),
        grid_mean(F.when(chosen, F.col("score")), digits).alias("_mean"),
        F.bool_or(chosen).alias("_any"))
    added = F.array(F.struct(F.lit(AGGREGATE_MODEL).alias("model"), F.col("_mean").alias("score")))
    rows = F.when(F.col("_any"), F.concat("_rows", added)).otherwise(F.col("_rows"))
    return cells.select(*keys, F.inline(rows))


def listed(long: DataFrame, models: list[str]) -> DataFrame:
    """``long``, where a rater that is not listed raises, instead of vanishing
    from a view with a column per rater."""
    m = F.col("model")
    other = F.raise_error(F.concat(F.lit("rater without a column: "), m)).cast("string")
    return long.withColumn("model", F.when(m.isNull() | m.isin(models), m).otherwise(other))


def wide_by_model(long: DataFrame, models: list[str], keys: list[str] = WIDE_KEYS,
                  aggregate_of: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """PV6: one row per key, one column per rater (explicit list; others raise).

    The key includes ``concept`` so equal names in two concepts stay apart.
    A duplicate cell keeps its mean; callers average cells first.
    ``aggregate_of`` adds PV7's ``aggregate_models`` column, the row mean of
    those raters' columns, in the same aggregation (``digits``: exact grid
    mean, as :func:`aggregate_models`)."""
    wide = listed(long, models).groupBy(*keys).pivot("model", models).agg(F.avg("score"))
    if aggregate_of:
        wide = wide.withColumn(AGGREGATE_MODEL, row_grid_mean([quoted(r) for r in aggregate_of], digits))
    return wide


def other_raters(columns: list[str], reference: str, keys: list[str] = WIDE_KEYS) -> list[str]:
    """PV8: every column except the keys and the reference rater (includes
    the aggregate column when present)."""
    return [c for c in columns if c not in keys and c != reference]
