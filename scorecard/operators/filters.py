"""Filters and option lists (FL1-FL6, DS1-DS2).  Predicates are plain
``where`` clauses, so Catalyst pushes them into the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = "All"


def filter_dimension(df: DataFrame, dimension: str | None) -> DataFrame:
    """FL1: keep one dimension; ``None``/''/'All' keeps everything."""
    if not dimension or dimension == ALL:
        return df
    return df.where(F.col("dimension") == dimension)


def filter_threshold(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """FL2: ``score >= t``; NULL scores are dropped."""
    return df.where(F.col("score") >= F.lit(float(threshold)))


def filter_model(df: DataFrame, model: str) -> DataFrame:
    """FL3: rows of one rater."""
    return df.where(F.col("model") == model)


def filter_models(df: DataFrame, models: list[str], concept: str | None = None,
                  label: str | None = None, label_col: str = "label") -> DataFrame:
    """FL4: ``model IN (...) AND concept = c [AND label = l]``."""
    cond = F.col("model").isin(models)
    if concept is not None:
        cond = cond & (F.col("concept") == concept)
    if label is not None:
        cond = cond & (F.col(label_col) == label)
    return df.where(cond)


def with_dimension(df: DataFrame) -> DataFrame:
    """FL5: drop rows without a dimension (rater totals and concept rows);
    dimension-level rows stay next to their questions."""
    return df.where(F.col("dimension").isNotNull())


def distinct_options(df: DataFrame, columns: list[str]) -> DataFrame:
    """DS1: the distinct values of each column as ``(kind, value)`` rows.

    One scan: every row is expanded into its ``(kind, value)`` pairs and a
    single distinct (partial aggregation before the shuffle) removes
    duplicates."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    return df.select(F.inline(pairs)).distinct()


def ordered_dimensions(df: DataFrame, order_col: str = "dim_pos",
                       group: list[str] | None = None) -> DataFrame:
    """DS2: distinct non-empty dimensions with their first-appearance order."""
    group = group or []
    return (df.where(F.col("dimension").isNotNull() & (F.col("dimension") != ""))
            .groupBy(*group, "dimension").agg(F.min(order_col).alias(order_col)))
