"""Averages and pivots for dashboards (AV1-AV6, PV1-PV3).

Input: long eval rows ``text_key, model, concept, dimension, question,
score``.  ``digits`` selects the order-independent grid mean (see
:func:`scorecard.functions.numeric.grid_mean`); ``None`` is a plain ``avg``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import grid_mean, quoted, round6, row_grid_mean


def _mean_by(df: DataFrame, keys: list[str], digits: int | None) -> DataFrame:
    return df.groupBy(*keys).agg(grid_mean("score", digits).alias("score"))


def avg_question(df: DataFrame, digits: int | None = None) -> DataFrame:
    """AV1: mean score by concept, dimension, question, text_key."""
    return _mean_by(df, ["concept", "dimension", "question", "text_key"], digits)


def avg_dimension(df: DataFrame, digits: int | None = None) -> DataFrame:
    """AV2: mean score by concept, dimension, text_key."""
    return _mean_by(df, ["concept", "dimension", "text_key"], digits)


def avg_concept(df: DataFrame, digits: int | None = None) -> DataFrame:
    """AV3: mean by concept, text_key, pooled over question rows (not the
    staged roll-up of RU2)."""
    return _mean_by(df, ["concept", "text_key"], digits)


def cross_model(df: DataFrame, digits: int | None = None) -> DataFrame:
    """AV4: mean by text_key, concept, dimension over raters and questions."""
    return _mean_by(df, ["text_key", "concept", "dimension"], digits)


def overall_by_text(df: DataFrame, digits: int | None = None) -> DataFrame:
    """AV5: mean of the AV4 rows per text (a mean of means)."""
    return cross_model(df, digits).groupBy("text_key").agg(F.avg("score").alias("score"))


def dim_by_text(df: DataFrame, digits: int | None = None) -> DataFrame:
    """AV6: mean of the AV4 rows by dimension, text_key (across concepts)."""
    return (cross_model(df, digits).groupBy("dimension", "text_key")
            .agg(F.avg("score").alias("score")))


def pivot_cells(df: DataFrame, index: list[str], column: str, values: list[str],
                value: str = "score", strict: bool = False) -> DataFrame:
    """PV1/PV2: ``index`` x ``values`` pivot of unique cells.

    Values are explicit (no discovery job); a row whose value is not listed
    fails the query instead of vanishing (filter first to leave it out; NULLs
    have no column).  Duplicate cells are resolved by ``first``;
    :func:`duplicate_cells` counts them.  ``strict=True`` raises on duplicates
    like the reference (one extra aggregation job).
    """
    if strict and not duplicate_cells(df, index, column).isEmpty():
        raise ValueError("pivot: duplicate cells for " + ", ".join(index + [column]))
    of = F.col(column)
    known = F.when(of.isNull() | of.isin(values), of).otherwise(
        F.raise_error(F.concat(F.lit(f"pivot: {column} is not listed: "), of.cast("string"))))
    return df.withColumn(column, known).groupBy(*index).pivot(column, values).agg(F.first(value))


def duplicate_cells(df: DataFrame, index: list[str], column: str) -> DataFrame:
    """Cells of a would-be pivot that hold more than one row."""
    return (df.groupBy(*index, column).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def question_ranking(cells: DataFrame, index: list[str], column: str, values: list[str],
                     value: str = "score") -> DataFrame:
    """PV3: pivot plus the skip-null row mean over the value columns, sorted
    descending (NULLs last, means that agree to six decimals by key); only
    its order is kept (``position``)."""
    wide = pivot_cells(cells, index, column, values, value)
    mean = round6(row_grid_mean([quoted(v) for v in values], None))
    # one row per question: bounded by the rubric, so a global order is fine
    w = Window.orderBy(F.desc_nulls_last("_avg"), *index)
    return (wide.withColumn("_avg", mean)
            .withColumn("position", F.row_number().over(w).cast("bigint"))
            .orderBy("position").drop("_avg"))
