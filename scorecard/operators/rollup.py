"""Hierarchical roll-up (RU1-RU7): question -> dimension -> concept -> model -> text.

Each level is the mean of the already rounded child scores, NULL children
skipped, rounded to 3 decimals half-to-even.  A level whose children are all
NULL is NULL and is skipped further up.  A rater that failed for a text
(``error``) has NULL scores on every level for that text and is left out of
the text score.

All grouping keys start with ``label``.  When the input is hash-partitioned
by ``label`` (see :func:`scorecard.operators.grid.evaluation_grid`) the four
aggregations run in one stage without further exchanges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round3

DIM_KEYS = ["label", "model", "concept", "dimension"]
CONCEPT_KEYS = ["label", "model", "concept"]
MODEL_KEYS = ["label", "model"]


def dimension_scores(q: DataFrame, extra: dict | None = None) -> DataFrame:
    """RU1 (+RU5 default weight).  ``extra``: more aggregates of the same pass."""
    # a rater that fails on any question of a text has no score on any level
    q = q.withColumn("_failed", F.bool_or(F.col("error").isNotNull()).over(Window.partitionBy(*MODEL_KEYS)))
    return (q.groupBy(*DIM_KEYS)
            .agg(round3(F.when(~F.bool_or("_failed"), F.avg("score"))).alias("score"),
                 *[c.alias(n) for n, c in (extra or {}).items()],
                 F.min("model_pos").alias("model_pos"),
                 F.min("concept_pos").alias("concept_pos"),
                 F.min("dim_pos").alias("dim_pos"),
                 F.coalesce(F.min("dim_weight"), F.lit(1.0)).alias("weight"),
                 F.min("concept_weight").alias("concept_weight"),
                 F.bool_or("_failed").alias("failed")))


def concept_scores(d: DataFrame, weighted: bool = False, extra: dict | None = None) -> DataFrame:
    """RU2; ``weighted=True`` (RU6) uses the stored dimension weights:
    ``sum(s*w) / sum(w over non-null s)``."""
    if weighted:
        mean = F.try_divide(F.sum(F.col("score") * F.col("weight")),
                            F.sum(F.when(F.col("score").isNotNull(), F.col("weight"))))
    else:
        mean = F.avg("score")
    return (d.groupBy(*CONCEPT_KEYS)
            .agg(round3(mean).alias("score"),
                 *[c.alias(n) for n, c in (extra or {}).items()],
                 F.min("model_pos").alias("model_pos"),
                 F.min("concept_pos").alias("concept_pos"),
                 F.coalesce(F.min("concept_weight"), F.lit(1.0)).alias("weight"),
                 F.bool_or("failed").alias("failed")))


def model_scores(c: DataFrame, extra: dict | None = None) -> DataFrame:
    """RU3 + EV13 status: a failed rater has a NULL model score."""
    extra = extra or {}
    return (c.groupBy(*MODEL_KEYS)
            .agg(round3(F.avg("score")).alias("_s"),
                 F.min("model_pos").alias("model_pos"),
                 F.bool_or("failed").alias("failed"),
                 *[col.alias(n) for n, col in extra.items()])
            .select(*MODEL_KEYS, F.when(~F.col("failed"), F.col("_s")).alias("score"),
                    "model_pos", F.lit(1.0).alias("weight"),
                    F.when(F.col("failed"), F.lit("error")).otherwise(F.lit("ok")).alias("status"),
                    *extra.keys()))


def text_scores(m: DataFrame, extra: dict | None = None) -> DataFrame:
    """RU4: mean over raters that succeeded and have a score."""
    ok = F.when(F.col("status") == "ok", F.col("score"))
    return (m.groupBy("label")
            .agg(round3(F.avg(ok)).alias("score"),
                 F.count(ok).alias("n_models"),
                 *[c.alias(n) for n, c in (extra or {}).items()]))


def run_metadata(q: DataFrame, system_prompt: str, base_prompt: str,
                 run_date: str | None = None) -> DataFrame:
    """RU7: per text, the raters used, the prompt templates and the run day
    (``yyyy-MM-dd``; today unless given)."""
    day = F.lit(run_date) if run_date else F.date_format(F.current_date(), "yyyy-MM-dd")
    return (q.groupBy("label")
            .agg(F.array_sort(F.collect_set("model")).alias("models_used"))
            .withColumns({"system_prompt": F.lit(system_prompt),
                          "base_prompt": F.lit(base_prompt), "run_date": day}))
