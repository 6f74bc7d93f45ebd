"""Rater agreement against a reference rater (AG1-AG7), on long rows.

Input: long scores ``label, concept, dimension, question, model, score``
with one row per cell (see :func:`scorecard.operators.compare.with_aggregate`
to add the aggregate pseudo-rater).  The wide "one column per rater" view of
the reference is only needed for display; every statistic here is a join of
each rater's rows with the reference rater's rows on the cell key, followed
by ordinary aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import grid_mean, grid_sum, quoted, row_grid_mean
from ..functions.ranking import distinct_value_ranks
from ..session import ensure_checkpoint_dir
from .compare import AGGREGATE_MODEL, WIDE_KEYS, listed


def complete_pairs(long: DataFrame, reference: str, keys: list[str] = WIDE_KEYS) -> DataFrame:
    """Rows of every other rater with the reference score of the same cell;
    incomplete pairs (either score NULL) are dropped.  One aggregation per
    cell that collects its raters, no self-join; NULL key parts are a cell of
    their own, as in the listed form (:func:`pivot_pairs`)."""
    is_ref = F.col("model") == reference
    cells = long.where(F.col("score").isNotNull()).groupBy(*keys).agg(
        F.max(F.when(is_ref, F.col("score"))).alias("ref_score"),
        F.collect_list(F.when(~is_ref, F.struct("model", "score"))).alias("_others"))
    return (cells.where(F.col("ref_score").isNotNull())
            .select(*keys, F.inline("_others"), "ref_score"))


def contingency(long: DataFrame, reference: str, group_cols: list[str],
                keys: list[str] = WIDE_KEYS) -> DataFrame:
    """``group_cols, score, ref_score, n``: how often each other rater (any
    rater, listed or not) gave ``score`` where the reference gave ``ref_score``.
    Either may be NULL, so a rater without a complete pair still has rows.

    One pass over the scores: an aggregation per cell puts its raters next to
    the reference, a second one counts.  Ratings have few distinct values, so
    what is left is small however many cells there are."""
    is_ref = F.col("model") == reference
    cells = long.groupBy(*keys).agg(
        F.max(F.when(is_ref, F.col("score"))).alias("ref_score"),
        F.collect_list(F.when(~is_ref, F.struct("model", "score"))).alias("_others"))
    return (cells.select(*keys, "ref_score", F.inline("_others"))
            .groupBy(*group_cols, "score", "ref_score").agg(F.count(F.lit(1)).alias("n")))


#: Rows of a contingency table whose ranks are taken by windows; a larger one
#: (scores without a grid) is ranked by distributed prefix sums.
WINDOW_ROWS = 1_000_000


def spearman(table: DataFrame, group_cols: list[str], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Spearman rank correlation per group from a :func:`contingency` table:
    average-tie ranks of both sides within the group's complete pairs, then
    Pearson of the ranks, weighted by the counts.  Constant ranks or fewer than
    two pairs give NULL; a group without pairs has NULL in both columns.

    The table, not the pairs, is written once to the shared checkpoint folder."""
    ensure_checkpoint_dir(table.sparkSession)
    table = table.checkpoint(eager=True)
    whole = F.col("score").isNotNull() & F.col("ref_score").isNotNull()
    table = table.withColumn("_n", F.when(whole, F.col("n")).otherwise(F.lit(0)))
    if table.count() <= window_rows:
        def rank(value: str) -> F.Column:
            up_to = F.sum("_n").over(Window.partitionBy(*group_cols).orderBy(value))
            tied = F.sum("_n").over(Window.partitionBy(*group_cols, value))
            return up_to - (tied - F.lit(1)) / F.lit(2.0)
        ranked = table.select(*group_cols, "_n", rank("score").alias("_x"), rank("ref_score").alias("_y"))
    else:
        sides = (table.where(whole).select(*group_cols, F.lit("s").alias("_side"), F.col("score").alias("_v"), "n")
                 .unionByName(table.where(whole).select(*group_cols, F.lit("r").alias("_side"),
                                                        F.col("ref_score").alias("_v"), "n")))
        ranks = distinct_value_ranks(sides, [*group_cols, "_side"], "_v", "_rank", count_col="n")
        x = ranks.where(F.col("_side") == "s").select(*group_cols, F.col("_v").alias("score"), F.col("_rank").alias("_x"))
        y = ranks.where(F.col("_side") == "r").select(*group_cols, F.col("_v").alias("ref_score"),
                                                      F.col("_rank").alias("_y"))
        ranked = (table.join(x, [*group_cols, "score"], "left").join(y, [*group_cols, "ref_score"], "left")
                  .select(*group_cols, "_n", "_x", "_y"))
    # the mean rank of n pairs is (n + 1) / 2 whatever the ties, so only sums remain
    pairs = F.sum("_n").over(Window.partitionBy(*group_cols))
    x, y = (F.when(F.col("_n") > 0, F.col(c) - (pairs + F.lit(1)) / F.lit(2.0)) for c in ("_x", "_y"))
    n = F.col("_n").cast("double")
    return (ranked.select(*group_cols, "_n", x.alias("_x"), y.alias("_y"))
            .select(*group_cols, "_n", (n * F.col("_x") * F.col("_y")).alias("_xy"),
                    (n * F.col("_x") * F.col("_x")).alias("_xx"), (n * F.col("_y") * F.col("_y")).alias("_yy"))
            .groupBy(*group_cols)
            .agg(F.try_divide(F.sum("_xy"), F.sqrt(F.sum("_xx")) * F.sqrt(F.sum("_yy"))).alias("spearman_r"),
                 F.nullif(F.sum("_n"), F.lit(0)).alias("n_pairs")))


def pivot_pairs(long: DataFrame, reference: str, raters: list[str],
                keys: list[str] = WIDE_KEYS) -> DataFrame:
    """Complete pairs without a join: one aggregation per cell puts every
    listed rater's score next to the reference score, then the pairs are
    unstacked (``model, score, ref_score``, both non-NULL)."""
    m, sc = F.col("model"), F.col("score")
    wide = listed(long, [reference, *raters]).groupBy(*keys).agg(
        F.max(F.when(m == reference, sc)).alias("ref_score"),
        *[F.max(F.when(m == r, sc)).alias(f"_s_{i}") for i, r in enumerate(raters)])
    stacked = F.array(*[F.struct(F.lit(r).alias("model"), F.col(f"_s_{i}").alias("score"))
                        for i, r in enumerate(raters)])
    return (wide.where(F.col("ref_score").isNotNull())
            .select(*keys, "ref_score", F.inline(stacked))
            .where(F.col("score").isNotNull())
            .select(*keys, "model", "score", "ref_score"))


def spearman_overall(long: DataFrame, reference: str, keys: list[str] = WIDE_KEYS,
                     raters: list[str] | None = None) -> DataFrame:
    """AG1: one row per other rater (aggregate included when present).  All
    raters are covered; ``raters`` is not needed and kept for callers."""
    return spearman(contingency(long, reference, ["model"], keys), ["model"])


def spearman_by_dimension(long: DataFrame, reference: str, keys: list[str] = WIDE_KEYS,
                          raters: list[str] | None = None) -> DataFrame:
    """AG2: per (dimension, rater), aggregate excluded; raters without any
    score in a dimension are skipped.  All raters are covered, as in AG1."""
    body = long.where(F.col("model") != AGGREGATE_MODEL)
    table = contingency(body, reference, ["dimension", "model"], keys).where(F.col("score").isNotNull())
    return spearman(table, ["dimension", "model"])


def abs_diff(long: DataFrame, reference: str, keys: list[str] = WIDE_KEYS) -> DataFrame:
    """AG3: ``|score - reference|`` per cell and other rater (complete pairs)."""
    pairs = complete_pairs(long, reference, keys)
    return pairs.select(*keys, "model", F.abs(F.col("score") - F.col("ref_score")).alias("diff"))


def outlier_scores(long: DataFrame, reference: str, excluded: str,
                   keys: list[str] = WIDE_KEYS, digits: int | None = None,
                   raters: list[str] | None = None) -> DataFrame:
    """AG4: per cell, max / mean of the rater differences and the mean
    without one rater; NULL when a cell has no difference at all.
    ``digits``: exact grid means (see ``grid_mean``).

    With the rater list given, one aggregation per cell pivots every rater's
    score next to the reference score and the differences (with one
    ``diff_<rater>`` column each, AG3 in wide form) are row expressions: one
    shuffle, no join; a rater that is not listed raises.  Without it, the
    differences come from the pair join.
    """
    if raters:
        m, sc = F.col("model"), F.col("score")
        wide = listed(long, [reference, *raters]).groupBy(*keys).agg(
            F.max(F.when(m == reference, sc)).alias("_ref"),
            *[F.max(F.when(m == r, sc)).alias(f"_s_{i}") for i, r in enumerate(raters)])
        diffs = {r: F.abs(F.col(f"_s_{i}") - F.col("_ref")) for i, r in enumerate(raters)}
        kept = [d for r, d in diffs.items() if r != excluded]
        top = F.greatest(*diffs.values()) if len(diffs) > 1 else next(iter(diffs.values()))
        return wide.select(
            *keys, top.alias("max_diff"), row_grid_mean(list(diffs.values()), digits).alias("mean_diff"),
            row_grid_mean(kept, digits).alias("avg_diff_excl") if kept else
            F.lit(None).cast("double").alias("avg_diff_excl"),
            *[d.alias(f"diff_{r}") for r, d in diffs.items()])
    diffs = abs_diff(long, reference, keys)
    summary = diffs.groupBy(*keys).agg(
        F.max("diff").alias("max_diff"), grid_mean("diff", digits).alias("mean_diff"),
        grid_mean(F.when(F.col("model") != excluded, F.col("diff")), digits).alias("avg_diff_excl"))
    cells = long.select(*keys).distinct()
    return cells.join(summary, keys, "left")


def outliers_top(long: DataFrame, reference: str, excluded: str, raters: list[str],
                 n: int | None = None, keys: list[str] = WIDE_KEYS, digits: int | None = None) -> DataFrame:
    """AG5: all cells in descending order of ``max_diff`` (NULLs last, ties by
    key), with one ``diff_<rater>`` column per other rater.  With ``n`` the
    first ``n`` of them (ordered top-k per partition, then merged)."""
    scores = outlier_scores(long, reference, excluded, keys, digits, raters)
    ordered = scores.orderBy(F.desc_nulls_last("max_diff"), *keys)
    return (ordered if n is None else ordered.limit(n)).select(
        *keys, *[quoted(f"diff_{r}") for r in raters], "max_diff", "mean_diff")


def error_by_dimension(long: DataFrame, reference: str, excluded: str, raters: list[str],
                       keys: list[str] = WIDE_KEYS, digits: int | None = None) -> DataFrame:
    """AG6: per dimension, the mean of every ``diff_<rater>`` and of the
    three row summaries (``avg_<column>``), NULLs ignored.  One aggregation
    over the per-cell rows of AG4."""
    cells = outlier_scores(long, reference, excluded, keys, digits, raters)
    return cells.groupBy("dimension").agg(
        grid_mean("mean_diff", digits).alias("avg_mean_diff"),
        grid_mean("max_diff", digits).alias("avg_max_diff"),
        grid_mean("avg_diff_excl", digits).alias("avg_avg_diff_excl"),
        *[grid_mean(quoted(f"diff_{r}"), digits).alias(f"avg_diff_{r}") for r in raters])


def error_totals(by_dimension: DataFrame, digits: int | None = None) -> DataFrame:
    """AG7: sums over dimensions of ``avg_avg_diff_excl`` and ``avg_mean_diff``;
    like R's ``sum``, NULL as soon as one dimension is NULL."""
    def strict_sum(c: str) -> F.Column:
        total = F.sum(c) if digits is None else grid_sum(c, digits)
        return F.when(F.count_if(F.col(c).isNull()) == 0, total)
    return by_dimension.agg(strict_sum("avg_avg_diff_excl").alias("total_avg_diff_excl"),
                            strict_sum("avg_mean_diff").alias("total_mean_diff"))
