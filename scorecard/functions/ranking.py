"""Average-tie ranks without putting a whole group into one task.

``rank() over (partition by g order by x)`` sends every row of group ``g``
to one task; with one rater holding a third of all scores that task is the
whole job.  Here ranks are computed in two phases:

1. counts per distinct ``(g, x)`` (a normal partial/final aggregation);
2. a distributed prefix sum over the distinct values: range-partition them
   by ``(g, x)``, sum inside each range partition, and add the totals of
   the earlier partitions of the same group (a table of at most
   ``#partitions + #groups`` rows).

The average rank of value ``x`` is ``before(x) + (count(x) + 1) / 2``.  The
range-partitioned table is checkpointed to the shared checkpoint folder so
that the partition ids used by both sides of the prefix sum are identical
even if tasks are recomputed after an executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def distinct_value_ranks(df: DataFrame, group_cols: list[str], value_col: str,
                         rank_col: str = "rank", num_partitions: int | None = None,
                         checkpoint: bool = True, count_col: str | None = None) -> DataFrame:
    """One row per distinct ``(group_cols, value_col)`` with its average rank.

    NULL values are not ranked (they are dropped first, as with complete
    observations).  With ``count_col`` a row stands for that many observations.
    """
    spark = df.sparkSession
    counts = (df.where(F.col(value_col).isNotNull())
              .groupBy(*group_cols, value_col)
              .agg((F.sum(count_col) if count_col else F.count(F.lit(1))).alias("_n")))
    # without an explicit count AQE may merge adjacent ranges, which keeps
    # the range order the prefix sum relies on
    ranged = (counts.repartitionByRange(num_partitions, *group_cols, value_col) if num_partitions
              else counts.repartitionByRange(*group_cols, value_col))
    ranged = ranged.withColumn("_pid", F.spark_partition_id())
    if checkpoint:
        ensure_checkpoint_dir(spark)
        ranged = ranged.checkpoint(eager=True)
    # running count of smaller values inside the same range partition
    w_in = (Window.partitionBy("_pid", *group_cols).orderBy(value_col)
            .rowsBetween(Window.unboundedPreceding, -1))
    within = ranged.withColumn("_before_in", F.coalesce(F.sum("_n").over(w_in), F.lit(0)))
    # totals of the same group in earlier range partitions
    offsets = ranged.groupBy("_pid", *group_cols).agg(F.sum("_n").alias("_tot"))
    w_off = (Window.partitionBy(*group_cols).orderBy("_pid")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.withColumn("_before_part", F.coalesce(F.sum("_tot").over(w_off), F.lit(0)))
    joined = within.join(offsets.select("_pid", *group_cols, "_before_part"),
                         on=["_pid", *group_cols], how="inner")
    rank = (F.col("_before_part") + F.col("_before_in")).cast("double") + \
        (F.col("_n").cast("double") + F.lit(1.0)) / F.lit(2.0)
    return joined.select(*group_cols, value_col, rank.alias(rank_col))


def with_average_rank(df: DataFrame, group_cols: list[str], value_col: str,
                      rank_col: str = "rank", **kw) -> DataFrame:
    """Attach the average-tie rank of ``value_col`` within ``group_cols``."""
    ranks = distinct_value_ranks(df, group_cols, value_col, rank_col, **kw)
    return df.join(ranks, on=[*group_cols, value_col], how="left")


def window_average_rank(group_cols: list[str], value_col: str):
    """Reference formulation (one task per group): for small inputs/tests."""
    w = Window.partitionBy(*group_cols).orderBy(value_col)
    peers = Window.partitionBy(*group_cols, value_col)
    return F.rank().over(w).cast("double") + \
        (F.count(F.lit(1)).over(peers).cast("double") - F.lit(1.0)) / F.lit(2.0)
