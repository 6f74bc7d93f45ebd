"""Connected components of a graph given as a table of edges.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): every step attaches the
neighbours of a node to the smallest of them, until the graph is a set of
stars.  Edges stay a Spark table throughout; the driver sees two numbers per
step.  Each step ends in ``checkpoint()``, so lost executors cost no more than
the current step.  Nodes with a large share of all edges, of which there can
only be few, are joined by broadcast (:func:`common.split_hot`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import split_hot


def _star(directed: DataFrame, rows: int) -> DataFrame:
    """(u, v) -> (u, v, m): m is the smallest of u and its neighbours v."""
    least = (directed.groupBy("u").agg(F.min("v").alias("_least"), F.count(F.lit(1)).alias("_n"))
             .select("u", F.least("u", "_least").alias("m"), "_n"))
    return split_hot(directed, least, ["u"], "_n", rows).select("u", "v", "m")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.expr("coalesce(bit_xor(xxhash64(u, v)), 0L)").alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """Columns ``node``, ``component`` for every node that has an edge.

    ``edges`` has two BIGINT columns, named ``u`` and ``v``; direction,
    repeated edges and loops do not matter, and rows with a null are ignored.
    The component is its smallest node.  No edges give no rows.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = (edges.where("u is not null and v is not null and u <> v")
             .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
             .distinct().checkpoint())
    n, state = _state(edges)
    for _ in range(max_steps if n else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_star(both, 2 * n).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct().checkpoint())
        n = large.count()
        small = _star(large, n)
        edges = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v")))
                 .where("u <> v").distinct().checkpoint())
        n, after = _state(edges)
        if after == state and _is_stars(edges):
            break
        state = after
    else:
        if n:
            raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))


def _is_stars(edges: DataFrame) -> bool:
    """No node has two parents, and no parent has one."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chained = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    return twice.isEmpty() and chained.isEmpty()
