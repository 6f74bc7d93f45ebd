"""Agreement operators against brute force (pandas/NumPy on tiny inputs)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from scorecard.functions.ranking import distinct_value_ranks, window_average_rank
from scorecard.operators import agreement as ag
from scorecard.operators.compare import with_aggregate
from scorecard.sources import fixtures as fx


def _long(spark, rows):
    return spark.createDataFrame(
        rows, "label string, concept string, dimension string, question string, model string, score double")


def test_distributed_ranks_equal_window_ranks(spark):
    e = fx.e_scores(spark, SF01)
    ranked = distinct_value_ranks(e, ["model"], "score", "r", num_partitions=7)
    window = (e.where(F.col("score").isNotNull()).select("model", "score",
                                                         window_average_rank(["model"], "score").alias("w"))
              .distinct())
    bad = ranked.join(window, ["model", "score"], "full_outer").where(
        F.col("r").isNull() | F.col("w").isNull() | (F.col("r") != F.col("w")))
    assert bad.count() == 0


def _spearman_brute(x, y):
    x, y = pd.Series(x), pd.Series(y)
    rx, ry = x.rank(method="average"), y.rank(method="average")
    if rx.std(ddof=0) == 0 or ry.std(ddof=0) == 0:
        return None
    return float(np.corrcoef(rx, ry)[0, 1])


def test_spearman_matches_brute_force_with_ties_and_nulls(spark):
    ref = [0.1, 0.2, 0.2, 0.5, 0.9, None, 0.4]
    m1 = [0.3, 0.3, 0.1, 0.8, 0.7, 0.2, None]
    const = [0.5] * 7
    rows = []
    for i in range(7):
        for model, vals in (("ref", ref), ("m1", m1), ("const", const)):
            rows.append((str(i), "c", "d", "q", model, vals[i]))
    rows.append(("9", "c", "d", "q", "one", 0.4))  # a rater with one pair only
    rows.append(("9", "c", "d", "q", "ref", 0.7))
    res = {r["model"]: r["spearman_r"] for r in ag.spearman_overall(_long(spark, rows), "ref").collect()}
    keep = [i for i in range(7) if ref[i] is not None and m1[i] is not None]
    assert res["m1"] == pytest.approx(_spearman_brute([ref[i] for i in keep], [m1[i] for i in keep]))
    assert res["const"] is None  # constant ranks -> NULL, not an error
    assert res["one"] is None    # one complete pair -> NULL


def test_outliers_and_totals(spark):
    rows = [("a", "c", "d1", "q", "ref", 0.5), ("a", "c", "d1", "q", "x", 0.9),
            ("a", "c", "d1", "q", "y", 0.4), ("b", "c", "d2", "q", "ref", None),
            ("b", "c", "d2", "q", "x", 0.2)]
    long = with_aggregate(_long(spark, rows), ["x", "y"])
    o = {r["label"]: r for r in ag.outlier_scores(long, "ref", "y").collect()}
    assert o["a"]["max_diff"] == pytest.approx(0.4)
    assert o["a"]["mean_diff"] == pytest.approx((0.4 + 0.1 + abs(0.65 - 0.5)) / 3)
    assert o["a"]["avg_diff_excl"] == pytest.approx((0.4 + 0.15) / 2)
    assert o["b"]["max_diff"] is None  # no reference score: NULL, not -Inf
    by_dim = ag.error_by_dimension(long, "ref", "y", ["x", "y", "aggregate_models"])
    tot = ag.error_totals(by_dim).collect()[0]
    assert tot["total_mean_diff"] is None  # one dimension is NULL -> NULL like R's sum


def test_agreement_invariants_on_events(spark):
    long = with_aggregate(fx.e_scores(spark, SF01), ["click", "error", "signup", "view"], digits=6)
    for r in ag.spearman_by_dimension(long, "purchase").collect():
        assert r["spearman_r"] is None or -1.0 - 1e-12 <= r["spearman_r"] <= 1.0 + 1e-12


def test_outlier_paths_agree(spark):
    long = with_aggregate(fx.e_scores(spark, SF01), ["click", "error", "signup", "view"], digits=6)
    raters = ["click", "error", "signup", "view", "aggregate_models"]
    cols = ["label", "concept", "dimension", "question", "max_diff", "mean_diff", "avg_diff_excl"]
    for digits in (9, None):
        wide = ag.outlier_scores(long, "purchase", "view", digits=digits, raters=raters).select(*cols)
        joined = ag.outlier_scores(long, "purchase", "view", digits=digits).select(*cols)
        if digits is None:  # plain means may differ in the last bit by summation order
            wide = wide.select(*cols[:5], *[F.round(c, 12).alias(c) for c in cols[5:]])
            joined = joined.select(*cols[:5], *[F.round(c, 12).alias(c) for c in cols[5:]])
        assert wide.exceptAll(joined).count() == 0 and joined.exceptAll(wide).count() == 0


def test_pivot_pairs_equal_join_pairs(spark):
    long = with_aggregate(fx.e_scores(spark, SF01), ["click", "error", "signup", "view"], digits=6)
    raters = ["click", "error", "signup", "view", "aggregate_models"]
    a = ag.pivot_pairs(long, "purchase", raters)
    b = ag.complete_pairs(long, "purchase").select(*a.columns)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_spearman_of_five_valued_ratings(spark):
    """Many ties, raters nobody listed, raters without a pair; by windows and by prefix sums."""
    rng = np.random.default_rng(4)
    rows, scores = [], {}
    for model in ("ref", "a", "b", "unlisted"):
        scores[model] = [None if rng.random() < 0.2 else float(rng.integers(1, 6)) for _ in range(300)]
        rows += [(str(i), "c", f"d{i % 3}", "q", model, v) for i, v in enumerate(scores[model])]
    rows += [("x", "c", "d0", "q", "alone", 1.0), ("y", "c", "d0", "q", "blank", None)]
    long = _long(spark, rows)

    def brute(model, keep):
        both = [(x, y) for i, (x, y) in enumerate(zip(scores[model], scores["ref"]))
                if keep(i) and x is not None and y is not None]
        return _spearman_brute(*zip(*both)), len(both)

    for rows_by_window in (ag.WINDOW_ROWS, 0):
        table = ag.contingency(long, "ref", ["model"])
        got = {r.model: (r.spearman_r, r.n_pairs) for r in ag.spearman(table, ["model"], rows_by_window).collect()}
        assert got.keys() == {"a", "b", "unlisted", "alone", "blank"}
        assert got["alone"] == got["blank"] == (None, None)
        for m in ("a", "b", "unlisted"):
            r, n = brute(m, lambda i: True)
            assert got[m] == (pytest.approx(r), n)
    by_dim = {(r.dimension, r.model): (r.spearman_r, r.n_pairs) for r in ag.spearman_by_dimension(long, "ref").collect()}
    assert len(by_dim) == 10  # three raters in three dimensions, and "alone", which has a score
    for d in range(3):
        r, n = brute("b", lambda i, d=d: i % 3 == d)
        assert by_dim[f"d{d}", "b"] == (pytest.approx(r), n)


def test_spearman_reads_the_scores_once(spark):
    long = with_aggregate(fx.e_scores(spark, SF01), ["click", "error", "signup", "view"], digits=6)
    plan = ag.contingency(long, "purchase", ["model"])._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("FileScan") == 1
