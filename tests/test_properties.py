"""Randomised checks against NumPy / pandas as the independent reference."""

import numpy as np
import pandas as pd

from scorecard.functions.numeric import grid_mean, round3
from scorecard.functions.ranking import distinct_value_ranks


def test_round3_equals_numpy_round(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.random(20000), np.arange(0, 1, 0.0005)])  # includes x.xxx5 ties
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = np.array([r[0] for r in df.select(round3("x")).collect()])
    assert np.array_equal(got, np.round(vals, 3))


def test_distributed_ranks_equal_pandas_average_rank(spark):
    rng = np.random.default_rng(11)
    for parts in (1, 3, 8):
        groups = rng.integers(0, 4, 400)
        values = rng.integers(0, 25, 400) / 10.0  # heavy ties
        pdf = pd.DataFrame({"g": groups, "v": values})
        df = spark.createDataFrame(pdf)
        ranks = distinct_value_ranks(df, ["g"], "v", "r", num_partitions=parts)
        got = {(int(r["g"]), float(r["v"])): r["r"] for r in ranks.collect()}
        pdf["r"] = pdf.groupby("g")["v"].rank(method="average")
        want = {(int(g), float(v)): float(r) for g, v, r in pdf.drop_duplicates(["g", "v"]).itertuples(index=False)}
        assert got == want


def test_grid_mean_equals_exact_mean(spark):
    rng = np.random.default_rng(3)
    milli = rng.integers(0, 1001, 5000)
    df = spark.createDataFrame([(float(m) / 1000.0,) for m in milli], "x double").repartition(7)
    got = df.agg(grid_mean("x", 3)).collect()[0][0]
    assert got == float(milli.sum()) / (len(milli) * 1000.0)
