"""Hand-made micro-fixtures for the semantics ledger (5-10 rows each)."""

import math

import pytest
from pyspark.sql import functions as F

from scorecard.functions.answers import answer_columns
from scorecard.functions.numeric import grid_mean, round3
from scorecard.operators import rollup
from scorecard.operators.human import clean_ratings, rejected_rows

TOP = "array<struct<token:string,logprob:double>>"


def _answers(spark, rows, negative_mode="reference"):
    df = spark.createDataFrame(rows, f"id int, top_logprobs {TOP}, positive_contribution boolean")
    out = df.select("id", *[c.alias(n) for n, c in answer_columns(negative_mode=negative_mode).items()])
    return {r["id"]: r for r in out.collect()}


def test_round3_half_to_even(spark):
    df = spark.createDataFrame([(0.0625,), (0.0635,), (0.1235,), (None,)], "x double")
    got = [r[0] for r in df.select(round3("x")).collect()]
    assert got[0] == 0.062  # numpy.round(0.0625, 3)
    assert got[1] == round(0.0635, 3)
    assert got[3] is None


def test_answer_scan_cases(spark):
    lt, lf = math.log(0.8), math.log(0.3)
    rows = [
        (1, [("Maybe", -0.1), ("True", lt)], True),      # first matching, skipping others
        (2, [(" True", lt)], True),                        # no trim -> no match
        (3, [("FALSE", lf)], False),                       # case-insensitive
        (4, [], True),                                     # empty list
        (5, [("True", lt), ("False", lf)], None),          # NULL flag -> no score
        (6, [("False", lf), ("True", lt)], False),         # negative: 1 - round3(p_false)
        (7, None, True),                                   # failed response
        (8, [("Yes", -0.2), ("No", -1.0)], True),          # no match: last token lower-cased
    ]
    a = _answers(spark, rows)
    assert a[1]["answer"] == "True" and a[1]["score"] == 0.8 and a[1]["matched"]
    assert a[2]["score"] is None and a[2]["answer"] == " true" and not a[2]["matched"]
    assert a[3]["answer"] == "FALSE" and a[3]["score"] == pytest.approx(1 - 0.3)
    assert a[4]["answer"] is None and a[4]["score"] is None
    assert a[5]["score"] is None and a[5]["answer"] == "false"
    assert a[6]["score"] == pytest.approx(0.7) and a[6]["logprob"] == pytest.approx(lf)
    assert a[7]["answer"] is None and a[7]["score"] is None
    assert a[8]["answer"] == "no" and a[8]["logprob"] is None
    aligned = _answers(spark, rows, negative_mode="aligned")
    assert aligned[6]["score"] == pytest.approx(0.3)


def _q(spark, rows):
    schema = ("label string, model string, model_pos bigint, concept string, concept_pos bigint, "
              "concept_weight double, dimension string, dim_pos bigint, dim_weight double, "
              "score double, error string")
    return spark.createDataFrame(rows, schema)


def test_rollup_null_dimension_error_and_unequal_counts(spark):
    rows = [
        # text t, rater a: dimension d1 has 3 questions, d2 two, d3 all NULL
        ("t", "a", 1, "c", 1, 1.0, "d1", 1, 0.5, 0.1, None),
        ("t", "a", 1, "c", 1, 1.0, "d1", 1, 0.5, 0.2, None),
        ("t", "a", 1, "c", 1, 1.0, "d1", 1, 0.5, 0.6, None),
        ("t", "a", 1, "c", 1, 1.0, "d2", 2, 0.3, 0.5, None),
        ("t", "a", 1, "c", 1, 1.0, "d2", 2, 0.3, 1.0, None),
        ("t", "a", 1, "c", 1, 1.0, "d3", 3, 0.2, None, None),
        # rater b failed on this text
        ("t", "b", 2, "c", 1, 1.0, "d1", 1, 0.5, None, "boom"),
    ]
    q = _q(spark, rows)
    d = {(r["model"], r["dimension"]): r["score"] for r in rollup.dimension_scores(q).collect()}
    assert d[("a", "d1")] == 0.3 and d[("a", "d2")] == 0.75 and d[("a", "d3")] is None
    c = {r["model"]: r["score"] for r in rollup.concept_scores(rollup.dimension_scores(q)).collect()}
    assert c["a"] == round(round((0.3 + 0.75) / 2 * 1000) / 1000, 3)  # mean of rounded children
    m = {r["model"]: (r["score"], r["status"]) for r in
         rollup.model_scores(rollup.concept_scores(rollup.dimension_scores(q))).collect()}
    assert m["b"] == (None, "error") and m["a"][1] == "ok"
    t = rollup.text_scores(rollup.model_scores(rollup.concept_scores(rollup.dimension_scores(q))))
    row = t.collect()[0]
    assert row["score"] == m["a"][0] and row["n_models"] == 1
    # AV3-style pooled mean over question rows differs from the staged mean
    pooled = q.where("model = 'a'").agg(F.avg("score")).collect()[0][0]
    assert round(pooled, 3) != c["a"]


def test_weighted_concept_mean(spark):
    rows = [("t", "a", 1, "c", 1, 1.0, "d1", 1, 0.75, 0.2, None),
            ("t", "a", 1, "c", 1, 1.0, "d2", 2, 0.25, 0.6, None)]
    d = rollup.dimension_scores(_q(spark, rows))
    w = rollup.concept_scores(d, weighted=True).collect()[0]["score"]
    assert w == round(0.2 * 0.75 + 0.6 * 0.25, 3)


def test_grid_mean_is_order_independent(spark):
    vals = [0.01342, 0.02203, 0.03886, 0.13914]
    a = spark.createDataFrame([(v,) for v in vals], "x double").agg(grid_mean("x", 6)).collect()[0][0]
    b = spark.createDataFrame([(v,) for v in reversed(vals)], "x double").repartition(3) \
        .agg(grid_mean("x", 6)).collect()[0][0]
    assert a == b == sum(round(v * 1e6) for v in vals) / (4 * 1e6)


def test_sheet_cleaning_last_wins_and_rejects(spark):
    raw = spark.createDataFrame([
        ("s", "q1", "4", 1, 3), ("s", "q1", "2", 5, 3),       # last wins -> 2
        ("s", "q2", "", 2, 3), ("s", "", "3", 3, 3),            # empty cells
        ("s", "q3", "n/a", 4, 3), ("s", "q3", "4.0", 6, 3),      # bad casts
        ("s", "q4", " 5 ", 7, 3), ("s", "q5", "3", 8, 2),        # trimmed cast; short row
    ], "sheet string, label string, score_text string, ord bigint, n_cells bigint")
    got = {r["label"]: r["score"] for r in clean_ratings(raw).collect()}
    assert got == {"q1": 2, "q4": 5}
    reasons = sorted(r["reject_reason"] for r in rejected_rows(raw).collect())
    assert reasons == ["bad_cast", "bad_cast", "empty_cell", "empty_cell", "short_row"]


def test_strict_options(spark):
    from scorecard.operators.analysis import pivot_cells

    cells = spark.createDataFrame([("q", "a", 0.1), ("q", "a", 0.2), ("r", "a", 0.3)],
                                  "question string, text_key string, score double")
    assert pivot_cells(cells.where("question = 'r'"), ["question"], "text_key", ["a"],
                       strict=True).count() == 1
    with pytest.raises(ValueError):
        pivot_cells(cells, ["question"], "text_key", ["a"], strict=True)
    raw = spark.createDataFrame([("s", "q1", "6", 1, 3), ("s", "q2", "3", 2, 3)],
                                "sheet string, label string, score_text string, ord bigint, n_cells bigint")
    got = {r["label"]: r["score"] for r in clean_ratings(raw, strict_range=True).collect()}
    assert got == {"q1": None, "q2": 3}
