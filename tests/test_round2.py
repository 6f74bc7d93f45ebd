"""Faults found by review: dotted rater names, cut positions, lost rows,
cached failures, partly failed raters."""

import json

import pytest
from pyspark.sql import functions as F

from scorecard.operators import agreement as ag
from scorecard.operators import analysis, cache, compare, report, rollup
from scorecard.sources import readers, sinks

RATERS = ["gpt-3.5-turbo-0125", "a.b.c", "plain"]


def long_table(spark):
    rows = [(f"t{i}", "c", "d", f"q{i % 3}", m, (i * k % 7) / 7)
            for i in range(12) for k, m in enumerate(["ref", *RATERS], 1)]
    return spark.createDataFrame(rows, "label string, concept string, dimension string, question string, "
                                       "model string, score double")


def test_dotted_rater_names(spark):
    df = long_table(spark)
    wide = compare.wide_by_model(df, RATERS, aggregate_of=RATERS[:2])
    assert wide.columns[-4:] == [*RATERS, "aggregate_models"] and wide.count() == 12
    full = ag.outliers_top(df, "ref", RATERS[0], RATERS)
    assert full.count() == 12
    assert ag.outliers_top(df, "ref", RATERS[0], RATERS, n=5).count() == 5
    got = ag.error_by_dimension(df, "ref", RATERS[0], RATERS)
    assert f"avg_diff_{RATERS[0]}" in got.columns and got.count() == 1
    assert ag.error_totals(got).count() == 1
    assert {r.model for r in ag.spearman_overall(df, "ref", raters=RATERS).collect()} == set(RATERS)


def test_positions_beyond_999_sort(spark):
    got = spark.range(998, 1003).select("id", report._pad(F.col("id")).alias("p")).orderBy("p").collect()
    assert [r.id for r in got] == [998, 999, 1000, 1001, 1002] and len({r.p for r in got}) == 5


def test_default_read_returns_what_was_written(spark, tmpdir_path):
    df = spark.range(200).select(F.col("id").cast("string").alias("label"))
    sinks.write_json(df, f"{tmpdir_path}/run.json")
    assert readers.read_text_evals(spark, f"{tmpdir_path}/run.json").count() == 200
    named = readers.read_named_evals(spark, tmpdir_path, ["run"])
    assert named.count() == 200 and {r.text_key for r in named.select("text_key").collect()} == {"run"}
    with open(f"{tmpdir_path}/pretty.json", "w") as f:
        json.dump([{"label": "a"}, {"label": "b"}], f, indent=2)
    assert readers.read_text_evals(spark, f"{tmpdir_path}/pretty.json", multiline=True).count() == 2
    with pytest.raises(Exception):
        readers.read_text_evals(spark, f"{tmpdir_path}/pretty.json", multiline=False).collect()


def test_failures_are_not_cached(spark, tmpdir_path):
    schema = "cache_key string, top_logprobs array<struct<token: string, logprob: double>>, error string"
    rows = spark.createDataFrame([("k1", None, "rate limit"), ("k2", [("true", -0.1)], None),
                                  ("k3", [("true", -0.2)], None), ("k3", None, "late failure")], schema)
    assert {r.cache_key for r in cache.unique(rows).where("error is null").collect()} == {"k2", "k3"}
    cache.write(rows, f"{tmpdir_path}/cache")
    assert {r.cache_key for r in spark.read.parquet(f"{tmpdir_path}/cache").collect()} == {"k2", "k3"}
    assert cache.append(rows.limit(0), rows).count() == 2


def test_quoted_newline_in_a_sheet(spark, tmpdir_path):
    with open(f"{tmpdir_path}/sheet.csv", "w") as f:
        f.write("label,question,score\nq1,\"two\nlines\",4\nq2,one,5\n")
    got = readers.read_rating_sheets(spark, f"{tmpdir_path}/sheet.csv").collect()
    assert [(r.label, r.score_text) for r in got] == [("q1", "4"), ("q2", "5")]


def test_partly_failed_rater_has_no_score(spark):
    rows = [("t", "m", "c", f"d{i % 2}", 0.5, "boom" if i == 0 else None) for i in range(4)]
    rows += [("t", "ok", "c", "d0", x, None) for x in (0.455, 0.286, 0.126, 0.739)]
    q = spark.createDataFrame(rows, "label string, model string, concept string, dimension string, score double, "
                                    "error string")
    for c in ("model_pos", "concept_pos", "dim_pos"):
        q = q.withColumn(c, F.lit(1))
    q = q.withColumn("dim_weight", F.lit(1.0)).withColumn("concept_weight", F.lit(1.0))
    d = rollup.dimension_scores(q)
    c = rollup.concept_scores(d)
    assert {r.score for r in d.where("model = 'm'").collect()} == {None}
    assert [r.score for r in c.where("model = 'm'").collect()] == [None]
    assert d.where("model = 'ok' and score is not null").count() == 1
    m = {r.model: r.status for r in rollup.model_scores(c).collect()}
    assert m == {"m": "error", "ok": "ok"}


def test_cache_key_follows_the_question(spark):
    cols = ["model", *cache.RUBRIC_PARTS, "text_hash"]
    row = {"model": "m", "concept": "c", "dimension": "d", "question_label": "q", "question": "Short?",
           "examples": "", "positive_contribution": True, "text_hash": "h"}
    rows = [row, {**row, "question": "Long?"}, {**row, "examples": "e"}, {**row, "positive_contribution": False},
            {**row, "examples": None}, {**row, "concept": "c|d", "dimension": ""}, {**row, "concept": "c", "dimension": "|d"},
            {**row, "concept": "c1:d", "dimension": ""}, row]
    schema = ", ".join(f"{c} {'boolean' if c == 'positive_contribution' else 'string'}" for c in cols)
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], schema)
    keys = [r.cache_key for r in cache.with_cache_key(df, "v1").collect()]
    assert len(set(keys)) == len(rows) - 1 and keys[0] == keys[-1] and None not in keys


def test_unlisted_pivot_values_raise(spark):
    cells = spark.createDataFrame([("q", "a", 0.1), ("q", "b", 0.3), ("r", "a", 0.3), ("s", None, 0.9)],
                                  "question string, text_key string, score double")
    with pytest.raises(Exception, match="not listed"):
        analysis.pivot_cells(cells, ["question"], "text_key", ["a"]).collect()
    got = analysis.question_ranking(cells, ["question"], "text_key", ["a", "b"]).collect()
    assert [(r.question, r.position) for r in got] == [("r", 1), ("q", 2), ("s", 3)]


def test_pairs_and_aggregate_from_one_pass(spark):
    df = long_table(spark).unionByName(spark.createDataFrame(
        [("n", "c", None, "q", "ref", 0.5), ("n", "c", None, "q", "plain", 0.25), ("o", "c", "d", "q", "plain", None),
         ("o", "c", "d", "q", "ref", 0.5), ("p", "c", "d", "q", "ref", 0.5)], long_table(spark).schema))
    pairs = sorted(map(tuple, ag.complete_pairs(df, "ref").select("label", "question", "model", "score", "ref_score").collect()))
    listed = sorted(map(tuple, ag.pivot_pairs(df, "ref", RATERS).select("label", "question", "model", "score", "ref_score").collect()))
    assert pairs == listed and len(pairs) == 12 * 3 + 1
    got = compare.with_aggregate(df, RATERS)
    assert got.columns == df.columns and got.where("model <> 'aggregate_models'").exceptAll(df).count() == 0
    agg = {r.label: r.score for r in got.where("model = 'aggregate_models'").collect()}
    assert agg["n"] == 0.25 and agg["o"] is None and "p" not in agg and len(agg) == 14
