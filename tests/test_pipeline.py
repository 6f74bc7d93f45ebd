"""Pipeline-level checks on the driver tables and on file round trips."""

import json
import math
import os

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF001, SF01
from scorecard.operators import flatten as fl
from scorecard.operators import rubric as rb
from scorecard.operators.scoring import PandasScorer
from scorecard.plans import queries as Q
from scorecard.plans.evaluation import evaluate
from scorecard.session import local_path, shared_path
from scorecard.sources import fixtures as fx
from scorecard.sources.readers import (read_flat_rubric, read_flat_scores, read_rating_sheets,
                                       read_text_evals)
from scorecard.sources.sinks import normalize_and_export


def test_fixture_d_counts(spark):
    # every rater scores every text; of 1,000 ids, "strict" fails for 20 (7 mod 50) and
    # all three raters abstain for 25 others (3 mod 40) in the failing evaluation
    for ev, failed, blank in ((Q.d_evaluation(spark, SF01), 0, 0), (Q.d_failing(spark, SF01), 20, 25)):
        q = ev.question_scores
        assert q.count() == 18000 and q.where("score IS NULL").count() == 6 * (failed + 3 * blank)
        d = ev.dimension_scores
        assert d.count() == 9000 and d.where("score IS NULL").count() == 3 * (failed + 3 * blank)
        c = ev.concept_scores
        assert c.count() == 3000 and c.where("score IS NULL").count() == failed + 3 * blank
        t = ev.text_scores
        assert t.count() == 1000 and t.where("score IS NULL").count() == blank
    bad = q.where("score < 0 OR score > 1").count()
    assert bad == 0


def test_rubric_weights_sum_to_one_and_roundtrip(spark):
    flat = fx.p_flat_rubric(spark, SF001)
    w = rb.dimension_weights(flat).agg(F.sum("weight")).collect()[0][0]
    assert abs(w - 1.0) < 1e-12
    long = rb.long_rubric(flat, "parts")
    back = rb.unnest_rubric(rb.nest_rubric(flat, "parts"))
    assert long.exceptAll(back).count() == 0 and back.exceptAll(long).count() == 0


def test_flat_levels_sum(spark):
    ev = Q.d_evaluation(spark, SF001)
    flat = fl.flat_scores(ev)
    n = {r["level"]: r["count"] for r in flat.groupBy("level").count().collect()}
    assert n["question"] == ev.question_scores.count()
    assert n["dimension"] == ev.dimension_scores.count()
    assert n["model"] == ev.model_scores.count()


def test_rubric_csv_with_quoted_newline(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "My Rubric.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("Dimension,Label,Question,positive_contribution,Examples\n")
        f.write('clarity,q1,"Is it clear?\nReally?",true,\n')
        f.write("style,q2,Is it short?,false,e.g. short\n")
        f.write("clarity,q3,Is it plain?,true,plain words\n")
    flat = read_flat_rubric(spark, p)
    assert flat.count() == 3
    nested, out = rb.process_concept_csv(spark, p)
    assert out.endswith("my_rubric_concept.json")
    doc = spark.read.json(out).collect()[0]
    dims = doc["concepts"][0]["dimensions"]
    assert [d["dimension_description"] for d in dims] == ["clarity", "style"]
    assert [q["label"] for q in dims[0]["questions"]] == ["q1", "q3"]
    assert dims[0]["questions"][0]["examples"] == ""
    assert abs(dims[0]["weight"] - 2 / 3) < 1e-12


def test_text_eval_json_array_object_null_and_nan(spark, tmpdir_path):
    ev_a = {"label": "a", "input_text": "x", "evaluations": {
        "m1": {"model_name": "m1", "overall_score": float("nan"), "weight": 1.0, "concepts_scores": [
            {"concept_description": "c", "overall_score": 0.5, "weight": 1.0, "dimensions": [
                {"dimension_description": "d", "overall_score": 0.5, "weight": 1.0, "questions": [
                    {"label": "q", "question": "Q?", "answer": "True", "score": 0.5,
                     "logprob": -0.69, "positive_contribution": True}]}]}]},
        "m2": None}, "aggregated_score": 0.5, "timestamp": "2024-01-01"}
    with open(os.path.join(tmpdir_path, "arr.json"), "w") as f:
        f.write(json.dumps([ev_a]).replace("NaN", "NaN"))
    with open(os.path.join(tmpdir_path, "obj.json"), "w") as f:
        f.write(json.dumps(dict(ev_a, label="b")))
    te = read_text_evals(spark, [os.path.join(tmpdir_path, "arr.json"),
                                 os.path.join(tmpdir_path, "obj.json")])
    assert sorted(r["text_key"] for r in te.collect()) == ["arr", "obj"]
    flat = fl.flatten_text_evals(te)
    rows = flat.where("label = 'a'").collect()
    assert len(rows) == 5  # m1: model, concept, dimension, question; m2: one NULL row
    assert [r for r in rows if r["model"] == "m2"][0]["score"] is None
    m1 = [r for r in rows if r["model"] == "m1" and r["level"] == "model"][0]
    assert m1["score"] is None or math.isnan(m1["score"])


def test_flat_export_csv_roundtrip_and_sheets(spark, tmpdir_path):
    ev = Q.d_evaluation(spark, SF001)
    flat = fl.flat_scores(ev)
    path = os.path.join(tmpdir_path, "flat")
    exported = normalize_and_export(flat, flat, path)
    back = read_flat_scores(spark, path)
    assert exported.exceptAll(back).count() == 0
    sheets = os.path.join(tmpdir_path, "sheets")
    os.makedirs(sheets)
    with open(os.path.join(sheets, "text1.csv"), "w") as f:
        f.write("Label,Question,Score\nq1,Q?,4\nq2\nq3,Q?,5,extra\n")
    raw = read_rating_sheets(spark, sheets)
    got = {(r["sheet"], r["label"]): (r["score_text"], r["n_cells"]) for r in raw.collect()}
    assert got[("text1", "q1")] == ("4", 3) and got[("text1", "q2")][1] == 1


def test_pandas_scorer_isolates_failures(spark):
    texts = spark.createDataFrame([("t1", "one two three four five six"), ("t2", "boom")],
                                  "label string, input_text string")

    def fake_model(batch: pd.DataFrame):
        out = []
        for _, row in batch.iterrows():
            if "boom" in row["user_prompt"]:
                raise RuntimeError("model unavailable")
            out.append([{"token": "True", "logprob": math.log(0.75)},
                        {"token": "False", "logprob": math.log(0.25)}])
        return out

    ev = evaluate(texts, fx.d_raters(spark), fx.d_rubric(spark), PandasScorer(fake_model))
    q = {(r["label"], r["error"] is None) for r in ev.question_scores.collect()}
    assert q == {("t1", True), ("t2", False)}
    status = {r["label"]: r["status"] for r in ev.model_scores.collect()}
    assert status == {"t1": "ok", "t2": "error"}


def test_shared_path_under_checkpoint_dir(spark):
    p = shared_path(spark, "x")
    assert local_path(spark.sparkContext.getCheckpointDir()) in local_path(p)


def test_available_files_strips_directory_and_suffix(spark, tmpdir_path):
    from scorecard.sources.readers import available_files
    for name in ("epson_printer.json", "b1 voorbeeld.json", "notes.txt"):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write("[]")
    got = sorted(r["file"] for r in available_files(spark, tmpdir_path).collect())
    assert got == ["b1 voorbeeld", "epson_printer"]


def test_long_tables_sink_cache_append_and_strict_sheets(spark, tmpdir_path):
    from scorecard.operators import cache as ch
    from scorecard.operators.filters import ordered_dimensions
    from scorecard.operators.human import missing_sheets
    from scorecard.sources.sinks import write_long_tables

    ev = Q.d_evaluation(spark, SF001)
    out = os.path.join(tmpdir_path, "tables")
    write_long_tables({"text_scores": ev.text_scores, "dimension_scores": ev.dimension_scores},
                      out, "2024-05-01")
    back = spark.read.parquet(f"{out}/text_scores")
    assert back.where("run_date = DATE'2024-05-01'").count() == ev.text_scores.count()

    keyed = Q.d_keyed_responses(spark, SF001)
    first = keyed.where(F.col("label").cast("bigint") % 2 == 0)
    cache = ch.unique(first.select("cache_key", "top_logprobs", "error"))
    grown = ch.append(cache, keyed)
    n_keys = keyed.select("cache_key").distinct().count()
    assert grown.count() == n_keys and grown.select("cache_key").distinct().count() == n_keys
    assert ch.missing(keyed, grown).count() == 0

    texts = fx.d_texts(spark, SF001)
    ratings = fx.d_ratings(spark, SF001)
    n_labelled = spark.read.parquet(f"{SF001}/labels.parquet").count()
    assert missing_sheets(texts, ratings).count() == texts.count() - n_labelled

    dims = {r["dimension"]: r["dim_pos"] for r in ordered_dimensions(ev.dimension_scores).collect()}
    assert dims == {"sentences": 1, "words": 2, "structure": 3}


def test_persisted_evaluation_and_union_with_human(spark):
    from scorecard.plans.evaluation import evaluate_text

    texts = fx.d_texts(spark, SF001)
    ev = evaluate(texts, fx.d_raters(spark), fx.d_rubric(spark), fx.d_scorer(), persist=True)
    lazy = Q.d_evaluation(spark, SF001)
    assert ev.text_scores.exceptAll(lazy.text_scores).count() == 0
    both = ev.union(Q.d_human(spark, SF001))
    n = {r["label"]: r["n"] for r in both.model_scores.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert set(n.values()) == {4}
    one = evaluate_text(spark, "Short text. Two sentences here!", "x", fx.d_rubric(spark),
                        fx.d_raters(spark), fx.d_scorer())
    assert one.text_scores.count() == 1


def test_cached_evaluation_scores_each_prompt_once(spark, tmpdir_path):
    from scorecard.operators import cache as ch
    from scorecard.plans.evaluation import evaluate_cached, read_cache

    path = os.path.join(tmpdir_path, "responses")
    texts = fx.d_texts(spark, SF001)
    first = evaluate_cached(texts, fx.d_raters(spark), fx.d_rubric(spark), fx.d_scorer(), path,
                            fx.PROMPT_VERSION)
    want = Q.d_evaluation(spark, SF001).text_scores
    assert first.text_scores.exceptAll(want).count() == 0
    n_cached = read_cache(spark, path).count()
    assert n_cached == read_cache(spark, path).select("cache_key").distinct().count()
    # second run: nothing left to score, same results
    second = evaluate_cached(texts, fx.d_raters(spark), fx.d_rubric(spark), fx.d_scorer(), path,
                             fx.PROMPT_VERSION)
    assert read_cache(spark, path).count() == n_cached
    assert second.text_scores.exceptAll(want).count() == 0


def test_filters_push_down_to_stored_long_tables(spark, tmpdir_path):
    from scorecard.operators import filters as flt
    from scorecard.sources.sinks import write_long_tables

    ev = Q.d_evaluation(spark, SF001)
    out = os.path.join(tmpdir_path, "tables")
    write_long_tables({"question_scores": ev.question_scores.select(
        "label", "model", "concept", "dimension", "question_label", "score")}, out, "2024-05-01")
    write_long_tables({"question_scores": ev.question_scores.select(
        "label", "model", "concept", "dimension", "question_label", "score")}, out, "2024-05-02")
    stored = spark.read.parquet(f"{out}/question_scores")
    q = (flt.filter_threshold(flt.filter_dimension(stored, "words"), 0.5)
         .where(F.col("run_date") == F.lit("2024-05-02").cast("date"))
         .select("label", "score"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(dimension), IsNotNull(score), EqualTo(dimension,words), " \
           "GreaterThanOrEqual(score,0.5)]" in plan
    assert "PartitionFilters: [isnotnull(run_date" in plan
    assert "ReadSchema: struct<label:string,dimension:string,score:double>" in plan
    assert q.count() == ev.question_scores.where("dimension = 'words' AND score >= 0.5").count()
