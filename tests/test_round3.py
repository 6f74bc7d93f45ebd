"""Scorer calls, the response cache, order of files, sheets and layouts."""

import math
import os

from pyspark.sql import functions as F

from conftest import SF001
from scorecard.operators import cache as ch
from scorecard.operators.scoring import PandasScorer
from scorecard.plans.evaluation import evaluate, evaluate_cached, read_cache
from scorecard.sources import fixtures as fx


def counting_model(log, short=False):
    """Answers all prompts but those with "boom"; writes a line per answered prompt and call."""
    def model(batch):
        with open(log, "a") as f:
            f.write(f"call {len(batch)}\n")
        if any("boom" in p for p in batch["user_prompt"]):
            raise RuntimeError("model unavailable")
        with open(log, "a") as f:
            f.writelines(f"paid {hash(p)}\n" for p in batch["model"] + batch["user_prompt"])
        out = [[{"token": "True", "logprob": math.log(0.75)}]] * len(batch)
        return out[:-1] if short else out
    return model


def _paid(log):
    with open(log) as f:
        lines = f.read().splitlines()
    paid = [x for x in lines if x.startswith("paid")]
    return len(paid), len(set(paid)), sum(x.startswith("call") for x in lines)


def _texts(spark, n, bad=()):
    return spark.createDataFrame([(f"t{i:03}", "boom" if i in bad else f"text number {i} of some words")
                                  for i in range(n)], "label string, input_text string")


def test_good_prompts_are_paid_once_when_a_call_fails(spark, tmpdir_path):
    log = os.path.join(tmpdir_path, "calls")
    texts, raters, rubric = _texts(spark, 40, {7, 31}).coalesce(1), fx.d_raters(spark), fx.d_rubric(spark)
    ev = evaluate(texts, raters, rubric, PandasScorer(counting_model(log), batch_rows=64), persist=True)
    n_config = raters.count() * rubric.count()
    got = {r.label: r.n for r in ev.question_scores.where("error IS NULL").groupBy("label").agg(
        F.count("*").alias("n")).collect()}
    assert got == {f"t{i:03}": n_config for i in range(40) if i not in (7, 31)}
    failed = ev.question_scores.where("error IS NOT NULL")
    assert failed.count() == 2 * n_config
    assert {r.error for r in failed.select("error").distinct().collect()} == {"RuntimeError: model unavailable"}
    assert _paid(log)[:2] == (38 * n_config, 38 * n_config)


def test_text_goes_to_python_once(spark):
    texts, config = _texts(spark, 3), fx.d_raters(spark).crossJoin(fx.d_rubric(spark))
    out = PandasScorer(lambda b: [[{"token": "True", "logprob": 0.0}]] * len(b)).respond_texts(texts, config)
    assert "input_text" not in out.columns and out.count() == 3 * config.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan  # the grid is made inside the batch


def test_wrong_number_of_answers_marks_rows(spark, tmpdir_path):
    log = os.path.join(tmpdir_path, "calls")
    ev = evaluate(_texts(spark, 2).coalesce(1), fx.d_raters(spark), fx.d_rubric(spark),
                  PandasScorer(counting_model(log, short=True), batch_rows=10), persist=True)
    errors = {r.error for r in ev.question_scores.collect()}
    assert errors and all(e and "answers to" in e for e in errors)


def test_calls_are_bounded_in_bytes():
    sizes = []

    def model(batch):
        sizes.append(sum(map(len, batch["user_prompt"])))
        return [None] * len(batch)
    scorer = PandasScorer(model, batch_bytes=1)
    assert scorer.answers([{"user_prompt": "abc"}]) == [(None, None)]
    assert sizes == [3]


def test_cache_is_not_shuffled_and_texts_only_if_missing(spark, tmpdir_path):
    log, path = os.path.join(tmpdir_path, "calls"), os.path.join(tmpdir_path, "cache")
    raters, rubric, scorer = fx.d_raters(spark), fx.d_rubric(spark), PandasScorer(counting_model(log))
    n_config = raters.count() * rubric.count()
    texts = _texts(spark, 6).unionByName(_texts(spark, 1).select(F.lit("copy").alias("label"), "input_text"))
    first = evaluate_cached(texts, raters, rubric, scorer, path, "v1", buckets=8)
    assert first.question_scores.where("lower(answer) = 'true'").count() == 7 * n_config
    assert _paid(log)[:2] == (6 * n_config, 6 * n_config)  # a copy is the same prompt
    more = texts.unionByName(_texts(spark, 8).where("label > 't005'"))
    second = evaluate_cached(more, raters, rubric, scorer, path, "v1", buckets=8)
    assert _paid(log)[:2] == (8 * n_config, 8 * n_config)
    assert second.question_scores.count() == 9 * n_config
    assert read_cache(spark, path).count() == 8 * n_config
    # the cache side of both joins has no exchange, and the work list no text
    name = ch.table(spark, path, 8)
    grid = ch.with_cache_key(more.select("label", ch.text_hash().alias("text_hash"))
                             .crossJoin(raters).crossJoin(rubric), "v1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (ch.missing(grid, spark.table(name)), ch.lookup(grid, spark.table(name))):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan
            assert plan.count("Exchange hashpartitioning(cache_key") == 1, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cached_rules_equal_plain_rules(spark, tmpdir_path):
    from scorecard.plans import queries as Q
    path = os.path.join(tmpdir_path, "cache")
    texts = fx.d_texts(spark, SF001)
    for _ in range(2):
        ev = evaluate_cached(texts, fx.d_raters(spark), fx.d_rubric(spark), fx.d_scorer(), path, "v", buckets=4)
        assert ev.text_scores.exceptAll(Q.d_evaluation(spark, SF001).text_scores).count() == 0


def _put(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, name.replace("__", ".")), "w") as f:
            f.write(text)


def test_rubric_files_keep_first_appearance_order(spark, tmpdir_path):
    from scorecard.operators import rubric as rb
    from scorecard.sources.readers import read_flat_rubric

    head = "Dimension,Label,Question,positive_contribution,Examples\n"
    folder = os.path.join(tmpdir_path, "rubrics")
    _put(folder, a__csv=head + "small,s1,Q?,true,\n",
         b__csv=head + "".join(f"large,l{i},{'Why? ' * 200},true,\n" for i in range(300)) + "small,s2,Q?,true,\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        flat = read_flat_rubric(spark, folder)
        dims = [(r.dimension, r.dim_pos) for r in rb.dimension_order(flat).orderBy("dim_pos").collect()]
        assert dims == [("small", 1), ("large", 2)]
        doc = rb.nest_rubric(flat, "c").first().concepts[0]
        assert [q.label for q in doc.dimensions[0].questions] == ["s1", "s2"]
        assert [q.label for q in doc.dimensions[1].questions] == [f"l{i}" for i in range(300)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cells_of_a_sheet_row_are_counted(spark, tmpdir_path):
    from scorecard.operators.human import clean_ratings, rejected_rows, sheet_counts
    from scorecard.sources.readers import read_rating_sheets

    folder = os.path.join(tmpdir_path, "sheets")
    _put(folder, t1__csv='Label,Question,Score\n'
         'two,Q?\nempty third,Q?,\n"q, 1","Say ""x, y""\nnow",4\nall,1,2,3,4,5,6,7,8\nten,a,3,,,,,,,j\n"only"\n')
    raw = read_rating_sheets(spark, folder)
    got = {r.label: (r.n_cells, r.score_text) for r in raw.collect()}
    assert got == {"two": (2, ""), "empty third": (3, ""), "q, 1": (3, "4"), "all": (9, "2"), "ten": (10, "3"),
                   "only": (1, "")}
    assert {r.label: r.reject_reason for r in rejected_rows(raw).collect()} == {
        "two": "short_row", "only": "short_row", "empty third": "empty_cell"}
    assert {r.label: r.score for r in clean_ratings(raw).collect()} == {"q, 1": 4, "all": 2, "ten": 3}
    c = sheet_counts(raw).first()
    assert (c.sheet_short_row, c.sheet_empty_cell, c.sheet_bad_cast, c.sheet_superseded) == (2, 1, 0, 0)


def test_mixed_layouts_in_one_folder(spark, tmpdir_path):
    from scorecard.sources.readers import BAD_RECORD, read_text_evals

    folder = os.path.join(tmpdir_path, "evals")
    one = '{"label": "%s", "input_text": "x", "aggregated_score": 0.5}'
    _put(folder, lines__json="\n".join(one % f"l{i}" for i in range(50)) + "\n", array__json=f"\n [{one % 'a0'},\n{one % 'a1'}]",
         pretty__json=(one % "p0").replace(", ", ",\n  "), empty__json="\n\n")
    got = sorted((r.text_key, r.label) for r in read_text_evals(spark, folder).collect())
    assert got == sorted([("lines", f"l{i}") for i in range(50)] + [("array", "a0"), ("array", "a1"), ("pretty", "p0")])
    _put(folder, bad__json=(one % "b0") + "\n{broken\n" + (one % "b1") + "\n")
    rows = read_text_evals(spark, folder, bad="keep")
    assert rows.count() == 53 + 3
    assert [r.text_key for r in rows.where(F.col(BAD_RECORD).isNotNull()).collect()] == ["bad"]
    try:
        read_text_evals(spark, folder).collect()
        raise AssertionError("a bad record must raise")
    except Exception as exc:  # noqa: BLE001
        assert "MALFORMED" in str(exc)


def test_response_errors(spark):
    from scorecard.functions.answers import with_parsed_responses

    whole = '{"choices":[{"logprobs":{"content":[{"token":"True","top_logprobs":[{"token":"True","logprob":-0.5}]}]}}]}'
    cases = {whole: None, whole[:50]: "broken JSON", "": "broken JSON", "[1]": "broken JSON", "{}": "no choices",
             '{"choices":[]}': "no choices", '{"choices":[{}]}': "no logprobs",
             '{"choices":[{"logprobs":{"content":[]}}]}': "empty content",
             '{"choices":[{"logprobs":{"content":[{"token":"a"}]}}]}': "no candidates"}
    df = spark.createDataFrame([(c, None) for c in cases] + [(None, None), (whole, "timeout")], "response string, error string")
    got = {r.r: r.error for r in with_parsed_responses(df.withColumn("r", F.concat_ws("|", "response", "error"))).collect()}
    assert got == {**cases, **{whole + "|timeout": "timeout"}, "": got[""]}
    assert with_parsed_responses(df.where("response IS NULL")).first().error == "no response"


def test_unlisted_raters_raise(spark):
    from scorecard.operators import agreement as ag
    from scorecard.operators.compare import other_raters, wide_by_model

    rows = [("a", "c", "d", "q", m, s) for m, s in (("ref", 0.5), ("x", 0.4), ("late", 1.0))]
    long = spark.createDataFrame(rows, "label string, concept string, dimension string, question string, model string, "
                                       "score double")
    for made in (lambda: wide_by_model(long, ["ref", "x"]), lambda: ag.outlier_scores(long, "ref", "x", raters=["x"]),
                 lambda: ag.error_by_dimension(long, "ref", "x", ["x"]), lambda: ag.pivot_pairs(long, "ref", ["x"])):
        try:
            made().collect()
            raise AssertionError("a rater vanished")
        except Exception as exc:  # noqa: BLE001
            assert "rater without a column: late" in str(exc)
    wide = wide_by_model(long, ["ref", "x", "late"])
    assert other_raters(wide.columns, "ref") == ["x", "late"]  # PV8
    assert ag.outlier_scores(long, "ref", "x", raters=["x", "late"]).first().max_diff == 0.5


def test_rows_without_a_dimension_and_empty_frames(spark):
    from scorecard.operators import agreement as ag
    from scorecard.operators import report as rp

    rows = [("a", "c", d, "q", m, s) for d in ("d", None) for m, s in (("ref", 0.5), ("x", 0.4))]
    long = spark.createDataFrame(rows, "label string, concept string, dimension string, question string, model string, "
                                       "score double")
    body = long.where("dimension IS NOT NULL")  # FL5
    assert [r.dimension for r in ag.error_by_dimension(body, "ref", "y", ["x"]).collect()] == ["d"]
    none = long.where("false")  # FL6
    assert ag.spearman_overall(none, "ref").collect() == []
    assert ag.outliers_top(none, "ref", "x", ["x"], 3).collect() == []
    dims = none.withColumn("dim_pos", F.lit(1))
    assert rp.profile_polar(rp.profile_of_scores(dims, "c", ["x"])).collect() == []


def test_rubric_document_is_read_back(spark, tmpdir_path):
    from scorecard.operators import rubric as rb
    from scorecard.sources.readers import read_rubric_json

    folder = os.path.join(tmpdir_path, "csv")
    _put(folder, My_Concept__csv="Dimension,Label,Question,positive_contribution,Examples\nd,l,Q?,true,\ne,m,R?,false,x\n")
    doc, path = rb.process_concept_csv(spark, os.path.join(folder, "My_Concept.csv"), os.path.join(tmpdir_path, "out"))
    back = read_rubric_json(spark, path)
    assert back.select("concepts").collect() == doc.select("concepts").collect()
    assert rb.unnest_rubric(back).count() == 2
