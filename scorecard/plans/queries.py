"""Registered queries: one per operator of the inventory, on the driver tables.

Each entry is ``fn(spark, sf_dir) -> DataFrame``; column names match the
SQL oracle in :mod:`scorecard.plans.oracle_sql`.  Every query reads the
whole driver tables (fixtures D, E, L, P, H).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round6
from ..operators import rubric as rb
from ..operators.grid import evaluation_grid
from ..operators.human import clean_ratings
from ..sources import fixtures as fx
from .evaluation import Evaluation, evaluate, evaluate_human

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ shared
def d_evaluation(spark: SparkSession, sf_dir: str, weighted: bool = False) -> Evaluation:
    """Fixture D: documents x {strict, medium, lenient} x readability rubric."""
    return evaluate(fx.d_texts(spark, sf_dir), fx.d_raters(spark), fx.d_rubric(spark),
                    fx.d_scorer(), weighted=weighted)


def d_failing(spark: SparkSession, sf_dir: str) -> Evaluation:
    """The same with a scorer that fails and abstains for some documents."""
    return evaluate(fx.d_texts(spark, sf_dir), fx.d_raters(spark), fx.d_rubric(spark), fx.d_failing_scorer())


def d_human(spark: SparkSession, sf_dir: str) -> Evaluation:
    rubric = fx.d_rubric(spark)
    ratings = fx.d_ratings(spark, sf_dir, rubric)
    return evaluate_human(fx.d_texts(spark, sf_dir), rubric, ratings, fx.HUMAN_RATER)


# ------------------------------------------------- phase 1: D pipeline
@query("texts")
def q_texts(spark, sf_dir):
    return fx.d_texts(spark, sf_dir)


@query("eval_grid")
def q_eval_grid(spark, sf_dir):
    texts = fx.d_texts(spark, sf_dir).select("label")
    grid = evaluation_grid(texts, fx.d_raters(spark), fx.d_rubric(spark))
    return grid.select("label", "model", "concept", "dimension", "question_label")


@query("question_scores")
def q_question_scores(spark, sf_dir):
    q = d_evaluation(spark, sf_dir).question_scores
    return q.select("label", "model", "concept", "dimension", "question_label", "question",
                    "positive_contribution", "answer", "score",
                    round6("logprob").alias("logprob"), "matched", "error")


@query("dimension_scores")
def q_dimension_scores(spark, sf_dir):
    d = d_evaluation(spark, sf_dir).dimension_scores
    return d.select("label", "model", "concept", "dimension", "score",
                    round6("weight").alias("weight"))


@query("concept_scores")
def q_concept_scores(spark, sf_dir):
    return d_evaluation(spark, sf_dir).concept_scores.select("label", "model", "concept", "score")


@query("model_scores")
def q_model_scores(spark, sf_dir):
    return d_evaluation(spark, sf_dir).model_scores.select("label", "model", "score", "status")


@query("text_scores")
def q_text_scores(spark, sf_dir):
    return d_evaluation(spark, sf_dir).text_scores.select("label", "score", "n_models")


@query("concept_scores_weighted")
def q_concept_scores_weighted(spark, sf_dir):
    ev = d_evaluation(spark, sf_dir, weighted=True)
    return ev.concept_scores.select("label", "model", "concept", "score")


# ------------------------------------------------- phase 2: rubric (P)
@query("rubric_questions")
def q_rubric_questions(spark, sf_dir):
    by_dim = rb.questions_by_dimension(fx.p_flat_rubric(spark, sf_dir))
    ex = by_dim.select("dimension", F.posexplode("questions").alias("pos", "q"))
    return ex.select("dimension", (F.col("pos") + 1).cast("bigint").alias("q_pos"),
                     "q.label", "q.question", "q.positive_contribution", "q.examples")


@query("rubric_dimensions")
def q_rubric_dimensions(spark, sf_dir):
    return rb.dimension_order(fx.p_flat_rubric(spark, sf_dir)).select("dimension", "dim_ord", "dim_pos")


@query("rubric_weights")
def q_rubric_weights(spark, sf_dir):
    w = rb.dimension_weights(fx.p_flat_rubric(spark, sf_dir))
    return w.select("dimension", "n_questions", "weight", "first_label")


@query("rubric_concept")
def q_rubric_concept(spark, sf_dir):
    c = rb.concept_summary(fx.p_flat_rubric(spark, sf_dir), fx.P_CONCEPT)
    return c.select("concept_description", F.size("dimensions").cast("bigint").alias("n_dimensions"),
                    F.concat_ws("|", "dimensions").alias("dimensions"), "weight")


@query("rubric_documents")
def q_rubric_documents(spark, sf_dir):
    """RB6, RB8 over many rubrics: a document each, and back to questions."""
    nested = rb.nest_rubric(fx.p_flat_rubrics(spark, sf_dir), fx.P_CONCEPT)
    return rb.unnest_rubric(nested)


@query("rubric_positions")
def q_rubric_positions(spark, sf_dir):
    """The long rubrics of the same table, without documents."""
    return rb.long_rubric(fx.p_flat_rubrics(spark, sf_dir), fx.P_CONCEPT)


@query("rubric_roundtrip")
def q_rubric_roundtrip(spark, sf_dir):
    nested = rb.nest_rubric(fx.p_flat_rubric(spark, sf_dir), fx.P_CONCEPT)
    return rb.unnest_rubric(nested)


# ------------------------------------------------- phase 3: human (H, D)
@query("human_scores_dedup")
def q_human_scores_dedup(spark, sf_dir):
    return clean_ratings(fx.h_raw(spark, sf_dir))


@query("human_question_scores")
def q_human_question_scores(spark, sf_dir):
    rubric = fx.d_rubric(spark)
    from ..operators.human import human_question_scores
    q = human_question_scores(fx.d_texts(spark, sf_dir), rubric,
                              fx.d_ratings(spark, sf_dir, rubric), fx.HUMAN_RATER)
    return q.select("label", "model", "concept", "dimension", "question_label", "answer", "score",
                    round6("logprob").alias("logprob"), "rating")


@query("human_rollup")
def q_human_rollup(spark, sf_dir):
    return d_human(spark, sf_dir).model_scores.select("label", "model", "score", "status")


# ------------------------------------------------- phase 4: flatten / combine
from ..operators import flatten as fl  # noqa: E402
from ..operators.assemble import assemble_text_evals  # noqa: E402
from ..operators.compare import compare_datasets  # noqa: E402
from ..operators.grid import QUESTION_PROMPT_TEMPLATE, SYSTEM_PROMPT_TEMPLATE  # noqa: E402
from ..session import shared_path  # noqa: E402
from ..sources.readers import read_flat_scores, read_text_evals  # noqa: E402
from ..sources.sinks import normalize_and_export, write_json  # noqa: E402

RUN_DATE = "2026-12-02"


def d_nested(spark, sf_dir, ev: Evaluation | None = None, with_text: bool = True):
    """AS1 over fixture D: one TextEval row per document."""
    ev = ev or d_evaluation(spark, sf_dir)
    rubric_doc = rb.nest_rubric(fx.d_flat_rubric(spark), fx.D_CONCEPT)
    texts = fx.d_texts(spark, sf_dir) if with_text else None
    return assemble_text_evals(ev.question_scores, texts=texts, rubric_doc=rubric_doc,
                               models_used=fx.D_MODELS, system_prompt=SYSTEM_PROMPT_TEMPLATE,
                               base_prompt=QUESTION_PROMPT_TEMPLATE, timestamp=RUN_DATE)


@query("flat_scores")
def q_flat_scores(spark, sf_dir):
    return fl.flat_scores(d_evaluation(spark, sf_dir))


@query("flat_export")
def q_flat_export(spark, sf_dir):
    human = fl.flat_scores(d_human(spark, sf_dir))
    model = fl.flat_scores(d_evaluation(spark, sf_dir))
    return normalize_and_export(human, model)


@query("flat_scan")
def q_flat_scan(spark, sf_dir):
    human = fl.flat_scores(d_human(spark, sf_dir))
    model = fl.flat_scores(d_evaluation(spark, sf_dir))
    path = shared_path(spark, "flat_export")
    normalize_and_export(human, model, path)
    return read_flat_scores(spark, path)


@query("eval_rows")
def q_eval_rows(spark, sf_dir):
    rows = fl.eval_rows(d_nested(spark, sf_dir, with_text=False))
    return rows.select("label", "model", "concept", "dimension", "question", "score",
                       round6("logprob").alias("logprob"))


@query("eval_union")
def q_eval_union(spark, sf_dir):
    model = fl.eval_rows(d_nested(spark, sf_dir, with_text=False))
    human_ev = d_human(spark, sf_dir)
    human = fl.eval_rows(assemble_text_evals(human_ev.question_scores, timestamp=RUN_DATE))
    both = fl.combine_eval_frames({"model_eval": model, "human_eval": human})
    return both.select("text_key", "label", "model", "concept", "dimension", "question", "score",
                       round6("logprob").alias("logprob"))


@query("nested_roundtrip")
def q_nested_roundtrip(spark, sf_dir):
    path = shared_path(spark, "model_eval_data")
    write_json(d_nested(spark, sf_dir), path)
    back = read_text_evals(spark, path, multiline=False)
    return fl.flatten_text_evals(back)


@query("compare_sources")
def q_compare_sources(spark, sf_dir):
    raw = fx.e_raw(spark, sf_dir)
    even = raw.where(F.col("event_id") % 2 == 0).drop("event_id")
    odd = raw.where(F.col("event_id") % 2 == 1).drop("event_id")
    c = compare_datasets(even, odd)
    return c.select("label", "model", "concept", "dimension", "question",
                    round6("file1").alias("file1"), round6("file2").alias("file2"),
                    round6("difference").alias("difference"))


# ------------------------------------------------- phase 5: analysis on L
from ..operators import analysis as an  # noqa: E402
from ..operators import filters as flt  # noqa: E402

L_DIGITS = 3  # scores are 3-decimal values: exact, order-independent means
L_DIMENSION = "3"
L_MODEL = "R"
L_QUESTION = ["concept", "dimension", "question"]


def _l(spark, sf_dir):
    return fx.l_scores(spark, sf_dir)


@query("avg_question")
def q_avg_question(spark, sf_dir):
    return an.avg_question(_l(spark, sf_dir), L_DIGITS)


@query("avg_dimension")
def q_avg_dimension(spark, sf_dir):
    return an.avg_dimension(_l(spark, sf_dir), L_DIGITS)


@query("avg_concept")
def q_avg_concept(spark, sf_dir):
    return an.avg_concept(_l(spark, sf_dir), L_DIGITS)


@query("cross_model")
def q_cross_model(spark, sf_dir):
    return an.cross_model(_l(spark, sf_dir), L_DIGITS)


@query("overall_by_text")
def q_overall_by_text(spark, sf_dir):
    o = an.overall_by_text(_l(spark, sf_dir), L_DIGITS)
    return o.select("text_key", round6("score").alias("score"))


@query("dim_by_text")
def q_dim_by_text(spark, sf_dir):
    o = an.dim_by_text(_l(spark, sf_dir), L_DIGITS)
    return o.select("dimension", "text_key", round6("score").alias("score"))


@query("dim_by_model")
def q_dim_by_model(spark, sf_dir):
    return an.avg_dimension(flt.filter_model(_l(spark, sf_dir), L_MODEL), L_DIGITS)


@query("filter_dimension")
def q_filter_dimension(spark, sf_dir):
    return an.avg_question(flt.filter_dimension(_l(spark, sf_dir), L_DIMENSION), L_DIGITS)


@query("filter_threshold")
def q_filter_threshold(spark, sf_dir):
    return an.avg_question(flt.filter_threshold(_l(spark, sf_dir), 0.5), L_DIGITS)


@query("filter_models")
def q_filter_models(spark, sf_dir):
    return flt.filter_models(_l(spark, sf_dir), ["A", "R"], concept="F")


@query("distinct_options")
def q_distinct_options(spark, sf_dir):
    return flt.distinct_options(_l(spark, sf_dir), ["model", "concept", "text_key", "dimension"])


@query("pivot_dimension")
def q_pivot_dimension(spark, sf_dir):
    cells = an.dim_by_text(_l(spark, sf_dir), L_DIGITS).withColumn("score", round6("score"))
    return an.pivot_cells(cells, ["dimension"], "text_key", fx.L_YEARS)


@query("pivot_question")
def q_pivot_question(spark, sf_dir):
    cells = an.avg_question(_l(spark, sf_dir), L_DIGITS)
    return an.pivot_cells(cells, L_QUESTION, "text_key", fx.L_YEARS)


@query("question_ranking")
def q_question_ranking(spark, sf_dir):
    cells = an.avg_question(_l(spark, sf_dir), L_DIGITS)
    return an.question_ranking(cells, L_QUESTION, "text_key", fx.L_YEARS)


# ------------------------------------------------- phase 6: agreement on E
from ..operators import agreement as ag  # noqa: E402
from ..operators.compare import AGGREGATE_MODEL, wide_by_model, with_aggregate  # noqa: E402

E_OTHERS = [m for m in fx.E_MODELS if m != fx.E_REFERENCE]
E_RATERS = E_OTHERS + [AGGREGATE_MODEL]
E_KEYS = ["label", "concept", "dimension", "question"]
E_DIGITS = 9  # error means on a 1e-9 grid: exact, identical under any partitioning


def e_long(spark, sf_dir):
    """Fixture E cells (FL5: rows with a dimension) plus the aggregate
    pseudo-rater (exact 1e-6 grid means)."""
    return with_aggregate(flt.with_dimension(fx.e_scores(spark, sf_dir)), E_OTHERS, digits=6)


@query("wide_by_model")
def q_wide_by_model(spark, sf_dir):
    cells = flt.with_dimension(fx.e_scores(spark, sf_dir))
    return wide_by_model(cells, fx.E_MODELS, aggregate_of=E_OTHERS, digits=6)


@query("aggregate_models")
def q_aggregate_models(spark, sf_dir):
    cells = flt.with_dimension(fx.e_scores(spark, sf_dir))
    wide = wide_by_model(cells, fx.E_MODELS, aggregate_of=E_OTHERS, digits=6)
    return wide.select(*E_KEYS, AGGREGATE_MODEL)


@query("spearman_overall")
def q_spearman_overall(spark, sf_dir):
    s = ag.spearman_overall(e_long(spark, sf_dir), fx.E_REFERENCE, raters=E_RATERS)
    return s.select("model", round6("spearman_r").alias("spearman_r"), "n_pairs")


@query("spearman_by_dimension")
def q_spearman_by_dimension(spark, sf_dir):
    s = ag.spearman_by_dimension(e_long(spark, sf_dir), fx.E_REFERENCE, raters=E_RATERS)
    return s.select("dimension", "model", round6("spearman_r").alias("spearman_r"), "n_pairs")


@query("abs_diff")
def q_abs_diff(spark, sf_dir):
    d = ag.abs_diff(e_long(spark, sf_dir), fx.E_REFERENCE)
    return d.select(*E_KEYS, "model", round6("diff").alias("diff"))


@query("outlier_scores")
def q_outlier_scores(spark, sf_dir):
    o = ag.outlier_scores(e_long(spark, sf_dir), fx.E_REFERENCE, fx.E_EXCLUDED, digits=E_DIGITS,
                          raters=E_RATERS)
    return o.select(*E_KEYS, round6("max_diff").alias("max_diff"), round6("mean_diff").alias("mean_diff"),
                    round6("avg_diff_excl").alias("avg_diff_excl"))


@query("outliers_top")
def q_outliers_top(spark, sf_dir):
    o = ag.outliers_top(e_long(spark, sf_dir), fx.E_REFERENCE, fx.E_EXCLUDED, E_RATERS, n=20,
                        digits=E_DIGITS)
    cols = [f"diff_{r}" for r in E_RATERS] + ["max_diff", "mean_diff"]
    return o.select(*E_KEYS, *[round6(c).alias(c) for c in cols])


@query("outliers_full")
def q_outliers_full(spark, sf_dir):
    o = ag.outliers_top(e_long(spark, sf_dir), fx.E_REFERENCE, fx.E_EXCLUDED, E_RATERS, digits=E_DIGITS)
    cols = [f"diff_{r}" for r in E_RATERS] + ["max_diff", "mean_diff"]
    return o.select(*E_KEYS, *[round6(c).alias(c) for c in cols])


@query("error_by_dimension")
def q_error_by_dimension(spark, sf_dir):
    e = ag.error_by_dimension(e_long(spark, sf_dir), fx.E_REFERENCE, fx.E_EXCLUDED, E_RATERS,
                              digits=E_DIGITS)
    return e.select("dimension", *[round6(c).alias(c) for c in e.columns if c != "dimension"])


@query("error_totals")
def q_error_totals(spark, sf_dir):
    e = ag.error_by_dimension(e_long(spark, sf_dir), fx.E_REFERENCE, fx.E_EXCLUDED, E_RATERS,
                              digits=E_DIGITS)
    t = ag.error_totals(e, digits=E_DIGITS)
    return t.select(*[round6(c).alias(c) for c in t.columns])


# ------------------------------------------------- phase 7: profile, report, QA
from ..operators import report as rp  # noqa: E402
from ..operators.human import sheet_counts  # noqa: E402


def _d_dim_order(spark):
    return fx.d_rubric(spark).select("dimension", "dim_pos").distinct()


@query("profile")
def q_profile(spark, sf_dir):
    return rp.profile_of_scores(d_evaluation(spark, sf_dir).dimension_scores, fx.D_CONCEPT, fx.D_MODELS)


@query("profile_polar")
def q_profile_polar(spark, sf_dir):
    prof = rp.profile_of_scores(d_evaluation(spark, sf_dir).dimension_scores, fx.D_CONCEPT, fx.D_MODELS)
    return rp.profile_polar(prof).select("label", "model", "point", "dimension", round6("angle").alias("angle"), "score")


@query("profile_of_flat")
def q_profile_of_flat(spark, sf_dir):
    """PR1 from the flat table, where dimension rows are looked up."""
    flat = fl.flat_scores(d_evaluation(spark, sf_dir))
    return rp.profile(flat, fx.D_CONCEPT, fx.D_MODELS, _d_dim_order(spark))


@query("score_bands")
def q_score_bands(spark, sf_dir):
    flat = fl.flat_scores(d_evaluation(spark, sf_dir))
    return flat.withColumn("band", rp.score_band("score"))


@query("report_lines")
def q_report_lines(spark, sf_dir):
    return rp.report_lines(d_evaluation(spark, sf_dir), fx.d_texts(spark, sf_dir))


@query("quality_report")
def q_quality_report(spark, sf_dir):
    """QA1: one pass over each source, its counts unpivoted to ``(reason, n)`` rows."""
    sheets = sheet_counts(fx.h_raw(spark, sf_dir))
    hq = d_human(spark, sf_dir).question_scores.agg(
        F.count_if(~F.col("matched")).alias("missing_rating"))
    q = d_failing(spark, sf_dir).question_scores.agg(
        F.count_if(F.col("error").isNull() & ~F.col("matched")).alias("no_answer_match"),
        F.count_if(F.col("error").isNotNull()).alias("scorer_error"))
    cells = (fx.e_raw(spark, sf_dir).groupBy("label", "model", "concept", "dimension", "question")
             .agg(F.count(F.lit(1)).alias("c"))
             .agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("duplicate_cell")))
    return rp.quality_report([rp.unpivot_counts(p) for p in (sheets, hq, q, cells)])


# ------------------------------------------------- phase 8: cache, tokens, prompts
from ..functions.answers import answer_columns, with_parsed_responses  # noqa: E402
from ..operators import cache as ch  # noqa: E402
from ..operators.grid import expand, prompt_columns  # noqa: E402
from ..operators.rollup import run_metadata  # noqa: E402
from ..operators.scoring import model_status, score_responses, token_probabilities  # noqa: E402
from .evaluation import responses  # noqa: E402

SWEEP_TEMPERATURES = [0.0, 0.5, 1.0]


def d_keyed_responses(spark, sf_dir, texts=None):
    texts = texts if texts is not None else fx.d_texts(spark, sf_dir)
    resp = responses(texts, fx.d_raters(spark), fx.d_rubric(spark), fx.d_scorer(),
                     text_columns={"text_hash": ch.text_hash()})
    return ch.with_cache_key(resp, fx.PROMPT_VERSION)


def d_cache(spark, sf_dir):
    """Cache table: responses already computed for the cached documents."""
    cached_texts = fx.d_texts(spark, sf_dir).where(fx.cache_flag(F.col("label")))
    return d_keyed_responses(spark, sf_dir, cached_texts).select("cache_key", "top_logprobs", "error")


def d_keyed_grid(spark, sf_dir):
    texts = fx.d_texts(spark, sf_dir).select("label", ch.text_hash().alias("text_hash"))
    return ch.with_cache_key(evaluation_grid(texts, fx.d_raters(spark), fx.d_rubric(spark)),
                             fx.PROMPT_VERSION)


@query("cache_missing")
def q_cache_missing(spark, sf_dir):
    todo = ch.missing(d_keyed_grid(spark, sf_dir), d_cache(spark, sf_dir))
    return todo.select("label", "model", "question_label", "cache_key")


@query("cache_lookup")
def q_cache_lookup(spark, sf_dir):
    hit = ch.lookup(d_keyed_grid(spark, sf_dir), d_cache(spark, sf_dir))
    cols = answer_columns(top_logprobs="cached_top_logprobs")
    return hit.select("label", "model", "question_label", "cached",
                      cols["score"].alias("cached_score"))


@query("token_probabilities")
def q_token_probabilities(spark, sf_dir):
    resp = responses(fx.d_texts(spark, sf_dir), fx.d_raters(spark), fx.d_rubric(spark), fx.d_scorer())
    t = token_probabilities(resp, ["label", "model", "question_label"], n=5)
    return t.select("label", "model", "question_label", "rank", "token",
                    round6("logprob").alias("logprob"), "probability_pct")


@query("token_sweep")
def q_token_sweep(spark, sf_dir):
    resp = responses(fx.d_texts(spark, sf_dir), fx.d_raters(spark), fx.d_rubric(spark), fx.d_scorer(),
                     temperatures=SWEEP_TEMPERATURES)
    t = token_probabilities(resp, ["label", "model", "question_label", "temperature"], n=3)
    return t.select("label", "model", "question_label", "temperature", "rank", "token",
                    round6("logprob").alias("logprob"), "probability_pct")


@query("prompt_render")
def q_prompt_render(spark, sf_dir):
    grid = expand(fx.d_texts(spark, sf_dir), fx.d_rubric(spark))
    p = prompt_columns(grid)
    return p.select("label", "concept", "dimension", "question_label", "system_prompt", "user_prompt")


@query("stored_scores")
def q_stored_scores(spark, sf_dir):
    """SNK2: two days of long tables, the second written twice; that day read back."""
    from ..session import shared_path
    from ..sources.sinks import write_long_tables

    at = shared_path(spark, "long-tables")
    scores = d_evaluation(spark, sf_dir).dimension_scores.select("label", "model", "concept", "dimension", "score")
    for day in ("2024-05-01", "2024-05-02", "2024-05-02"):
        write_long_tables({"dimension_scores": scores}, at, day)
    stored = spark.read.parquet(f"{at}/dimension_scores")
    return stored.where(F.col("run_date") == F.lit("2024-05-02").cast("date"))


@query("model_status")
def q_model_status(spark, sf_dir):
    return model_status(d_failing(spark, sf_dir).question_scores)


@query("failed_scores")
def q_failed_scores(spark, sf_dir):
    """EV9, EV13: questions without a usable answer or with a failed call, and what
    the roll-up makes of them."""
    ev = d_failing(spark, sf_dir)
    m = ev.model_scores.select("label", "model", F.col("score").alias("model_score"))
    t = ev.text_scores.select("label", F.col("score").alias("text_score"))
    return (ev.question_scores.select("label", "model", "question_label", "answer", "score", "matched", "error")
            .join(m, ["label", "model"]).join(t, "label"))


@query("response_content")
def q_response_content(spark, sf_dir):
    """EV5 from raw responses, some of them broken or without content."""
    resp = responses(fx.d_texts(spark, sf_dir), fx.d_raters(spark), fx.d_rubric(spark), fx.d_scorer())
    raw = fx.d_raw_responses(resp).drop("top_logprobs")
    q = score_responses(with_parsed_responses(raw))
    return q.select("label", "model", "question_label", "answer", "score", "error")


@query("run_metadata")
def q_run_metadata(spark, sf_dir):
    md = run_metadata(d_evaluation(spark, sf_dir).question_scores, SYSTEM_PROMPT_TEMPLATE,
                      QUESTION_PROMPT_TEMPLATE)
    return md.select("label", F.concat_ws(",", "models_used").alias("models_used"),
                     "system_prompt", "base_prompt")
