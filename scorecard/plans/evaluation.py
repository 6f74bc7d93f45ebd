"""PIPE1: the evaluation pipeline, texts x raters x rubric -> long score tables.

``evaluate`` wires grid -> scorer -> answer scan -> roll-up lazily and
returns an :class:`Evaluation` whose attributes are DataFrames.  With
``persist=True`` the question scores (the expensive scorer output) are
checkpointed once to the shared checkpoint folder, so the scorer runs
exactly once however many reports are derived from them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import rollup
from ..operators.grid import evaluation_grid, expand, with_temperatures
from ..operators.human import human_question_scores
from ..operators.scoring import Scorer, score_responses, with_config_id
from ..functions.partitioning import spread
from ..session import ensure_checkpoint_dir

QUESTION_COLUMNS = [
    "label", "model", "model_pos", "concept", "concept_pos", "concept_weight",
    "dimension", "dim_pos", "dim_weight", "question_label", "question", "q_pos",
    "positive_contribution", "examples", "answer", "score", "logprob", "matched", "error",
]


@dataclass
class Evaluation:
    question_scores: DataFrame
    weighted: bool = False
    extra: dict = field(default_factory=dict)

    @cached_property
    def dimension_scores(self) -> DataFrame:
        return rollup.dimension_scores(self.question_scores)

    @cached_property
    def concept_scores(self) -> DataFrame:
        return rollup.concept_scores(self.dimension_scores, weighted=self.weighted)

    @cached_property
    def model_scores(self) -> DataFrame:
        return rollup.model_scores(self.concept_scores)

    @cached_property
    def text_scores(self) -> DataFrame:
        return rollup.text_scores(self.model_scores)

    def union(self, other: "Evaluation") -> "Evaluation":
        """Evaluation over the raters of both (e.g. models + a human rater)."""
        q = self.question_scores.select(*QUESTION_COLUMNS).unionByName(
            other.question_scores.select(*QUESTION_COLUMNS))
        return Evaluation(q, weighted=self.weighted)


def _persist(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def responses(texts: DataFrame, raters: DataFrame, rubric: DataFrame, scorer: Scorer,
              num_partitions: int | None = None, text_columns: dict | None = None,
              temperatures: list[float] | None = None) -> DataFrame:
    """EV1 + EV4 (+EV12): grid rows with the scorer's ``top_logprobs`` /
    ``error``.  ``text_columns`` are extra per-text columns computed before
    the grid expansion (e.g. the text hash of the cache key).

    A scorer that takes whole texts gets each text once; other scorers get
    the rows of the grid."""
    if hasattr(scorer, "respond_texts"):
        config = expand(raters, rubric)
        if temperatures is not None:
            config = with_temperatures(config, temperatures)
        return scorer.respond_texts(scorer.prepare(spread(texts), text_columns), config)
    grid = evaluation_grid(scorer.prepare(spread(texts), text_columns), raters, rubric,
                           num_partitions)
    if temperatures is not None:
        grid = with_temperatures(grid, temperatures)
    return scorer.respond(grid)


def evaluate(texts: DataFrame, raters: DataFrame, rubric: DataFrame, scorer: Scorer,
             negative_mode: str = "reference", weighted: bool = False,
             num_partitions: int | None = None, persist: bool = False) -> Evaluation:
    """Score every text with every rater on every rubric question.

    ``texts``: label, input_text.  ``raters``: model, model_pos + scorer
    parameters.  ``rubric``: long rubric (:func:`operators.rubric.long_rubric`).
    """
    resp = responses(texts, raters, rubric, scorer, num_partitions)
    q = score_responses(resp, negative_mode).select(*QUESTION_COLUMNS)
    if persist:
        q = _persist(q)
    return Evaluation(q, weighted=weighted)


def evaluate_human(texts: DataFrame, rubric: DataFrame, ratings: DataFrame,
                   rater: str = "human", weighted: bool = False) -> Evaluation:
    """The human path: same roll-up, rater = one pseudo-model."""
    q = human_question_scores(texts, rubric, ratings, rater).select(*QUESTION_COLUMNS)
    return Evaluation(q, weighted=weighted)


def evaluate_text(spark, text: str, label: str, rubric: DataFrame, raters: DataFrame,
                  scorer: Scorer) -> Evaluation:
    """Single-text convenience call (the README's ``evaluate_text``)."""
    texts = spark.createDataFrame([(label, text)], "label string, input_text string")
    return evaluate(texts, raters, rubric, scorer)


__all__ = ["Evaluation", "evaluate", "evaluate_human", "evaluate_text", "evaluate_cached",
           "read_cache", "responses", "QUESTION_COLUMNS"]


def read_cache(spark, path: str) -> DataFrame:
    """The response cache at ``path``; an empty table if there is none yet."""
    from .. import schemas
    from pyspark.sql import types as T
    try:
        return spark.read.parquet(path).select("cache_key", "top_logprobs", "error")
    except Exception as exc:  # noqa: BLE001 - only a missing path is expected here
        if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
            raise
        schema = T.StructType([T.StructField("cache_key", T.StringType()),
                               T.StructField("top_logprobs", schemas.TOP_LOGPROBS),
                               T.StructField("error", T.StringType())])
        return spark.createDataFrame([], schema)


def evaluate_cached(texts: DataFrame, raters: DataFrame, rubric: DataFrame, scorer: Scorer,
                    cache_path: str, prompt_version: str, negative_mode: str = "reference",
                    weighted: bool = False, num_partitions: int | None = None,
                    buckets: int | None = None) -> Evaluation:
    """PIPE1 with the response cache (EV14): each distinct prompt is scored
    at most once across runs.

    Grid rows get a content-addressed key; only keys missing from the cache
    table at ``cache_path`` are scored (one row per distinct key), and the
    new responses are appended to it (this write is where the scorer runs).
    All rows are then answered from the cache, which is bucketed by key and
    not shuffled.  A scorer that takes whole texts gets each text with missing
    responses once, fetched by its hash; the work list itself has no texts.
    """
    from ..operators import cache as ch

    spark = texts.sparkSession
    name = ch.table(spark, cache_path, buckets)
    if hasattr(scorer, "respond_texts"):
        config = with_config_id(expand(raters, rubric))
        narrow = spread(texts).select("label", ch.text_hash().alias("text_hash"))
        grid = ch.with_cache_key(expand(narrow, config), prompt_version)
        todo = ch.missing(grid, spark.table(name))
        asked = scorer.respond_texts(ch.wanted_texts(texts, todo), config, "wanted")
        ch.add(ch.with_cache_key(asked, prompt_version), name)
    else:
        prepared = scorer.prepare(spread(texts), {"text_hash": ch.text_hash()})
        grid = ch.with_cache_key(evaluation_grid(prepared, raters, rubric, num_partitions), prompt_version)
        todo = ch.work_keys(ch.missing(grid, spark.table(name)))
        ch.add(scorer.respond(todo), name)
    answered = (ch.lookup(grid, spark.table(name))
                .withColumnRenamed("cached_top_logprobs", "top_logprobs")
                .withColumnRenamed("cached_error", "error"))
    q = score_responses(answered, negative_mode).select(*QUESTION_COLUMNS)
    return Evaluation(q, weighted=weighted)
