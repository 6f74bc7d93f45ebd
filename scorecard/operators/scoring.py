"""Scorers (EV4) and response scoring (EV5-EV11, EV13).

A scorer turns grid rows into responses: ``top_logprobs`` (first-token
candidates, most likely first) and ``error`` (NULL on success).  Two
implementations:

* :class:`RuleScorer` - deterministic column expressions (no Python in the
  hot path); used for the driver-table fixtures and benchmarks.
* :class:`PandasScorer` - wraps an arbitrary batch function (e.g. a client of
  a hosted model); one text per Arrow row, the configuration looped inside the
  batch, calls bounded in rows and bytes, failures isolated by halving.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.answers import token_table, with_answers
from .grid import prompt_columns, prompt_values


class Scorer:
    """Interface: ``prepare`` keeps per-text columns before the grid is
    built; ``respond`` adds ``top_logprobs`` and ``error`` to grid rows."""

    def prepare(self, texts: DataFrame, extra: dict | None = None) -> DataFrame:  # pragma: no cover
        raise NotImplementedError

    def respond(self, grid: DataFrame) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError


def candidates(*pairs: tuple[str, Column]) -> Column:
    """Build a ``top_logprobs`` array from (token, logprob) pairs."""
    return F.array(*[F.struct(F.lit(tok).alias("token"), lp.cast("double").alias("logprob"))
                     for tok, lp in pairs])


def binary_candidates(p: Column) -> Column:
    """Two candidates, True with ln p and False with ln(1-p), most likely first."""
    t = ("True", F.log(p))
    f = ("False", F.log(F.lit(1.0) - p))
    return F.when(p >= F.lit(0.5), candidates(t, f)).otherwise(candidates(f, t))


class RuleScorer(Scorer):
    """Scorer defined by column expressions.

    ``features``: name -> Column over the texts table, computed once per
    text (before the grid expansion, so the text itself is not carried).
    ``logit``: function(grid columns) -> Column, the logit of "True".
    ``abstain``: optional predicate -> the single candidate (abstain_token,
    ln abstain_p), i.e. a response without a usable answer.
    ``fails``: optional predicate -> error message instead of a response.
    ``temperature``: logits are divided by ``temperature_scale(t)`` when a
    ``temperature`` column is present.
    """

    def __init__(self, features: dict[str, Column], logit: Callable[[], Column],
                 abstain: Callable[[], Column] | None = None, abstain_token: str = "Maybe",
                 abstain_p: float = 0.9, fails: Callable[[], Column] | None = None,
                 error_message: str = "scorer error", clip: float = 10.0):
        self.features = features
        self.logit = logit
        self.abstain = abstain
        self.abstain_token = abstain_token
        self.abstain_p = abstain_p
        self.fails = fails
        self.error_message = error_message
        self.clip = clip

    def prepare(self, texts: DataFrame, extra: dict | None = None) -> DataFrame:
        cols = {**self.features, **(extra or {})}
        return texts.select("label", *[c.alias(n) for n, c in cols.items()])

    def probability(self, grid: DataFrame) -> Column:
        z = self.logit()
        if "temperature" in grid.columns:
            z = z / (F.lit(0.5) + F.col("temperature"))
        z = F.greatest(F.least(z, F.lit(self.clip)), F.lit(-self.clip))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def respond(self, grid: DataFrame) -> DataFrame:
        grid = grid.withColumn("_p", self.probability(grid))  # computed once per row
        top = binary_candidates(F.col("_p"))
        if self.abstain is not None:
            top = F.when(self.abstain(), candidates(
                (self.abstain_token, F.log(F.lit(self.abstain_p))))).otherwise(top)
        if self.fails is not None:
            err = F.when(self.fails(), F.lit(self.error_message))
        else:
            err = F.lit(None).cast("string")
        return grid.withColumn("error", err).withColumn(
            "top_logprobs", F.when(F.col("error").isNull(), top)).drop("_p")


RESPONSE_FIELDS = [T.StructField("top_logprobs", schemas.TOP_LOGPROBS, True),
                   T.StructField("error", T.StringType(), True)]


class PandasScorer(Scorer):
    """Batch scorer callback (e.g. a client of a hosted model) in Arrow batches.

    ``fn(batch: pd.DataFrame) -> list`` receives rows with ``model,
    system_prompt, user_prompt`` and the other configuration columns (rubric,
    ``temperature``) and returns, per row, a list of ``{"token", "logprob"}`` dicts.

    Each text goes to Python once.  There it is put into the prompts of all
    configuration rows, which the task holds, in calls of at most ``batch_rows``
    prompts and, but for a longer single one, ``batch_bytes`` characters.  A
    call that raises is repeated in halves, until the row that fails is alone:
    it gets ``error`` and no candidates, and every other prompt is answered by one
    call.  If a call returns more or fewer answers than prompts, none can be
    told to be whose, and its rows get ``error``.
    """

    def __init__(self, fn: Callable[[pd.DataFrame], list], n_logprobs: int = 5, batch_rows: int = 256,
                 batch_bytes: int = 4 << 20):
        self.fn = fn
        self.n_logprobs = n_logprobs
        self.batch_rows, self.batch_bytes = batch_rows, batch_bytes

    def prepare(self, texts: DataFrame, extra: dict | None = None) -> DataFrame:
        return texts.select("label", "input_text", *[c.alias(n) for n, c in (extra or {}).items()])

    def answers(self, rows: list[dict]) -> list[tuple[list | None, str | None]]:
        """Candidates and error of each prompt."""
        try:
            out = list(self.fn(pd.DataFrame(rows)))
        except Exception as exc:  # noqa: BLE001 - reported as data
            if len(rows) == 1:
                return [(None, f"{type(exc).__name__}: {exc}")]
            half = len(rows) // 2
            return self.answers(rows[:half]) + self.answers(rows[half:])
        if len(out) != len(rows):
            return [(None, f"{len(out)} answers to {len(rows)} prompts")] * len(rows)
        return [(None if x is None else [{"token": c["token"], "logprob": c["logprob"]} for c in list(x)[:self.n_logprobs]],
                 None) for x in out]

    def respond_texts(self, texts: DataFrame, config: DataFrame, wanted: str | None = None) -> DataFrame:
        """The columns of ``texts`` but the text, those of ``config``, ``top_logprobs`` and
        ``error``: a row per text and row of ``config``, which the driver reads.

        With ``wanted``, an array column of ``texts``, only the configuration rows
        whose ``config_id`` it holds."""
        kept = [f for f in texts.schema.fields if f.name not in ("input_text", wanted)]
        table = config.toArrow().combine_chunks()
        setup = table.to_batches()[0] if table.num_rows else None
        values = table.to_pylist()
        schema = T.StructType([*kept, *config.schema.fields, *RESPONSE_FIELDS])
        top = pa.list_(pa.struct([("token", pa.string()), ("logprob", pa.float64())]))
        names, most_rows, most_bytes, answers = [f.name for f in kept], self.batch_rows, self.batch_bytes, self.answers

        def run(batches):
            for batch in batches:
                rows, at, size = [], [], 0

                def flushed(batch=batch):
                    found = answers(rows)
                    own = [batch.column(n).take(pa.array([i for i, _ in at], pa.int64())) for n in names]
                    conf = setup.take(pa.array([j for _, j in at], pa.int64())).columns
                    return pa.RecordBatch.from_arrays(
                        [*own, *conf, pa.array([x for x, _ in found], top), pa.array([e for _, e in found], pa.string())],
                        names=schema.names)

                asked = batch.column(wanted).to_pylist() if wanted else None
                for i, text in enumerate(batch.column("input_text")):
                    text = text.as_py() or ""
                    for j, conf in enumerate(values):
                        if asked is not None and conf["config_id"] not in asked[i]:
                            continue
                        prompts = prompt_values({**conf, "input_text": text})
                        rows.append({**conf, **prompts})
                        at.append((i, j))
                        size += len(prompts["user_prompt"])
                        if len(rows) >= most_rows or size >= most_bytes:
                            yield flushed()
                            rows, at, size = [], [], 0
                if rows:
                    yield flushed()

        return texts.mapInArrow(run, schema)

    def respond(self, grid: DataFrame) -> DataFrame:
        """Rows that already carry their text and configuration, one by one."""
        prompted = prompt_columns(grid)
        out_schema = T.StructType(list(prompted.schema.fields) + RESPONSE_FIELDS)
        most_rows, answers = self.batch_rows, self.answers

        def run(batches):
            for whole in batches:
                for at in range(0, len(whole), most_rows):
                    pdf = whole.iloc[at:at + most_rows].copy()
                    found = answers(pdf.to_dict("records"))
                    pdf["top_logprobs"], pdf["error"] = [x for x, _ in found], [e for _, e in found]
                    yield pdf

        return prompted.mapInPandas(run, out_schema)


def with_config_id(config: DataFrame) -> DataFrame:
    """``config`` with a number for each row, made of its values."""
    return config.withColumn("config_id", F.xxhash64(*config.columns))


def score_responses(responses: DataFrame, negative_mode: str = "reference") -> DataFrame:
    """EV5-EV10: responses -> answer, score, logprob, matched."""
    return with_answers(responses, negative_mode=negative_mode)


def token_probabilities(responses: DataFrame, keep: list[str], n: int = 5) -> DataFrame:
    """EV11: top-n candidate table per response."""
    return token_table(responses, n, keep)


def model_status(question_scores: DataFrame) -> DataFrame:
    """EV13: per (text, rater): ok/error, the first error, question counts."""
    return (question_scores.groupBy("label", "model")
            .agg(F.bool_or(F.col("error").isNotNull()).alias("_failed"),
                 F.min("error").alias("error"),
                 F.count(F.lit(1)).alias("n_questions"),
                 F.count("score").alias("n_scored"))
            .select("label", "model",
                    F.when(F.col("_failed"), F.lit("error")).otherwise(F.lit("ok")).alias("status"),
                    "error", "n_questions", "n_scored"))
