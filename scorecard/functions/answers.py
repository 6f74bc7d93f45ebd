"""Scoring of scorer responses: first-token top-k log-probabilities -> score.

A response holds ``top_logprobs ARRAY<STRUCT<token STRING, logprob DOUBLE>>``
(the candidates of the first answer token, most likely first).  The scan
looks for the first candidate whose lower-cased token equals ``true``
(positive question) or ``false`` (negative question); no trimming, so
``" True"`` does not match.  All of it is built-in higher-order array
functions, evaluated per row inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import round3, round_half_even, _c

# The answer tokens the scan matches (after lower-casing).
POSITIVE_TOKEN = "true"
NEGATIVE_TOKEN = "false"


def target_token(positive) -> Column:
    """'true' / 'false' by contribution flag; NULL flag -> NULL (no match)."""
    p = _c(positive)
    return F.when(p, F.lit(POSITIVE_TOKEN)).when(~p, F.lit(NEGATIVE_TOKEN))


def first_match(top_logprobs, positive) -> Column:
    """The first candidate matching the target token, or NULL."""
    target = target_token(positive)
    hits = F.filter(_c(top_logprobs), lambda x: F.lower(x["token"]) == target)
    return F.try_element_at(hits, F.lit(1))


def _scored(m: Column, last_token: Column, positive, negative_mode: str) -> dict[str, Column]:
    p = _c(positive)
    prob = round3(F.exp(m["logprob"]))
    if negative_mode == "reference":
        neg = F.lit(1.0) - prob
    elif negative_mode == "aligned":
        neg = prob
    else:
        raise ValueError(f"unknown negative_mode {negative_mode!r}")
    return {
        "answer": F.coalesce(m["token"], F.lower(last_token)),
        "score": F.when(p, prob).when(~p, neg),
        "logprob": m["logprob"],
        "matched": m.isNotNull(),
    }


#: The part of a completion that is read.
RESPONSE = ("struct<choices: array<struct<logprobs: struct<content: array<struct<token: string, "
            "top_logprobs: array<struct<token: string, logprob: double>>>>>>>, _corrupt_record: string>")


def parsed_response(response="response") -> dict[str, Column]:
    """EV5 from the JSON text of a completion: ``top_logprobs`` of the first content
    position of the first choice, and ``response_error``.

    The error is NULL if there are candidates, else says what is missing:
    ``no response``, ``broken JSON``, ``no choices``, ``no logprobs``, ``empty content`` or
    ``no candidates``."""
    r = F.from_json(_c(response), RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    choice = F.get(r["choices"], F.lit(0))
    content = choice["logprobs"]["content"]
    top = F.get(content, F.lit(0))["top_logprobs"]
    error = (F.when(_c(response).isNull(), F.lit("no response"))
             .when(r.isNull() | r["_corrupt_record"].isNotNull(), F.lit("broken JSON"))
             .when(choice.isNull(), F.lit("no choices"))
             .when(content.isNull(), F.lit("no logprobs"))
             .when(F.size(content) == 0, F.lit("empty content"))
             .when(F.coalesce(F.size(top), F.lit(0)) <= 0, F.lit("no candidates")))
    return {"top_logprobs": F.when(error.isNull(), top), "response_error": error}


def with_parsed_responses(df, response="response"):
    """Replace the JSON text by ``top_logprobs``; what is wrong with it goes to
    ``error``, unless the call had failed already."""
    staged = df.withColumns(parsed_response(response)).drop(response)
    own = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    return staged.withColumn("error", F.coalesce(own, F.col("response_error"))).drop("response_error")


def answer_columns(top_logprobs="top_logprobs",
                   positive="positive_contribution",
                   negative_mode: str = "reference") -> dict[str, Column]:
    """Columns ``answer, score, logprob, matched`` for one response row.

    * positive: ``round3(exp(lp))`` of the ``true`` candidate;
    * negative: ``1 - round3(exp(lp))`` of the ``false`` candidate (not
      re-rounded), the reference formula.  ``negative_mode="aligned"`` uses
      ``round3(exp(lp))`` of ``false`` instead, i.e. P(false).
    * no match: score and logprob NULL, the answer is the lower-cased last
      candidate scanned (NULL for an empty or missing list).
    """
    last = F.try_element_at(_c(top_logprobs), F.lit(-1))["token"]
    return _scored(first_match(top_logprobs, positive), last, positive, negative_mode)


def with_answers(df, top_logprobs="top_logprobs", positive="positive_contribution",
                 negative_mode: str = "reference"):
    """Add ``answer, score, logprob, matched`` to ``df`` (rules as in
    :func:`answer_columns`).

    The matching candidate (a higher-order ``filter``, evaluated row by row)
    is computed once into a column and then read four times."""
    staged = df.withColumns({
        "_match": first_match(top_logprobs, positive),
        "_last_token": F.try_element_at(_c(top_logprobs), F.lit(-1))["token"]})
    cols = _scored(F.col("_match"), F.col("_last_token"), positive, negative_mode)
    return staged.withColumns(cols).drop("_match", "_last_token")


def token_table(df, n: int, keep: list[str], top_logprobs="top_logprobs"):
    """Top-``n`` candidate table: 1-based ``rank``, token, logprob and
    probability in percent rounded to 2 decimals (half-to-even)."""
    exploded = df.select(*keep, F.posexplode(F.slice(_c(top_logprobs), 1, n)).alias("pos", "cand"))
    return exploded.select(
        *keep,
        (F.col("pos") + 1).cast("bigint").alias("rank"),
        F.col("cand.token").alias("token"),
        F.col("cand.logprob").alias("logprob"),
        round_half_even(F.exp(F.col("cand.logprob")) * F.lit(100.0), 2).alias("probability_pct"),
    )
