"""Mapping of the driver's tables onto the library's inputs (FIXTURES.md §2).

* D - rubric evaluation of ``documents`` (raters strict/medium/lenient via a
  rule scorer; human rater from ``labels``);
* E - long scores from ``events`` (agreement, pivots, outliers);
* L - long scores from ``lineitem`` (analysis at benchmark scale);
* P - flat rubric from ``part`` (rubric construction);
* H - raw rating sheet rows from ``events`` (sheet cleaning).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import grid_mean
from ..operators.grid import QUESTION_PROMPT_TEMPLATE, SYSTEM_PROMPT_TEMPLATE
from ..operators.rubric import long_rubric
from ..operators.scoring import RuleScorer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- fixture D
D_CONCEPT = "readability"

# The fixture D rubric, in file order
# (dimension, label, question, positive_contribution, examples).
D_RUBRIC_ROWS = [
    ("sentences", "q_sent_len", "Are the sentences short?", True, "Short sentences read easily."),
    ("sentences", "q_commas", "Do the sentences carry many commas?", False, None),
    ("words", "q_word_len", "Are the words short?", True, None),
    ("words", "q_short", "Is the text too short to judge?", False, None),
    ("structure", "q_lines", "Is the text split into many lines?", True, "One idea per line."),
    ("structure", "q_long", "Is the text very long?", False, None),
]

# Raters (model, model_pos, strictness k).
D_RATERS = [("strict", 1, 0.8), ("medium", 2, 1.0), ("lenient", 3, 1.2)]
D_MODELS = [r[0] for r in D_RATERS]
HUMAN_RATER = "human"
# Fixed values of the queries that show failures and abstentions (divisor, remainder of
# the document's id): rater "strict" fails, every rater answers "Maybe".
FAILS_AT, ABSTAINS_AT = (50, 7), (40, 3)
FAILURE = "scorer failed: no connection"

PROMPT_VERSION = hashlib.sha256(
    (SYSTEM_PROMPT_TEMPLATE + QUESTION_PROMPT_TEMPLATE).encode("utf-8")).hexdigest()


_CONFIG: dict[tuple, DataFrame] = {}


def _config(spark: SparkSession, name: str, build) -> DataFrame:
    """Configuration tables are tiny and fixed: build them once per
    application and keep them cached (recomputed from their definition if a
    cached block is lost)."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _CONFIG:
        _CONFIG[key] = build().cache()
    return _CONFIG[key]


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table built from literals inside the JVM (no Python-side
    RDD): ``inline`` of an array of literal structs."""
    st = StructType.fromDDL(schema)
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)])
               for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def d_flat_rubric(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(D_RUBRIC_ROWS)]
    return _config(spark, "d_flat_rubric", lambda: literal_table(
        spark, rows, "ord bigint, Dimension string, Label string, Question string, "
                     "positive_contribution boolean, Examples string"))


def d_rubric(spark: SparkSession) -> DataFrame:
    return _config(spark, "d_rubric", lambda: long_rubric(d_flat_rubric(spark), D_CONCEPT))


def d_raters(spark: SparkSession) -> DataFrame:
    return _config(spark, "d_raters", lambda: literal_table(
        spark, D_RATERS, "model string, model_pos bigint, k double"))


def d_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9 on documents: label = doc_id as string, input_text = text."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("label"), F.col("text").alias("input_text"))


WHITESPACE = (" ", "\n", "\t")


def _count_char(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def word_count(text: Column) -> Column:
    """Pieces of the trimmed text split on runs of space/newline/tab.

    Computed without materialising the trimmed copy: split the text itself
    and drop the empty first/last piece a leading/trailing run produces
    (an all-blank text still counts one, empty, piece).
    """
    pieces = F.size(F.split(text, r"[ \n\t]+"))
    lead = F.substring(text, 1, 1).isin(*WHITESPACE).cast("int")
    trail = F.substring(text, -1, 1).isin(*WHITESPACE).cast("int")
    return F.greatest(pieces - lead - trail, F.lit(1))


def d_features() -> dict[str, Column]:
    """Per-text features as DOUBLE: characters, words (pieces of the trimmed
    text split on runs of space/newline/tab), sentence marks, newlines,
    commas."""
    t = F.col("input_text")
    return {
        "n": F.length(t).cast("double"),
        "w": word_count(t).cast("double"),
        "st": (F.length(t) - F.length(F.regexp_replace(t, "[.!?]", ""))).cast("double"),
        "nl": _count_char(t, "\n").cast("double"),
        "cm": _count_char(t, ",").cast("double"),
    }


def d_logit() -> Column:
    """Logit of "True" per question label and rater strictness ``k``."""
    k, n, w, st, nl, cm = (F.col(c) for c in ("k", "n", "w", "st", "nl", "cm"))
    one = F.lit(1.0)
    q = F.col("question_label")
    return (F.when(q == "q_sent_len", (F.lit(12.0) * k - w / F.greatest(st, one)) / F.lit(4.0))
            .when(q == "q_commas", (cm / F.greatest(st, one) - F.lit(0.8) * k) / F.lit(0.4))
            .when(q == "q_word_len", (F.lit(6.2) * k - n / w) / F.lit(0.8))
            .when(q == "q_short", (F.lit(50.0) * k - w) / F.lit(25.0))
            .when(q == "q_lines", F.lit(100.0) * nl / w - F.lit(2.0) * k)
            .when(q == "q_long", (w - F.lit(600.0) * k) / F.lit(200.0)))


def d_scorer() -> RuleScorer:
    """Every rater answers every question of every text."""
    return RuleScorer(features=d_features(), logit=d_logit)


def d_failing_scorer() -> RuleScorer:
    """The same, but some documents, chosen by id, fail or get no usable answer."""
    def at(place: tuple[int, int]) -> Column:
        return F.col("label").cast("bigint") % F.lit(place[0]) == F.lit(place[1])
    return RuleScorer(features=d_features(), logit=d_logit, abstain=lambda: at(ABSTAINS_AT),
                      fails=lambda: (F.col("model") == "strict") & at(FAILS_AT), error_message=FAILURE)


# Kinds of raw responses, by the remainder of the document's id by 11.
RESPONSE_KINDS = {0: "broken", 1: "empty", 2: "no logprobs", 3: "no choices"}


def d_raw_responses(responses: DataFrame) -> DataFrame:
    """The scorer's candidates as the JSON text of a completion, ``response``; some
    documents have broken JSON, no content, no logprobs or no choices."""
    content = F.array(F.struct(F.get("top_logprobs", 0)["token"].alias("token"), F.col("top_logprobs")))
    first = F.struct(F.lit(0).alias("index"), F.struct(content.alias("content")).alias("logprobs"))
    whole = F.to_json(F.struct(F.lit("r").alias("id"), F.array(first).alias("choices")))
    kind = F.col("label").cast("bigint") % F.lit(11)
    return responses.withColumn("response", F.when(kind == 0, F.substring(whole, 1, 40))
                                .when(kind == 1, F.lit('{"id":"r","choices":[{"index":0,"logprobs":{"content":[]}}]}'))
                                .when(kind == 2, F.lit('{"id":"r","choices":[{"index":0,"logprobs":null}]}'))
                                .when(kind == 3, F.lit('{"id":"r","choices":[]}')).otherwise(whole))


def d_ratings(spark: SparkSession, sf_dir: str, rubric: DataFrame | None = None) -> DataFrame:
    """Human sheet per labelled document: positive questions 1+4*quality,
    negative questions 1+4*toxic.  ``sheet, label, score``."""
    rubric = rubric if rubric is not None else d_rubric(spark)
    labels = table(spark, sf_dir, "labels")
    qs = rubric.select("question_label", "positive_contribution")
    return (labels.crossJoin(qs)
            .select(F.col("doc_id").cast("string").alias("sheet"),
                    F.col("question_label").alias("label"),
                    F.when(F.col("positive_contribution"), F.lit(1) + F.lit(4) * F.col("quality"))
                    .otherwise(F.lit(1) + F.lit(4) * F.col("toxic")).cast("int").alias("score")))


def cache_flag(label: Column) -> Column:
    """Cache split: responses of documents whose doc_id % 3 = 0 are cached."""
    return (label.cast("bigint") % F.lit(3)) == F.lit(0)


# ---------------------------------------------------------------- fixture E
E_REFERENCE = "purchase"
E_MODELS = ["click", "error", "purchase", "signup", "view"]
E_EXCLUDED = "view"  # dropped from the "mean excluding one rater" summary


def e_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        "event_id",
        F.col("user_id").cast("string").alias("label"),
        F.col("event_type").alias("model"),
        F.lit("EV").alias("concept"),
        F.concat(F.lit("d"), (k % F.lit(4)).cast("string")).alias("dimension"),
        F.concat(F.lit("k"), k.cast("string")).alias("question"),
        (F.col("value") / F.lit(500.0)).alias("score"))


def e_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scores, one row per cell (duplicates averaged exactly on the
    1e-6 grid, so the value is the same whatever the summation order)."""
    return (e_raw(spark, sf_dir)
            .groupBy("label", "model", "concept", "dimension", "question")
            .agg(grid_mean("score", 6).alias("score")))


# ---------------------------------------------------------------- fixture L
L_YEARS = [str(y) for y in range(1995, 2002)]  # ship years of the generated lineitem


def l_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.year("l_shipdate").cast("string").alias("text_key"),
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("concept"),
        F.col("l_linenumber").cast("string").alias("dimension"),
        (F.col("l_suppkey") % F.lit(10)).cast("string").alias("question"),
        (F.col("l_discount") * F.lit(10.0)).alias("score"))


# ---------------------------------------------------------------- fixture P
P_CONCEPT = "parts"


def p_flat_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("ord"),
        F.col("p_brand").alias("Dimension"),
        F.col("p_partkey").cast("string").alias("Label"),
        F.col("p_name").alias("Question"),
        ((F.col("p_size") % F.lit(2)) == F.lit(0)).alias("positive_contribution"),
        F.when(F.col("p_size") >= F.lit(10), F.col("p_type")).alias("Examples"))


def p_flat_rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture P as many rubrics of 200 parts at most, told apart by ``rubric``."""
    return p_flat_rubric(spark, sf_dir).withColumn(
        "rubric", F.floor(F.col("ord") / F.lit(200)).cast("bigint"))


# ---------------------------------------------------------------- fixture H
def h_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    v = F.col("value")
    text = (F.when(v < F.lit(1.0), F.lit(""))
            .when(v < F.lit(2.0), F.lit("n/a"))
            .otherwise((F.floor(v) % F.lit(7)).cast("string")))
    return ev.select(F.col("user_id").cast("string").alias("sheet"),
                     F.col("event_type").alias("label"), text.alias("score_text"),
                     F.col("event_id").alias("ord"),
                     F.when(F.col("event_id") % F.lit(31) == F.lit(5), F.lit(2)).otherwise(F.lit(3))
                     .cast("bigint").alias("n_cells"))  # some records have no third cell
