"""Human ratings (SRC7 cleaning, HU1-HU6).

Raw sheet rows are ``sheet, label, score_text, ord, n_cells``.  A rating
sheet holds one text's 1-5 ratings keyed by question label; the human rater
is then one more rater in the same roll-up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import likert_to_unit

HUMAN_ANSWER_POSITIVE = "True"
HUMAN_ANSWER_NEGATIVE = "False"
LOG_EPSILON = 1e-9


def _reason() -> F.Column:
    return (F.when(F.col("n_cells") < 3, F.lit("short_row"))
            .when((F.col("label") == "") | (F.col("score_text") == ""), F.lit("empty_cell"))
            .when(F.col("_score").isNull(), F.lit("bad_cast")))


def classify_sheet_rows(raw: DataFrame) -> DataFrame:
    """Attach ``_score`` (INT or NULL) and ``reject_reason`` (NULL = valid)."""
    return (raw.withColumn("_score", F.expr("try_cast(score_text AS INT)"))
            .withColumn("reject_reason", _reason()))


RATING_MIN, RATING_MAX = 1, 5


def clean_ratings(raw: DataFrame, strict_range: bool = False) -> DataFrame:
    """Valid rows only, then the last row per (sheet, label) wins.

    ``max_by(score, ord)`` is a normal partial/final aggregation; a sheet
    with many rows is never gathered into one list.  Ratings outside 1..5
    are kept (and counted by QA1); ``strict_range=True`` turns them to NULL.
    """
    valid = classify_sheet_rows(raw).where(F.col("reject_reason").isNull())
    out = (valid.groupBy("sheet", "label")
           .agg(F.max_by("_score", "ord").alias("score")))
    if strict_range:
        s = F.col("score")
        out = out.withColumn("score", F.when(s.between(RATING_MIN, RATING_MAX), s))
    return out


def rejected_rows(raw: DataFrame) -> DataFrame:
    """Rows dropped before last-wins, with their reason (for QA1)."""
    return classify_sheet_rows(raw).where(F.col("reject_reason").isNotNull())


def superseded_count(raw: DataFrame) -> DataFrame:
    """Valid rows overridden by a later row of the same (sheet, label)."""
    valid = classify_sheet_rows(raw).where(F.col("reject_reason").isNull())
    return (valid.groupBy("sheet", "label").agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n")))


def sheet_counts(raw: DataFrame) -> DataFrame:
    """All QA1 counts of the sheets in one pass: a row per (sheet, label) holds
    its rejected rows by reason, its valid rows and the one that wins."""
    rows = classify_sheet_rows(raw)
    valid = F.col("reject_reason").isNull()
    reasons = ("short_row", "empty_cell", "bad_cast")
    per = rows.groupBy("sheet", "label").agg(
        *[F.count_if(F.col("reject_reason") == r).alias(r) for r in reasons],
        F.count_if(valid).alias("n"), F.max_by(F.when(valid, F.col("_score")), F.when(valid, F.col("ord"))).alias("score"))

    def total(c) -> F.Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per.agg(*[total(r).alias(f"sheet_{r}") for r in reasons],
                   total(F.greatest(F.col("n") - 1, F.lit(0))).alias("sheet_superseded"),
                   F.count_if((F.col("score") < RATING_MIN) | (F.col("score") > RATING_MAX)).alias("rating_out_of_range"))


def ratings_by_text(ratings: DataFrame) -> DataFrame:
    """One row per text: ``ratings MAP<question_label, score>``.

    The map holds at most one entry per rubric question, so its size is
    bounded by the rubric, not by the data.
    """
    return (ratings.groupBy(F.col("sheet").alias("label"))
            .agg(F.map_from_entries(F.collect_list(F.struct(
                F.col("label").alias("k"), F.col("score").alias("v")))).alias("ratings")))


def human_question_scores(texts: DataFrame, rubric: DataFrame, ratings: DataFrame,
                          rater: str = "human", model_pos: int = 1,
                          strict: bool = False) -> DataFrame:
    """HU1-HU6: rubric x texts, score = Likert-normalised rating.

    Texts join their rating map on ``label`` (both sides shuffled once, by
    label), then expand against the rubric, which Spark broadcasts below its
    own threshold; that keeps the label partitioning for the roll-up.  A missing sheet or question label
    gives a NULL score instead of the reference's KeyError/TypeError;
    ``strict=True`` raises when a text has no sheet at all (HU2).
    """
    if strict and not missing_sheets(texts, ratings).isEmpty():
        raise KeyError("texts without a rating sheet")
    # label-partitioned texts: whichever join Spark picks (broadcast of the
    # ratings or sort-merge), the grid keeps this partitioning for the roll-up
    # only ratings of rubric questions: keeps each text's map bounded by the
    # rubric even if a sheet carries many unrelated rows
    known = rubric.select(F.col("question_label").alias("label")).distinct()
    ratings = ratings.join(known, "label", "left_semi")
    base = texts.select("label").repartition("label").join(ratings_by_text(ratings), "label", "left")
    grid = base.crossJoin(rubric)
    rating = F.try_element_at(F.col("ratings"), F.col("question_label"))
    pc = F.col("positive_contribution")
    score = likert_to_unit(rating, pc)
    return grid.select(
        "label", F.lit(rater).alias("model"), F.lit(model_pos).cast("bigint").alias("model_pos"),
        "concept", "concept_pos", "concept_weight", "dimension", "dim_pos", "dim_weight",
        "question_label", "question", "q_pos", "positive_contribution", "examples",
        F.when(pc, F.lit(HUMAN_ANSWER_POSITIVE)).when(~pc, F.lit(HUMAN_ANSWER_NEGATIVE)).alias("answer"),
        score.alias("score"),
        F.log(score + F.lit(LOG_EPSILON)).alias("logprob"),
        rating.isNotNull().alias("matched"),
        rating.alias("rating"),
        F.lit(None).cast("string").alias("error"))


def missing_sheets(texts: DataFrame, ratings: DataFrame) -> DataFrame:
    """HU2 strict check: texts without any rating sheet (should be empty)."""
    sheets = ratings.select(F.col("sheet").alias("label")).distinct()
    return texts.select("label").join(sheets, "label", "left_anti")
