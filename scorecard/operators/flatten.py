"""Flatten and combine (CMP1, CMP2, ANA1, ANA2).

The flat comparison table has four levels: the rater total
(``concept = 'TEXT'``), concept, dimension and question rows, with the
columns above the row's level NULL, plus an explicit ``level``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_CONCEPT = "TEXT"
FLAT_COLUMNS = ["label", "model", "concept", "dimension", "question", "score", "level"]


def _null() -> F.Column:
    return F.lit(None).cast("string")


def _rows(model_score, concepts) -> F.Column:
    """All flat rows of one rater of one text as an array of structs: the
    rater total, then concept, dimension and question rows.  Missing lists
    count as empty."""
    def empty(x):
        return F.coalesce(x, F.array())

    def row(concept, dimension, question, score, level):
        return F.struct(concept.cast("string").alias("concept"),
                        dimension.cast("string").alias("dimension"),
                        question.cast("string").alias("question"),
                        score.cast("double").alias("score"), F.lit(level).alias("level"))

    none = F.lit(None)
    cs = empty(concepts)
    top = F.array(row(F.lit(TEXT_CONCEPT), none, none, model_score, "model"))
    crow = F.transform(cs, lambda c: row(c["concept_description"], none, none, c["overall_score"],
                                         "concept"))
    drow = F.flatten(F.transform(cs, lambda c: F.transform(
        empty(c["dimensions"]), lambda d: row(c["concept_description"], d["dimension_description"],
                                              none, d["overall_score"], "dimension"))))
    qrow = F.flatten(F.transform(cs, lambda c: F.flatten(F.transform(
        empty(c["dimensions"]), lambda d: F.transform(
            empty(d["questions"]), lambda q: row(c["concept_description"], d["dimension_description"],
                                                 q["label"], q["score"], "question"))))))
    return F.concat(top, crow, drow, qrow)


def flat_from_model_documents(models: DataFrame) -> DataFrame:
    """CMP1 in one pass: one generator over the nested per-rater rows."""
    return models.select("label", "model", F.inline(_rows(F.col("score"), F.col("concepts_scores"))))


def flat_scores(evaluation) -> DataFrame:
    """CMP1 from an :class:`Evaluation` (stored, staged scores).

    The staged roll-up runs once and every level is generated from its
    nested output, so the texts are read and scored once (a union of four
    levels would run the scorer once per level)."""
    from .assemble import model_documents
    return flat_from_model_documents(
        model_documents(evaluation.question_scores, evaluation.weighted)).select(*FLAT_COLUMNS)


def flatten_text_evals(te: DataFrame) -> DataFrame:
    """CMP1 from nested TextEval rows: question column = question *label*,
    model = ``model_name`` (map key if the value is NULL).  NULL model values
    and empty lists are tolerated (one NULL row, no children).  One pass."""
    m = te.select("label", F.explode_outer("evaluations").alias("model_key", "me"))
    return m.select("label", F.coalesce(F.col("me.model_name"), F.col("model_key")).alias("model"),
                    F.inline(_rows(F.col("me.overall_score"), F.col("me.concepts_scores"))))


def eval_rows(te: DataFrame) -> DataFrame:
    """ANA1: question rows ``(label, model [map key], concept, dimension,
    question [text], score, logprob)`` from nested TextEval rows."""
    m = te.select("label", F.explode("evaluations").alias("model", "me"))
    c = m.select("label", "model", F.explode("me.concepts_scores").alias("c"))
    d = c.select("label", "model", F.col("c.concept_description").alias("concept"),
                 F.explode("c.dimensions").alias("d"))
    q = d.select("label", "model", "concept", F.col("d.dimension_description").alias("dimension"),
                 F.explode("d.questions").alias("q"))
    return q.select("label", "model", "concept", "dimension", F.col("q.question").alias("question"),
                    F.col("q.score").alias("score"), F.col("q.logprob").alias("logprob"))


def combine_eval_frames(frames: dict[str, DataFrame], key: str = "text_key") -> DataFrame:
    """ANA2: bag union of per-file frames with their key as a column."""
    tagged = [df.select(F.lit(k).alias(key), *df.columns) for k, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def tag_sources(df1: DataFrame, df2: DataFrame, names=("file1", "file2")) -> DataFrame:
    """CMP2: source-tagged UNION ALL."""
    return (df1.withColumn("source", F.lit(names[0]))
            .unionByName(df2.withColumn("source", F.lit(names[1]))))
