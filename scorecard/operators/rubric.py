"""Rubric construction: flat question table <-> nested concept document.

Input is the flat rubric (``Dimension, Label, Question,
positive_contribution, Examples``) plus ``ord``, the row position in the
source file, which carries the order-dependent semantics (first-appearance
dimension order, question order inside a dimension).

A table may hold many rubrics, told apart by a column ``rubric``; every
operator below then works per rubric, and the column is kept.  Without it the
table is one rubric.  A rubric document is a single row, built in two stages
(questions of a dimension, dimensions of a rubric), so a task holds one rubric's
questions at a time; orders and totals come from a row per dimension, and no
window runs without a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WEIGHT = 1.0
#: Fixed value: where rubric documents go if no path is given.
OUTPUT_FOLDER = "eval_concepts"


def rubric_ids(flat: DataFrame) -> list[str]:
    """The columns that tell rubrics apart: ``rubric``, or none."""
    return [c for c in ("rubric",) if c in flat.columns]


def _grouped(df: DataFrame, ids: list[str]):
    """Group by rubric; a table of one rubric by a constant, which is an
    ordinary key."""
    return df.groupBy(*ids) if ids else df.groupBy(F.lit(1).alias("_one"))


def questions(flat: DataFrame) -> DataFrame:
    """RB1: project rows to question fields; missing examples -> ''."""
    return flat.select(
        *rubric_ids(flat), F.col("ord"),
        F.col("Dimension").alias("dimension"),
        F.col("Label").cast("string").alias("label"),
        F.col("Question").cast("string").alias("question"),
        F.col("positive_contribution"),
        F.coalesce(F.col("Examples").cast("string"), F.lit("")).alias("examples"),
    )


def _questions_and_order(flat: DataFrame) -> DataFrame:
    """A row per dimension: its questions in file order, their number, and the
    place of the first."""
    packed = F.struct("ord", "label", "question", "positive_contribution", "examples")
    return (questions(flat).groupBy(*rubric_ids(flat), "dimension")
            .agg(F.array_sort(F.collect_list(packed)).alias("_qs"), F.count(F.lit(1)).alias("n_questions"),
                 F.min("ord").alias("dim_ord"))
            .select(*rubric_ids(flat), "dimension", "n_questions", "dim_ord", F.transform("_qs", lambda s: F.struct(
                s["label"].alias("label"), s["question"].alias("question"),
                s["positive_contribution"].alias("positive_contribution"),
                s["examples"].alias("examples"))).alias("questions")))


def questions_by_dimension(flat: DataFrame) -> DataFrame:
    """RB2: one row per dimension with its questions in file order."""
    return _questions_and_order(flat).select(*rubric_ids(flat), "dimension", "questions")


def dimension_order(flat: DataFrame) -> DataFrame:
    """RB3: distinct dimensions with first-appearance order ``dim_pos`` (1-based)."""
    ids = rubric_ids(flat)
    first = flat.groupBy(*ids, F.col("Dimension").alias("dimension")).agg(F.min("ord").alias("dim_ord"))
    listed = _grouped(first, ids).agg(F.array_sort(F.collect_list(F.struct("dim_ord", "dimension"))).alias("_dims"))
    return (listed.select(*ids, F.posexplode("_dims").alias("_pos", "_d"))
            .select(*ids, "_d.dimension", "_d.dim_ord", (F.col("_pos") + 1).cast("bigint").alias("dim_pos")))


def dimension_weights(flat: DataFrame) -> DataFrame:
    """RB4: weight = questions in the dimension / all questions of the rubric, from one
    pass over the questions."""
    ids = rubric_ids(flat)
    dims = _grouped(_questions_and_order(flat), ids).agg(
        F.collect_list(F.struct("dimension", "n_questions", "questions")).alias("_dims"),
        F.sum("n_questions").alias("_total"))
    return (dims.select(*ids, "_total", F.inline("_dims"))
            .select(*ids, "dimension", "n_questions", (F.col("n_questions") / F.col("_total")).alias("weight"),
                    F.get("questions", 0)["label"].alias("first_label"),
                    F.transform("questions", lambda q: q["label"]).alias("question_labels")))


def concept_summary(flat: DataFrame, concept_name: str) -> DataFrame:
    """RB5: flat concept: dimension names in first-appearance order, weight 1.0."""
    ids = rubric_ids(flat)
    first = flat.groupBy(*ids, F.col("Dimension").alias("dimension")).agg(F.min("ord").alias("dim_ord"))
    listed = _grouped(first, ids).agg(F.array_sort(F.collect_list(F.struct("dim_ord", "dimension"))).alias("_dims"))
    return listed.select(
        *ids, F.lit(concept_name).alias("concept_description"),
        F.transform("_dims", lambda s: s["dimension"]).alias("dimensions"),
        F.lit(DEFAULT_WEIGHT).alias("weight"))


def long_rubric(flat: DataFrame, concept_name: str, concept_pos: int = 1) -> DataFrame:
    """Normalized rubric: one row per question with its dimension and concept.

    Columns: (rubric,) concept, concept_pos, concept_weight, dimension, dim_pos,
    dim_weight, question_label, question, positive_contribution, examples,
    q_pos.  This is what the evaluation grid joins against.  Positions and
    totals of dimensions are taken from a row per dimension and joined to the
    questions, whose own positions come from a window per dimension.
    """
    ids = rubric_ids(flat)
    per_dim = flat.groupBy(*ids, F.col("Dimension").alias("dimension")).agg(
        F.count(F.lit(1)).alias("n_q"), F.min("ord").alias("dim_ord"))
    listed = _grouped(per_dim, ids).agg(
        F.sum("n_q").alias("n_total"), F.array_sort(F.collect_list(F.struct("dim_ord", "dimension", "n_q"))).alias("_dims"))
    dims = (listed.select(*ids, "n_total", F.posexplode("_dims").alias("_pos", "_d"))
            .select(*[F.col(c).alias("_" + c) for c in ids], F.col("_d.dimension").alias("_dimension"),
                    (F.col("_pos") + 1).cast("bigint").alias("dim_pos"),
                    (F.col("_d.n_q") / F.col("n_total")).alias("dim_weight")))
    same = F.col("dimension").eqNullSafe(F.col("_dimension"))
    for c in ids:
        same = same & F.col(c).eqNullSafe(F.col("_" + c))
    by_dim = Window.partitionBy(*ids, "dimension").orderBy("ord")
    q = questions(flat).withColumn("q_pos", F.row_number().over(by_dim).cast("bigint")).join(dims, same)
    return q.select(*ids, F.lit(concept_name).alias("concept"),
                    F.lit(concept_pos).cast("bigint").alias("concept_pos"),
                    F.lit(DEFAULT_WEIGHT).alias("concept_weight"),
                    "dimension", "dim_pos", "dim_weight", F.col("label").alias("question_label"), "question",
                    "positive_contribution", "examples", "q_pos")


def nest_rubric(flat: DataFrame, concept_name: str) -> DataFrame:
    """RB6: a nested document ``concepts ARRAY<Concept>`` per rubric.

    A rubric's questions must fit a row; a table with many rubrics is built in
    as many rows, wherever their tasks are."""
    ids = rubric_ids(flat)
    per_dim = F.struct("dim_ord", "dimension", "n_questions", "questions")
    docs = _grouped(_questions_and_order(flat), ids).agg(
        F.array_sort(F.collect_list(per_dim)).alias("_dims"), F.sum("n_questions").cast("double").alias("_total"))
    dims = F.transform("_dims", lambda d: F.struct(
        d["dimension"].alias("dimension_description"), d["questions"].alias("questions"),
        (d["n_questions"] / F.col("_total")).alias("weight")))
    c = F.struct(F.lit(concept_name).alias("concept_description"), dims.alias("dimensions"),
                 F.lit(DEFAULT_WEIGHT).alias("weight"))
    return docs.select(*ids, F.array(c).alias("concepts"))


def unnest_rubric(doc: DataFrame) -> DataFrame:
    """RB8: nested rubric document -> long rubric (same columns as long_rubric)."""
    ids = rubric_ids(doc)
    c = doc.select(*ids, F.posexplode("concepts").alias("_cp", "c"))
    d = c.select(*ids, "_cp", "c.concept_description", "c.weight",
                 F.posexplode("c.dimensions").alias("_dp", "d"))
    q = d.select(*ids, "_cp", "concept_description", F.col("weight").alias("_cw"), "_dp",
                 "d.dimension_description", F.col("d.weight").alias("_dw"),
                 F.posexplode("d.questions").alias("_qp", "q"))
    return q.select(
        *ids, F.col("concept_description").alias("concept"),
        (F.col("_cp") + 1).cast("bigint").alias("concept_pos"),
        F.coalesce(F.col("_cw"), F.lit(DEFAULT_WEIGHT)).alias("concept_weight"),
        F.col("dimension_description").alias("dimension"),
        (F.col("_dp") + 1).cast("bigint").alias("dim_pos"),
        F.coalesce(F.col("_dw"), F.lit(DEFAULT_WEIGHT)).alias("dim_weight"),
        F.col("q.label").alias("question_label"), F.col("q.question").alias("question"),
        F.col("q.positive_contribution").alias("positive_contribution"),
        F.coalesce(F.col("q.examples"), F.lit("")).alias("examples"),
        (F.col("_qp") + 1).cast("bigint").alias("q_pos"))


def default_output_name(csv_path: str) -> str:
    """RB7 default output name: ``<stem lower, spaces -> _>_concept.json``."""
    stem = csv_path.rstrip("/").rsplit("/", 1)[-1]
    if stem.lower().endswith(".csv"):
        stem = stem[:-4]
    return f"{stem.lower().replace(' ', '_')}_concept.json"


def process_concept_csv(spark, csv_path: str, output_path: str | None = None,
                        concept_name: str | None = None):
    """RB7: flat rubric CSV -> nested rubric JSON document.

    Returns ``(nested_df, output_path)``.  The default concept name is the
    file stem; the default output is ``eval_concepts/<stem>_concept.json`` in the
    working folder.
    """
    from ..sources.readers import read_flat_rubric
    from ..sources.sinks import write_json

    stem = csv_path.rstrip("/").rsplit("/", 1)[-1]
    if stem.lower().endswith(".csv"):
        stem = stem[:-4]
    name = concept_name or stem
    if output_path is None:
        output_path = f"{OUTPUT_FOLDER}/{default_output_name(csv_path)}"
    nested = nest_rubric(read_flat_rubric(spark, csv_path), name)
    write_json(nested, output_path)
    return nested, output_path
