"""AS1: nested result documents (TextEval) from the long score tables.

Question -> dimension -> concept -> model -> text, built with staged
``collect_list(struct(pos, ...))`` + ``array_sort`` in the *same*
aggregations that compute the roll-up scores, and ``map_from_entries``
for the model-keyed ``evaluations``.  Each list is bounded by the rubric
(questions per dimension, dimensions per concept) or by the rater list, so
nothing grows with the number of texts; all keys start with ``label``, so
the input's label partitioning is reused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rollup


def _sorted(pos: str, value) -> F.Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), value.alias("v")))),
                       lambda s: s["v"])


def model_documents(question_scores: DataFrame, weighted: bool = False) -> DataFrame:
    """The roll-up with nested children: one row per (text, rater) with
    ``score, model_pos, weight, status`` and ``concepts_scores`` (concept ->
    dimension -> question structs, in rubric order).  One chain of three
    aggregations, all keyed by a ``label`` prefix."""
    q = question_scores
    qv = F.struct(F.col("question_label").alias("label"), "question", "answer", "score",
                  "logprob", "positive_contribution")
    dims = rollup.dimension_scores(q, extra={"questions": _sorted("q_pos", qv)})
    dv = F.struct(F.col("dimension").alias("dimension_description"), "questions",
                  F.col("score").alias("overall_score"), "weight")
    concepts = rollup.concept_scores(dims, weighted=weighted,
                                     extra={"dimensions": _sorted("dim_pos", dv)})
    cv = F.struct(F.col("concept").alias("concept_description"), "dimensions",
                  F.col("score").alias("overall_score"), "weight")
    return rollup.model_scores(concepts, extra={"concepts_scores": _sorted("concept_pos", cv)})


def assemble_text_evals(question_scores: DataFrame, texts: DataFrame | None = None,
                        rubric_doc: DataFrame | None = None, models_used: list[str] | None = None,
                        system_prompt: str = "", base_prompt: str = "",
                        timestamp: str | None = None, weighted: bool = False) -> DataFrame:
    """One row per text with the TextEval fields.

    A failed rater keeps its ModelEval struct with NULL scores (the
    reference stores ``null`` instead; readers accept both).
    """
    models = model_documents(question_scores, weighted)
    mv = F.struct(F.col("model").alias("model_name"), "concepts_scores",
                  F.col("score").alias("overall_score"), "weight")
    entry = F.struct(F.col("model").alias("k"), mv.alias("v"))
    out = rollup.text_scores(models, extra={
        "evaluations": F.map_from_entries(F.collect_list(entry)),
        "_models": _sorted("model_pos", F.col("model"))})
    out = out.select(
        "label",
        F.col("score").alias("aggregated_score"),
        "evaluations",
        F.struct(
            (F.array(*[F.lit(m) for m in models_used]) if models_used else F.col("_models"))
            .alias("models_used"),
            F.struct(F.lit(system_prompt).alias("system_prompt"),
                     F.lit(base_prompt).alias("base_prompt")).alias("evaluation_parameters"),
        ).alias("metadata"),
        (F.lit(timestamp) if timestamp else F.date_format(F.current_date(), "yyyy-MM-dd"))
        .alias("timestamp"))
    if texts is not None:
        out = out.join(texts.select("label", "input_text"), "label", "left")
    else:
        out = out.withColumn("input_text", F.lit(None).cast("string"))
    if rubric_doc is not None:
        out = out.crossJoin(rubric_doc.select("concepts"))  # one row
    else:
        out = out.withColumn("concepts", F.lit(None).cast(
            "array<struct<concept_description:string,dimensions:array<struct<"
            "dimension_description:string,questions:array<struct<label:string,question:string,"
            "positive_contribution:boolean,examples:string>>,weight:double>>,weight:double>>"))
    return out.select("label", "input_text", "concepts", "evaluations", "aggregated_score",
                      "metadata", "timestamp")
