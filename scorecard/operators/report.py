"""Profiles, score bands, report lines and data-quality counts
(PR1-PR3, RP1-RP2, QA1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Score bands (upper bounds are exclusive).
BAND_LOW, BAND_MID = 0.4, 0.7
MIN_PROFILE_DIMENSIONS = 3


def score_band(score) -> Column:
    """RP1: NULL -> 'dim'; < 0.4 'red'; < 0.7 'yellow'; else 'green'."""
    s = F.col(score) if isinstance(score, str) else score
    return (F.when(s.isNull(), F.lit("dim"))
            .when(s < F.lit(BAND_LOW), F.lit("red"))
            .when(s < F.lit(BAND_MID), F.lit("yellow"))
            .otherwise(F.lit("green")))


def profile(flat: DataFrame, concept: str, models: list[str], dim_order: DataFrame,
            label: str | None = None) -> DataFrame:
    """PR1: per text, every chosen rater x every dimension of the concept
    present for that text, with the dimension-level score (missing -> 0).

    ``dim_order``: ``dimension, dim_pos`` (first-appearance order, small).
    ``label`` restricts to one text (the reference's focus); by default all
    texts are profiled.
    """
    f = flat.where((F.col("concept") == concept) & F.col("model").isin(models))
    if label is not None:
        f = f.where(F.col("label") == label)
    dims = (f.where(F.col("dimension").isNotNull() & (F.col("dimension") != ""))
            .select("label", "dimension").distinct()
            .join(dim_order, "dimension", "left"))
    # models: a short config list, expanded in place (no join)
    grid = dims.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    scores = f.where(F.col("level") == "dimension").select("label", "model", "dimension", "score")
    return (grid.join(scores, ["label", "model", "dimension"], "left")
            .select("label", "model", "dimension", "dim_pos",
                    F.coalesce(F.col("score"), F.lit(0.0)).alias("score")))


def profile_of_scores(dimension_scores: DataFrame, concept: str, models: list[str],
                      label: str | None = None) -> DataFrame:
    """PR1 from the roll-up's dimension rows: one row per text holds its raters'
    dimensions (as many as rubric and rater list have), and the profile is an
    expression over it: no distinct, no join, and the roll-up's partitioning."""
    d = dimension_scores.where((F.col("concept") == concept) & F.col("model").isin(models)
                               & F.col("dimension").isNotNull() & (F.col("dimension") != ""))
    if label is not None:
        d = d.where(F.col("label") == label)
    per = d.groupBy("label").agg(F.collect_list(F.struct("dim_pos", "dimension", "model", "score")).alias("_rows"))
    dims = F.array_sort(F.array_distinct(F.transform(
        "_rows", lambda r: F.struct(r["dim_pos"].alias("dim_pos"), r["dimension"].alias("dimension")))))

    def point(m, x):
        own = F.filter("_rows", lambda r: (r["model"] == m) & (r["dimension"] == x["dimension"]))
        return F.struct(m.alias("model"), x["dimension"].alias("dimension"), x["dim_pos"].alias("dim_pos"),
                        F.coalesce(F.get(own, F.lit(0))["score"], F.lit(0.0)).alias("score"))
    points = F.flatten(F.transform(F.array(*[F.lit(m) for m in models]),
                                   lambda m: F.transform("_dims", lambda x: point(m, x))))
    return per.withColumn("_dims", dims).select("label", F.inline(points)).select(
        "label", "model", "dimension", "dim_pos", "score")


def profile_polar(prof: DataFrame, min_dimensions: int = MIN_PROFILE_DIMENSIONS) -> DataFrame:
    """PR2 + PR3: polar points per (text, rater), angle ``2*pi*i/N``, the
    first point repeated to close the loop; only with >= 3 dimensions."""
    per = (prof.groupBy("label", "model")
           .agg(F.array_sort(F.collect_list(F.struct("dim_pos", "dimension", "score"))).alias("pts")))
    per = per.where(F.size("pts") >= min_dimensions)
    closed = F.concat(F.col("pts"), F.slice(F.col("pts"), 1, 1))
    ex = per.select("label", "model", F.size("pts").alias("n"),
                    F.posexplode(closed).alias("i", "p"))
    idx = F.when(F.col("i") < F.col("n"), F.col("i")).otherwise(F.lit(0))
    return ex.select("label", "model", (F.col("i") + 1).cast("bigint").alias("point"),
                     F.col("p.dimension").alias("dimension"),
                     (F.lit(2.0) * F.pi() * idx / F.col("n")).alias("angle"),
                     F.col("p.score").alias("score"))


def _pad(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    # wide enough for any BIGINT: a shorter one would cut, and mix up, positions
    return F.lpad(c.cast("string"), 19, "0")


def _line(path, depth: int, kind: str, name, score, answer, text) -> Column:
    return F.struct(path.alias("sort_path"), F.lit(depth).cast("bigint").alias("depth"),
                    F.lit(kind).alias("kind"), name.cast("string").alias("name"),
                    score.cast("double").alias("score"), answer.cast("string").alias("answer"),
                    text.alias("line"))


def report_lines(evaluation, texts: DataFrame | None = None) -> DataFrame:
    """RP2: the pre-order report (text -> rater -> concept -> dimension ->
    question) as rows ``label, sort_path, depth, kind, name, score, band,
    answer, line``; ``orderBy(label, sort_path)`` gives the printed order.

    ``sort_path`` holds 1-based positions within the parent (rater position,
    then concept, dimension, question).  The rows are generated in one pass
    from the staged roll-up's nested output."""
    from .assemble import model_documents
    models = model_documents(evaluation.question_scores, evaluation.weighted)
    none = F.lit(None)
    mp = _pad("model_pos")

    def questions(d, cpath, di):
        dpath = F.concat_ws(".", cpath, _pad(di + 1))
        return F.transform(F.coalesce(d["questions"], F.array()), lambda q, qi: _line(
            F.concat_ws(".", dpath, _pad(qi + 1)), 3, "question", q["question"], q["score"],
            q["answer"], F.concat(F.lit("\t\t\tQuestion: "), q["question"])))

    def dimensions(c, ci):
        cpath = F.concat_ws(".", mp, _pad(ci + 1))
        return F.concat(
            F.array(_line(cpath, 1, "concept", c["concept_description"], c["overall_score"], none,
                          F.concat(F.lit("\tConcept: "), c["concept_description"]))),
            F.flatten(F.transform(F.coalesce(c["dimensions"], F.array()), lambda d, di: F.concat(
                F.array(_line(F.concat_ws(".", cpath, _pad(di + 1)), 2, "dimension",
                              d["dimension_description"], d["overall_score"], none,
                              F.concat(F.lit("\t\tDimension: "), d["dimension_description"]))),
                questions(d, cpath, di)))))

    rows = F.concat(
        F.array(_line(mp, 0, "model", F.col("model"), F.col("score"), none,
                      F.concat(F.lit("Model: "), F.col("model")))),
        F.flatten(F.transform(F.coalesce(F.col("concepts_scores"), F.array()), dimensions)))
    out = models.select("label", F.inline(rows))
    if texts is not None:
        header = texts.select(
            "label", F.lit("000").alias("sort_path"), F.lit(0).cast("bigint").alias("depth"),
            F.lit("text").alias("kind"), F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("answer"),
            F.concat(F.lit("Input Text: "), F.coalesce(F.col("input_text"), F.lit(""))).alias("line"))
        out = header.unionByName(out)
    return out.withColumn("band", score_band("score"))


def count_rows(df: DataFrame, reason: str) -> DataFrame:
    """One ``(reason, n)`` row for a QA1 report."""
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(reason).alias("reason"), "n")


def unpivot_counts(counts: DataFrame) -> DataFrame:
    """One-row frame of named counts -> ``(reason, n)`` rows."""
    cols = counts.columns
    expr = "stack({}, {}) AS (reason, n)".format(
        len(cols), ", ".join(f"'{c}', CAST(`{c}` AS BIGINT)" for c in cols))
    return counts.selectExpr(expr)


def quality_report(parts: list[DataFrame]) -> DataFrame:
    """QA1: union of ``(reason, n)`` rows."""
    return reduce(lambda a, b: a.unionByName(b), parts)
