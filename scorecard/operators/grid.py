"""Evaluation grid (EV1), prompt rendering (EV2/EV3) and temperature sweep (EV12).

The grid is texts x raters x rubric questions.  Raters and rubric are
configuration, which Spark broadcasts below its own byte threshold, so the
texts are not shuffled for the expansion.  Texts are first
hash-partitioned by ``label`` (one narrow row per text), and the
broadcast nested-loop expansion keeps that partitioning, so every later
aggregation keyed by a ``label`` prefix (the whole roll-up) runs without
another exchange.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def expand(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row x every row of a configuration table.  Spark broadcasts
    it below its own byte threshold; beyond that, a distributed product."""
    return left.crossJoin(right)


def evaluation_grid(texts: DataFrame, raters: DataFrame, rubric: DataFrame,
                    num_partitions: int | None = None) -> DataFrame:
    """EV1: one row per (text, rater, question).

    ``texts`` should already be narrow (label + per-text columns the scorer
    needs); it is hash-partitioned by ``label`` here.
    """
    by_label = (texts.repartition(num_partitions, "label") if num_partitions
                else texts.repartition("label"))
    return expand(expand(by_label, raters), rubric)


# --------------------------------------------------------------------------
# Prompt templates.  Fixed values: the evaluation prompts of the reference
# pipeline (system prompt and per-question prompt, Dutch), placeholders in
# braces, blanks at line ends included.  ``{question}`` occurs twice in the question prompt.
SYSTEM_PROMPT_TEMPLATE = """
Je bent een expert in het beoordelen van teksten. Je bent gespecialiseerd in {concept}. Je beoordeelt teksten op basis van de informatie die je hebt gekregen. Je kunt alleen antwoorden met 'True' of 'False'.
Het is belangrijk dat je neutraal blijft bij de beoordeling."""

QUESTION_PROMPT_TEMPLATE = """
# Opdracht:
Je krijgt een stuk tekst te zien. Je gaat de tekst evalueren op het gebied van {concept}. Je richt je hierbij op de volgende vraag:
{question}
De vraag draait om de dimensie {dimension} van het concept {concept}. Je mag de vraag alleen beantwoorden met 'True' of 'False'. 
Bekijk de hele tekst goed. Wees hierbij erg kritisch. Geef niet het wenselijke antwoord, maar wees eerlijk. Het is beter om iets te streng te zijn dan te soepel.

# Voorbeeld informatie:
{examples}

# Tekst:
{input_text}


         
# Herhaling vraag:
{question}
         
Evalueer de tekst en beantwoordt de vraag met True of False, wees hierbij kritisch.
"""

_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split a template into ``("lit", text)`` / ``("col", name)`` parts."""
    parts, pos = [], 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(("lit", template[pos:m.start()]))
        parts.append(("col", m.group(1)))
        pos = m.end()
    if pos < len(template):
        parts.append(("lit", template[pos:]))
    return parts


def render(template: str, columns: dict[str, Column]) -> Column:
    """EV2/EV3: template -> ``concat`` of literal parts and columns.

    Substitution is positional, so braces inside a text are never
    re-substituted (unlike nested ``replace``).  NULL values render as ''.
    """
    pieces = []
    for kind, val in template_parts(template):
        if kind == "lit":
            pieces.append(F.lit(val))
        else:
            pieces.append(F.coalesce(columns[val].cast("string"), F.lit("")))
    return F.concat(*pieces)


def prompt_columns(grid: DataFrame, system_template: str = SYSTEM_PROMPT_TEMPLATE,
                   question_template: str = QUESTION_PROMPT_TEMPLATE) -> DataFrame:
    """Add ``system_prompt`` and ``user_prompt``.  The concept and dimension
    are substituted by name (the reference substitutes the whole nested
    object's repr)."""
    cols = {"concept": F.col("concept"), "dimension": F.col("dimension"),
            "question": F.col("question"), "examples": F.col("examples"),
            "input_text": F.col("input_text")}
    return grid.withColumns({"system_prompt": render(system_template, cols),
                             "user_prompt": render(question_template, cols)})


def prompt_values(values: dict) -> dict[str, str]:
    """The same prompts from a row's values, for code inside a task."""
    def filled(template: str) -> str:
        return "".join(part if kind == "lit" else "" if values.get(part) is None else str(values[part])
                       for kind, part in template_parts(template))
    return {"system_prompt": filled(SYSTEM_PROMPT_TEMPLATE), "user_prompt": filled(QUESTION_PROMPT_TEMPLATE)}


def with_temperatures(grid: DataFrame, temperatures: list[float]) -> DataFrame:
    """EV12: repeat every grid row per temperature (a config list)."""
    temps = F.explode(F.array(*[F.lit(float(t)) for t in temperatures]))
    return grid.select("*", temps.alias("temperature"))
