"""Explicit schemas for every file the library reads or writes.

Nothing is inferred: JSON inference would turn the model-keyed
``evaluations`` map into a struct with one field per model name.
"""

from pyspark.sql import types as T

S, D, B, L = T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType()


def _f(name, typ, nullable=True):
    return T.StructField(name, typ, nullable)


# Flat rubric CSV (one row per question, header row).
FLAT_RUBRIC = T.StructType([
    _f("Dimension", S), _f("Label", S), _f("Question", S),
    _f("positive_contribution", B), _f("Examples", S),
])

QUESTION = T.StructType([
    _f("label", S), _f("question", S), _f("positive_contribution", B), _f("examples", S),
])
DIMENSION = T.StructType([
    _f("dimension_description", S), _f("questions", T.ArrayType(QUESTION)), _f("weight", D),
])
CONCEPT = T.StructType([
    _f("concept_description", S), _f("dimensions", T.ArrayType(DIMENSION)), _f("weight", D),
])
# Nested rubric document {"concepts": [...]}.
RUBRIC_DOC = T.StructType([_f("concepts", T.ArrayType(CONCEPT))])

TOKEN = T.StructType([_f("token", S), _f("logprob", D)])
TOP_LOGPROBS = T.ArrayType(TOKEN)

QUESTION_EVAL = T.StructType([
    _f("label", S), _f("question", S), _f("answer", S), _f("score", D),
    _f("logprob", D), _f("positive_contribution", B),
])
DIMENSION_EVAL = T.StructType([
    _f("dimension_description", S), _f("questions", T.ArrayType(QUESTION_EVAL)),
    _f("overall_score", D), _f("weight", D),
])
CONCEPT_EVAL = T.StructType([
    _f("concept_description", S), _f("dimensions", T.ArrayType(DIMENSION_EVAL)),
    _f("overall_score", D), _f("weight", D),
])
MODEL_EVAL = T.StructType([
    _f("model_name", S), _f("concepts_scores", T.ArrayType(CONCEPT_EVAL)),
    _f("overall_score", D), _f("weight", D),
])
METADATA = T.StructType([
    _f("models_used", T.ArrayType(S)),
    _f("evaluation_parameters", T.StructType([_f("system_prompt", S), _f("base_prompt", S)])),
])
# One evaluated text (an element of the result JSON array).
TEXT_EVAL = T.StructType([
    _f("label", S), _f("input_text", S), _f("concepts", T.ArrayType(CONCEPT)),
    _f("evaluations", T.MapType(S, MODEL_EVAL)), _f("aggregated_score", D),
    _f("metadata", METADATA), _f("timestamp", S),
])

# Long comparison table (CSV export); empty cells read back as NULL.
FLAT_SCORES = T.StructType([
    _f("label", S), _f("model", S), _f("concept", S), _f("dimension", S),
    _f("question", S), _f("score", D),
])

# A rating sheet exported as CSV: range A..I, column A = label, C = score.
SHEET = T.StructType([_f(f"c{i}", S) for i in range(9)])
