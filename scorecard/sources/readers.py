"""Readers (SRC1-SRC9).  All use explicit schemas; order-dependent inputs get
an ``ord`` column assigned at the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def _with_ord(df: DataFrame) -> DataFrame:
    """``ord``: the file's path and the row's place in it.

    With multiLine=true a file is read by one task from its start, so the
    generated number ascends along the file, wherever the file was packed;
    the path orders the files, which Spark itself reads largest first."""
    return df.withColumn("ord", F.struct(F.col("_metadata.file_path").alias("file"),
                                         F.monotonically_increasing_id().alias("row")))


def read_flat_rubric(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: rubric CSV with header; fails fast on malformed rows.  Rows of several
    files are in the order of the files' paths."""
    df = (spark.read.schema(schemas.FLAT_RUBRIC)
          .option("header", True).option("multiLine", True)
          .option("mode", "FAILFAST").option("escape", '"')
          .csv(path))
    return _with_ord(df)


def read_rubric_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: nested rubric document ``{"concepts": [...]}``."""
    return spark.read.schema(schemas.RUBRIC_DOC).option("multiLine", True).json(path)


#: The column of records that are no JSON, where they are kept.
BAD_RECORD = "_corrupt_record"


def json_layouts(spark: SparkSession, paths: list[str]) -> dict[str, bool]:
    """For each file with content whether it is one value over all its lines (an array,
    or an object written over several lines) instead of an object a line.

    Its first line that is not blank tells; the driver gets a row a file."""
    lines = (spark.read.text(paths).withColumn("row", F.monotonically_increasing_id())
             .select(F.col("_metadata.file_path").alias("file"), "row", F.trim("value").alias("line"),
                     F.col("_metadata.file_block_start").alias("at"))
             .where(F.col("line") != ""))
    first = lines.groupBy("file").agg(F.min_by(F.struct("line"), F.struct("at", "row")).alias("first"))
    whole = F.col("first.line").startswith("[") | F.get_json_object("first.line", "$").isNull()
    return {r["file"]: r["whole"] for r in first.select("file", whole.alias("whole")).collect()}


def read_text_evals(spark: SparkSession, paths, multiline: bool | None = None, bad: str = "raise") -> DataFrame:
    """SRC3/SRC4: evaluation results with ``text_key`` = file stem.

    Files may hold an object a line, as the library's own sinks write, or one
    array or object over several lines; each file's layout is looked up
    (:func:`json_layouts`), unless ``multiline`` states it for all.  Records that
    are no JSON raise; with ``bad="keep"`` they are rows with the record in
    ``_corrupt_record`` and nothing else but ``text_key``."""
    if isinstance(paths, str):
        paths = [paths]
    if multiline is None:
        found = json_layouts(spark, list(paths))
        parts = [read_text_evals(spark, sorted(f for f, w in found.items() if w is whole), whole, bad)
                 for whole in (False, True) if whole in found.values()]
        if parts:
            return reduce(DataFrame.unionByName, parts)
        multiline = False  # nothing but empty files
    schema = schemas.TEXT_EVAL if bad == "raise" else T.StructType(
        [*schemas.TEXT_EVAL.fields, T.StructField(BAD_RECORD, T.StringType())])
    df = (spark.read.schema(schema)
          .option("multiLine", multiline).option("allowNonNumericNumbers", True)
          .option("mode", "FAILFAST" if bad == "raise" else "PERMISSIVE")
          .option("columnNameOfCorruptRecord", BAD_RECORD)
          .json(list(paths)))
    return df.withColumn("text_key", F.regexp_replace(F.col("_metadata.file_name"),
                                                      r"\.json$", ""))


def read_named_evals(spark: SparkSession, base_dir: str, names: list[str],
                     multiline: bool | None = None) -> DataFrame:
    """SRC3: the results ``<base_dir>/<name>.json`` of the given names, each a
    file or a folder that a sink wrote (``text_key`` = name)."""
    return reduce(DataFrame.unionByName, [
        read_text_evals(spark, f"{base_dir.rstrip('/')}/{n}.json", multiline).withColumn("text_key", F.lit(n))
        for n in names])


def read_flat_scores(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """SRC5: long comparison table; empty cells are NULL."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return (spark.read.schema(schemas.FLAT_SCORES).option("header", True)
            .option("multiLine", True).option("escape", '"').csv(path))


def available_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: distinct result file stems (directory and ``.json`` stripped)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    return (df.select(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1),
                                       r"\.json$", "").alias("file"))
            .distinct())


def read_rating_sheets(spark: SparkSession, path: str) -> DataFrame:
    """SRC7/SRC8: exported rating sheets (one CSV per sheet, header row).

    Returns raw rows ``sheet, label, score_text, ord, n_cells`` where
    ``sheet`` is the file stem (one sheet per text) and ``n_cells`` the number of
    cells of the record, empty ones included (rows with fewer than 3 are skipped by
    :func:`scorecard.operators.human.clean_ratings`).  Spark keeps the text of a
    record that has not the schema's nine cells; its separators outside of quotes
    are counted.
    """
    schema = T.StructType([*schemas.SHEET.fields, T.StructField(BAD_RECORD, T.StringType())])
    df = (spark.read.schema(schema).option("header", True)
          .option("multiLine", True).option("escape", '"').option("columnPruning", False)
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_RECORD).csv(path))
    bare = F.regexp_replace(F.col(BAD_RECORD), r'"(?:[^"]|"")*+"', "")
    n_cells = F.coalesce(F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1,
                         F.lit(len(schemas.SHEET.fields)))
    return _with_ord(df).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "").alias("sheet"),
        F.coalesce(F.col("c0"), F.lit("")).alias("label"),
        F.coalesce(F.col("c2"), F.lit("")).alias("score_text"),
        "ord", n_cells.cast("bigint").alias("n_cells"))


def read_texts(spark: SparkSession, path: str, label_col: str = "label",
               text_col: str = "input_text", fmt: str = "parquet") -> DataFrame:
    """SRC9: text corpus ``label STRING, input_text STRING``."""
    df = spark.read.format(fmt).load(path)
    return df.select(F.col(label_col).cast("string").alias("label"),
                     F.col(text_col).alias("input_text"))
