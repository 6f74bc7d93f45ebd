"""Evaluate texts as they land in a folder (file source -> foreachBatch).

Every micro-batch holds whole texts (a file's rows arrive together), so the
per-text roll-up is complete inside the batch and needs no streaming state.
Outputs are written under ``batch_id=<n>`` with overwrite: if a batch is
replayed after a failure, it rewrites the same folder, so each batch's rows
are stored exactly once.  Offsets live in the streaming checkpoint, inside
the shared checkpoint folder unless a location is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.evaluation import evaluate
from ..session import shared_path

TEXT_SCHEMA = "label string, input_text string"


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def start_incremental_evaluation(spark: SparkSession, texts_dir: str, out_dir: str,
                                 raters: DataFrame, rubric: DataFrame, scorer,
                                 checkpoint_location: str | None = None,
                                 fmt: str = "parquet", available_now: bool = True,
                                 max_files_per_trigger: int | None = None):
    """Start the query; returns the ``StreamingQuery``.

    ``out_dir`` receives ``question_scores/``, ``dimension_scores/``,
    ``concept_scores/``, ``model_scores/`` and ``text_scores/``, each with one
    ``batch_id=<n>`` folder per micro-batch (readable as one table).
    """
    reader = spark.readStream.schema(TEXT_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    texts = reader.load(texts_dir)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        # five tables are written: score each prompt once, not once a table
        ev = evaluate(batch, raters, rubric, scorer, persist=True)
        q = ev.question_scores
        tables = {"question_scores": q, "dimension_scores": ev.dimension_scores,
                  "concept_scores": ev.concept_scores, "model_scores": ev.model_scores,
                  "text_scores": ev.text_scores}
        for name, df in tables.items():
            _write(df.withColumn("batch_id", F.lit(batch_id).cast("bigint")),
                   f"{out_dir}/{name}/batch_id={batch_id}")

    writer = (texts.writeStream.foreachBatch(run_batch)
              .option("checkpointLocation", checkpoint_location or shared_path(spark, "stream")))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
