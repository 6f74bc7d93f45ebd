"""Incremental (file-stream) evaluation equals the batch pipeline."""

import os

from pyspark.sql import functions as F

from conftest import SF001
from scorecard.plans import queries as Q
from scorecard.sources import fixtures as fx
from scorecard.streaming import start_incremental_evaluation


def test_incremental_equals_batch(spark, tmpdir_path):
    texts = fx.d_texts(spark, SF001)
    src = os.path.join(tmpdir_path, "in")
    # two arriving files
    texts.where(F.col("label").cast("bigint") % 2 == 0).coalesce(1).write.parquet(f"{src}/a")
    texts.where(F.col("label").cast("bigint") % 2 == 1).coalesce(1).write.parquet(f"{src}/b")
    for part in ("a", "b"):
        for f in os.listdir(f"{src}/{part}"):
            if f.endswith(".parquet"):
                os.rename(f"{src}/{part}/{f}", f"{src}/{part}-{f}")
    out = os.path.join(tmpdir_path, "out")
    q = start_incremental_evaluation(spark, src, out, fx.d_raters(spark), fx.d_rubric(spark),
                                     fx.d_scorer(), checkpoint_location=os.path.join(tmpdir_path, "ck"),
                                     max_files_per_trigger=1)
    q.awaitTermination(300)
    got = spark.read.parquet(f"{out}/text_scores").select("label", "score", "n_models")
    want = Q.d_evaluation(spark, SF001).text_scores.select("label", "score", "n_models")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert spark.read.parquet(f"{out}/text_scores").select("batch_id").distinct().count() == 2
