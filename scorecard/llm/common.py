"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: Documents per Arrow batch: a batch of the longest texts must fit a worker.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20

#: Labels are learnt only from rows whose ``crc32(doc_id) mod 3`` is not this.
HELD_OUT = 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lower the session's Arrow batches to ``rows`` rows and ``size`` bytes if they
    are larger; smaller settings of the session stay as they are."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(re.sub(r"\D+$", "", spark.conf.get(key)))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def ship_code(spark: SparkSession) -> None:
    """Send this library to the executors' Python, once a session (as
    ``--py-files`` does), so that it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_scorecard_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="scorecard-code-"), "scorecard_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._scorecard_shipped = True


def prepare(spark: SparkSession) -> None:
    """What operators with Python code need of a session."""
    ship_code(spark)
    bounded_batches(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage, survives lost executors, and gives Spark the size of
    the table, so that its own threshold decides on broadcasts.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(col: str = "doc_id") -> Column:
    """``doc_id`` as text; a null id is the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_remainder(mod: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.encode(id_text(col), "UTF-8")) % F.lit(mod)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def split_hot(left: DataFrame, right: DataFrame, keys: list[str], size: str, rows: int,
              how: str = "inner", share: int = 1000) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per key, without skew.

    ``right[size]`` says how many rows of ``left`` have the key and ``rows``
    how many there are in all.  Keys with more than ``rows / share`` rows can
    number ``share`` at most, so these few are broadcast, and their rows of
    ``left`` are not shuffled; all other keys are joined by an ordinary
    shuffle, in which no key is large.  ``how`` is ``inner`` or ``left``; keys
    hold no nulls.
    """
    limit = max(rows // share, 1)
    hot = right.where(F.col(size) > limit)
    cold = right.where(F.col(size) <= limit)
    on_hot = left.join(F.broadcast(hot), keys)
    off_hot = (left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
               .join(cold, keys, how))
    return on_hot.unionByName(off_hot.select(*on_hot.columns))


class Remembered:
    """What ``learn(list of keys)`` returned for keys, in two generations.

    Keys not asked for during a whole generation are forgotten, so memory is
    bounded by two generations of ``limit`` keys and one call's, while
    frequent keys stay.
    """

    def __init__(self, learn, limit: int):
        self.learn, self.limit, self.young, self.old = learn, limit, {}, {}

    def having(self, keys: set) -> dict:
        """A table that holds all of ``keys`` until the next call."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for k in keys.difference(young):
            if k in old:
                young[k] = old[k]
            else:
                new.append(k)
        if new:
            young.update(zip(new, self.learn(new)))
        return young
