"""A bounded sample of labelled documents, and models fitted to it."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD_OUT, id_remainder, text_or_empty

#: Labelled rows that a classifier is fitted to, at most.
SAMPLE_ROWS = 20_000


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``key, text, label`` of at most ``rows`` labelled training documents.

    Rows are taken by the hash of their id, from those whose
    ``crc32(doc_id) mod 3`` is not 1; null labels and ids are left out, and an
    id labelled twice counts by its largest label.  The sample of ids has a fixed
    bound, so it is broadcast and only its texts move.
    """
    ids = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_remainder(3) != HELD_OUT))
           .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
           .select(F.xxhash64("doc_id").alias("key"), "doc_id", "label").orderBy("key").limit(rows))
    own = docs.select("doc_id", text_or_empty().alias("text"))
    # an id that repeats in the documents is one labelled row
    return (own.join(F.broadcast(ids), "doc_id").select("key", "text", "label"))


def fit(examples: DataFrame, train: Callable[[list[tuple[str, int]]], object], rows: int = SAMPLE_ROWS):
    """``train`` on the bounded sample, in one task; returns its model.

    Examples come in the order of their keys.  Rows beyond ``rows`` (ids that
    repeat) are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[str, int]] = []
        for batch in batches:
            got += zip(batch.column("text").to_pylist(), batch.column("label").to_pylist())
            del got[rows:]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(got))], pa.binary())], ["model"])

    ordered = examples.orderBy("key", "text").limit(rows).coalesce(1)
    row = ordered.mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else train([])  # no row: Spark ran no task
