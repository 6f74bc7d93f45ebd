"""Work within groups of rows, in blocks of bounded size.

Candidate groups (the rows of one hash bucket) can be of any size.  They are
cut into blocks; each pair of blocks becomes a unit of work of its own, so a
large group spreads over many tasks and no task ever holds more than two
blocks.  Rows reach Python sorted by unit, and :func:`units` cuts the stream
of Arrow batches into them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block: two of them and their products fit any worker.
BLOCK = 512


def block_of(key: Column, n_blocks: Column) -> Column:
    """The block of a row, by a hash of ``key``."""
    return F.when(n_blocks <= 1, F.lit(0)).otherwise(
        F.pmod(F.xxhash64(key, F.lit("block")), n_blocks)).cast("int")


def in_units(df: DataFrame, unit: list[str], order: list[str]) -> DataFrame:
    """Partition by unit and sort, so that units are contiguous."""
    return df.repartition(*unit).sortWithinPartitions(*unit, *order)


def units(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Cut sorted batches into tables of whole units, many units a table.

    Yields tables in which every unit is complete.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = starts(pa.Table.from_batches([batch]), key)
        if kept and _row(kept[-1], -1, key) != _row(batch, 0, key):
            yield pa.Table.from_batches(kept)
            kept = []
        if len(cuts) > 1:
            last = int(cuts[-1])
            yield pa.Table.from_batches([*kept, batch.slice(0, last)])
            kept = [batch.slice(last)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def _row(batch: pa.RecordBatch, i: int, key: list[str]) -> tuple:
    i = i % batch.num_rows
    return tuple(batch.column(k)[i].as_py() for k in key)


def starts(table: pa.Table, key: list[str]) -> np.ndarray:
    """Where units begin in a sorted table; key columns are numbers."""
    n = table.num_rows
    change = np.zeros(n, bool)
    change[:1] = True
    for k in key:
        x = table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of the edges as connect the same nodes (a spanning forest)."""
    nodes, idx = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = idx[:len(left)], idx[len(left):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]
