"""Quality scores by logistic regression on hashed word n-grams (operator 8).

Words and word pairs are hashed into 2^18 weights, which are fitted by
follow-the-regularised-leader (FTRL-proximal: a learning rate of its own per
weight, L1 and L2 penalties), and a score is the logistic function of a sparse
dot product.  Words are runs of letters and digits or of other marks; beside a
word's hash its shape counts (upper case, capital, digits, marks), beside a
pair's the fact that its words are equal, and how often words and pairs
recur in the text.  Values are logarithms of counts over the norm of the text's
features, so that long and short texts compare.

The model is fitted to a sample of at most ``SAMPLE_ROWS`` labelled
rows; label tables, ids, languages and sources are no features.

Defined results: null and empty texts have the bias as their only feature;
without labelled rows every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HELD_OUT, Remembered, id_remainder, prepare
from .labelled import SAMPLE_ROWS, fit, sample

BITS = 18
EPOCHS = 2
RATE, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
#: Words that a worker remembers, in each of two generations.
REMEMBERED = 200_000
_WORD = re.compile(r"\w+|[^\w\s]+")
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))


def _shape(word: str) -> int:
    if word[0].isalnum() or word[0] == "_":
        return 1 if word.isdigit() else 2 if len(word) > 1 and word.isupper() else 3 if word[0].isupper() else 4
    return 5


class Features:
    """Hashed features of a text: indices without repeats, and values."""

    def __init__(self, bits: int = BITS):
        self.bits, self.memory = bits, Remembered(lambda words: [_hash(w.lower()) << 3 | _shape(w) for w in words],
                                                  REMEMBERED)

    def _words(self, text: str) -> np.ndarray:
        words = _WORD.findall(text)
        known = self.memory.having(set(words))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        found = self._words(text)
        words, shapes = found >> np.uint64(3), found & np.uint64(7)
        same = words[1:] == words[:-1]
        pairs = (words[:-1] * _PAIR + words[1:] * np.uint64(31)) >> np.uint64(20)
        one, n_one = np.unique(words, return_counts=True)
        two, n_two = np.unique(pairs, return_counts=True)
        # few kinds of counts: shapes, shape pairs, equal neighbours, recurrence
        kinds = np.concatenate([
            shapes, 8 + shapes[:-1] * np.uint64(8) + shapes[1:], 100 + same.astype(np.uint64),
            110 + np.minimum(np.log2(n_two), 7).astype(np.uint64).repeat(n_two),
            120 + np.minimum(np.log2(n_one), 7).astype(np.uint64).repeat(n_one)]).astype(np.int64)
        share = np.bincount(kinds, minlength=130) / max(len(words), 1)
        at = np.flatnonzero(share)
        index = np.concatenate([
            [0], 1 + at, (one * np.uint64(0x85EBCA6B) >> np.uint64(3)) & mask, two & mask]).astype(np.int64)
        log_one, log_two = np.log1p(n_one), np.log1p(n_two)
        norm = np.sqrt((log_one ** 2).sum() + (log_two ** 2).sum()) or 1.0
        value = np.concatenate([[1.0], share[at], log_one / norm, log_two / norm])
        index, where = np.unique(index, return_inverse=True)
        return index, np.bincount(where, value)


def train(examples: list[tuple[str, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by FTRL-proximal over the examples, in their order."""
    features = Features(bits)
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    rows = [(*features(text), label) for text, label in examples]
    for _ in range(epochs):
        for at, x, label in rows:
            w = _weights(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / RATE * w
            n[at] += g * g
    return _weights(z, n).astype(np.float32)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / RATE + L2))


def fit_model(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights fitted to a bounded sample (runs a job)."""
    prepare(docs.sparkSession)
    return fit(sample(docs, labels, label, rows), train, rows)


def scores(weights: np.ndarray):
    """Column function: text -> score from 0 to 1."""
    bits = int(np.log2(len(weights)))

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = Features(bits)
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                at, x = features(t or "")
                out.append(float(1 / (1 + np.exp(-np.clip(weights[at] @ x, -35, 35)))))
            yield pa.array(out, pa.float64())

    return run


def score_documents(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row; nothing is shuffled."""
    prepare(docs.sparkSession)
    scored: Column = scores(weights)(F.col("text").cast("string"))
    return docs.select("doc_id", (id_remainder(3) == HELD_OUT).alias("held_out"), scored.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
