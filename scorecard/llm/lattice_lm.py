"""Language-model scores from subword lattices (operator 5).

The vocabulary of an existing subword model gives the pieces.  The lattice of
a word has an arc for each piece that fits, and its probability is the sum over
all cuts (:mod:`lattice`).  The pieces weigh what the vocabulary's own scores
say (ranks, taken as a Zipf distribution), and a text has the product of its
words' and the end's probabilities: that is ``score``.

``mixture_score`` learns from the training rows as well.  There the pieces'
probabilities are fitted to the distinct words by expectation maximisation, and
a word that training has seen has one more arc, for the word as a whole: with
the Good-Turing mass of unseen words ``e``,

    P(word) = (1 - e) * c / N + e * lattice(word)

How it runs: words are counted by block of documents and word; the counts
and the lattice probability of each distinct word (computed once) are joined
back to the blocks that have the word, at most a row per block and word, a
frequent word's rows without a shuffle (:func:`common.split_hot`); and each block's words and texts meet in
one sorted stream.  A task holds the words of one block.  Only piece counts
(a row per vocabulary entry) and four totals reach the driver.

Defined results: null and blank texts have the end token only; without any
training row ``train_tokens`` is 0 and words have their lattice probability
by the vocabulary's own scores; rows that repeat an id are counted and scored
each.  A null id counts as the empty text for the split.  A lattice costs time in
proportion to its word's length times the longest piece's; very long texts are
cut into words before.  Blocks are made of rows that follow each other, whatever
their ids are, so ``docs`` has to come out in the same order each time it is read, as
stored tables do; if it does not, a word is missed and an error raised.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import in_units, starts
from .common import id_remainder, prepare, split_hot, stored, text_or_empty
from .lattice import expected_counts, log_probabilities, vocabulary

#: Documents (rows that follow each other) of a block.
BLOCK_DOCS = 8192
#: Distinct words of blocks that a task counts before it hands them on.
COUNTED = 400_000
#: Words that are worked on at once.
WORDS = 16_384
STEPS = 2
SMOOTHING = 0.1
PIECE_SMOOTHING = 0.01
HELD_OUT_MOD = 10


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.lower().split()


def with_block(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``doc_id, text, train, block``; a block is a part of one partition."""
    return docs.select(
        "doc_id", text_or_empty().alias("text"), (id_remainder(HELD_OUT_MOD) != 0).alias("train"),
        F.floor(F.monotonically_increasing_id() / F.lit(block_docs)).cast("long").alias("block"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, dict[bytes, int]] = {}
    held = 0

    def flush():
        for block, counts in seen.items():
            words = list(counts)
            for i in range(0, len(words), 65536):
                part = words[i:i + 65536]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), block, np.int64)), pa.array(part, pa.binary()).cast(pa.string()),
                     pa.array([counts[w] for w in part], pa.int64())], ["block", "word", "n"])
        seen.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for text, train, block in zip(texts, batch.column("train").to_pylist(), batch.column("block").to_pylist()):
            counts = seen.setdefault(block, {})
            before = len(counts)
            words = Counter(words_of(text))
            words[b""] = 1
            if train:
                for w, n in words.items():
                    counts[w] = counts.get(w, 0) + n
            else:
                for w in words:
                    counts.setdefault(w, 0)
            held += len(counts) - before
        if held > COUNTED:
            yield from flush()
            held = 0
    yield from flush()


def _in_chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(kept)
            kept, n = [], 0
    if n:
        yield pa.Table.from_batches(kept)


def _expect(model: bytes, logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, total = vocabulary(model), None
        for table in _in_chunks(batches, WORDS):
            words = table.column("word").to_pylist()
            got = expected_counts(vocab, words, np.ones(len(words)), logp)
            total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "uses"])

    return run


def fit_pieces(words: DataFrame, model: bytes, steps: int = STEPS) -> np.ndarray:
    """Log probabilities of the pieces, fitted to the distinct ``word`` rows.

    Every distinct word counts once, as a stand-in for words not seen.  Each
    step sends one row per used piece to the driver.
    """
    vocab = vocabulary(model)
    logp = vocab.start
    for _ in range(steps):
        uses = np.zeros(vocab.size)
        rows = (words.select("word").mapInArrow(_expect(model, logp), "piece bigint, uses double")
                .groupBy("piece").agg(F.sum("uses").alias("uses")).collect())
        for piece, n in rows:
            uses[piece] = n
        if not rows:
            return logp
        share = np.where(vocab.usable, uses + PIECE_SMOOTHING, 0)
        logp = np.log(share / share.sum(), where=vocab.usable, out=np.full(vocab.size, -np.inf))
    return logp


def _weigh(model: bytes, logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for table in _in_chunks(batches, WORDS):
            words = table.column("word").to_pylist()
            # the end is one more symbol beside the pieces
            end, ends = -math.log(vocab.size + 1), np.array([not w for w in words], bool)
            own, fitted = (np.where(ends, end, p) for p in log_probabilities(vocab, words, vocab.start, logp))
            yield pa.RecordBatch.from_arrays(
                [*[table.column(c).combine_chunks() for c in ("word", "c", "blocks")], pa.array(own), pa.array(fitted)],
                ["word", "c", "blocks", "spelt", "fitted"])

    return run


def word_scores(c: np.ndarray, spelt: np.ndarray, fitted: np.ndarray, total: int, distinct: int, unseen: float):
    """log10 scores of words: by smoothed counts, by the lattice, and by the mixture."""
    base = np.log10((c + SMOOTHING) / (total + SMOOTHING * (distinct + 1)))
    whole = np.log(np.maximum(c, 0.5) / max(total, 1)) + math.log1p(-unseen) if unseen < 1 else np.full(len(c), -np.inf)
    whole = np.where(c > 0, whole, -np.inf)
    mixture = np.logaddexp(whole, math.log(unseen) + fitted) / math.log(10)
    return base, spelt / math.log(10), mixture


def _score(total: int, distinct: int, unseen: float):
    fields = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "mixture_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, counts, spelt, fitted, ready = None, [], [], [], [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            begin = starts(table, ["block", "kind"])
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), table.num_rows]):
                part = batch.slice(a, b - a)
                own, kind = part.column("block")[0].as_py(), part.column("kind")[0].as_py()
                if own != block:
                    block, words, counts, spelt, fitted, ready = own, [], [], [], [], None
                if kind == 0:
                    words += part.column("text").cast(pa.binary()).to_pylist()
                    counts.append(part.column("c").to_numpy(zero_copy_only=False))
                    spelt.append(part.column("spelt").to_numpy(zero_copy_only=False))
                    fitted.append(part.column("fitted").to_numpy(zero_copy_only=False))
                    continue
                if ready is None:
                    c = np.concatenate(counts)
                    ready = ({w: i for i, w in enumerate(words)},
                             *word_scores(c, np.concatenate(spelt), np.concatenate(fitted), total, distinct, unseen),
                             c > 0)
                    words, counts, spelt, fitted = [], [], [], []
                place, base, score, mixture, known = ready
                end = place[b""]
                found, ends = [], [0]
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    found += map(place.__getitem__, words_of(text))
                    found.append(end)
                    ends.append(len(found))
                at, n = np.array(found, np.int64), np.diff(ends)
                k, x, y, z = ([values[i:j].sum() for i, j in zip(ends, ends[1:])]
                              for values in (column[at] for column in (known, base, score, mixture)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([not t for t in part.column("train").to_pylist()]),
                     pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(x), pa.array(y), pa.array(z)], fields)

    return run


def score_documents(docs: DataFrame, model_file: str, steps: int = STEPS,
                    block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, mixture_score``.

    Reads ``doc_id`` and ``text``; other columns are ignored.  ``model_file``
    is a local sentencepiece model, read on the driver.  Runs jobs when called.
    """
    prepare(docs.sparkSession)
    with open(model_file, "rb") as f:
        model = f.read()
    rows = with_block(docs, block_docs)
    by_block = stored(rows.select("text", "train", "block").mapInArrow(_count, "block bigint, word string, n bigint")
                      .groupBy("block", "word").agg(F.sum("n").alias("n")), "block-words")
    words = stored(by_block.groupBy("word").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("blocks")), "words")
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"),
                       F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("distinct"),
                       F.coalesce(F.sum((F.col("c") == 1).cast("long")), F.lit(0)).alias("once")).first()
    total, distinct = totals["total"], totals["distinct"]
    # Good-Turing, kept from 0 and 1; without training all is unseen
    unseen = (totals["once"] + 1) / (total + 2) if total else 1.0
    logp = fit_pieces(words.where("c > 0 and word <> ''"), model, steps)
    weighed = stored(words.mapInArrow(_weigh(model, logp), "word string, c bigint, blocks bigint, spelt double, "
                                                           "fitted double"), "weighed-words")
    empty = F.lit(None)
    entries = split_hot(by_block.select("block", "word"), weighed, ["word"], "blocks", by_block.count()).select(
        "block", F.lit(0).alias("kind"), empty.cast(rows.schema["doc_id"].dataType).alias("doc_id"),
        F.col("word").alias("text"), empty.cast("boolean").alias("train"), "c", "spelt", "fitted")
    texts = rows.select("block", F.lit(1).alias("kind"), "doc_id", "text", "train",
                        empty.cast("long").alias("c"), empty.cast("double").alias("spelt"),
                        empty.cast("double").alias("fitted"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return in_units(entries.unionByName(texts), ["block"], ["kind"]).mapInArrow(
        _score(total, distinct, unseen),
        f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, "
        "mixture_score double",
    ).withColumn("train_tokens", F.lit(total).cast("long"))
