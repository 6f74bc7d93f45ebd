"""Toxicity by compression distance (operator 10).

Two zstandard dictionaries are made: one is trained on the whole ordinary
texts of the sample, and one holds the toxic text that ordinary text does not
explain.  A window (one word with the
spaces around it) is compressed twice: with the ordinary dictionary, and with
the ordinary and the toxic dictionary together.  What the second saves over
the first, in bytes, is the window's distance; ordinary windows save next to
nothing.  Windows met before are remembered.

Toxic text within toxic documents is found by words and by runs of bytes
(``GRAM`` long) which documents labelled toxic hold significantly more often
(likelihood ratio); these words, and the stretches that such runs cover, are
the samples of the toxic dictionary.

A document's evidence is its largest saving, its number of windows that save
at least the calibrated step, and their share.  The step and a logistic
calibration are fitted to the labelled sample, so the score is a probability.

The model is fitted to a sample of at most ``SAMPLE_ROWS`` labelled rows; ids,
languages and sources are no evidence.

Defined results: null and empty texts have no window and no saving; without
toxic or without ordinary rows in the sample every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD_OUT, Remembered, id_remainder, prepare
from .labelled import SAMPLE_ROWS, fit, sample

THRESHOLD = 0.7
GRAM = 5
#: Least likelihood ratio (twice the log) of what tells toxic documents.
RATIO = 20.0
ORDINARY_BYTES, TOXIC_BYTES = 1 << 14, 1 << 14
#: Windows that a worker remembers, in each of two generations.
REMEMBERED = 200_000
#: Words of a sample that the ordinary dictionary is trained on.
ORDINARY_WORDS = 8


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    step: int
    weights: tuple[float, ...]


_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return _WORD.findall(text.lower())


def spaced(word: str) -> bytes:
    return b" " + word.encode("utf-8", "surrogatepass") + b" "


#: Goes around each window.  It is compressed to the same few bytes with any
#: dictionary.  A block that it makes compressible is never stored raw, and
#: the last bytes of a block, where zstandard looks for no matches, are its
#: own; so lengths show what the word costs.
CARRIER = bytes(32)


def window(word: str) -> bytes:
    return CARRIER + spaced(word) + CARRIER


def _compressor(content: bytes):
    import zstandard as zstd

    params = zstd.ZstdCompressionParameters(
        format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
        window_log=15, hash_log=14, chain_log=15, search_log=6, min_match=4, target_length=16,
        strategy=zstd.STRATEGY_BTLAZY2)
    data = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=data, compression_params=params)


class Distance:
    """Bytes that the toxic dictionary saves on windows."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.one, self.both = _compressor(ordinary), _compressor(ordinary + toxic)
        self.memory = Remembered(self._measure, REMEMBERED)

    def _measure(self, words: list[str]) -> list[int]:
        one, both = self.one.compress, self.both.compress
        return [len(one(w)) - len(both(w)) for w in map(window, words)]

    def savings(self, text: str) -> np.ndarray:
        words = words_of(text)
        known = self.memory.having(set(words))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def evidence(savings: np.ndarray, step: int) -> np.ndarray:
    """Bias, largest saving, windows that save a step and two, and their share."""
    if not len(savings):
        return np.array([1.0, 0.0, 0.0, 0.0, 0.0])
    hits = int((savings >= step).sum())
    return np.array([1.0, max(int(savings.max()), 0) / 4, np.log1p(hits), np.log1p(int((savings >= 2 * step).sum())),
                     hits / len(savings)])


def _grams(text: bytes) -> np.ndarray:
    """Runs of ``GRAM`` bytes at each place, as numbers."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(b) - GRAM + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        out = out << np.uint64(8) | b[k:k + n]
    return out


def _telling(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Which things, in ``a`` of ``n`` toxic and ``b`` of ``m`` ordinary
    documents, tell toxic ones."""

    def part(k, of, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / (of * p)), 0) + np.where(
                of - k > 0, (of - k) * np.log((of - k) / (of * (1 - p))), 0)

    p = (a + b) / (n + m)
    return (2 * (part(a, n, p) + part(b, m, p)) >= RATIO) & (a / n > 8 * b / m)


def telling_runs(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Sorted runs that toxic documents hold significantly more often."""
    runs, a = np.unique(np.concatenate([np.unique(_grams(t)) for t in toxic]), return_counts=True)
    runs, a = runs[a >= 3], a[a >= 3].astype(float)
    b = np.zeros(len(runs))
    for t in ordinary:
        if len(runs):
            own = np.unique(_grams(t))
            at = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
            b[at[runs[at] == own]] += 1
    return runs[_telling(a, b, len(toxic), len(ordinary))]


def without_copies(texts: list[list[str]], words: int = 3, least: float = 0.8) -> list[list[str]]:
    """``texts`` without near copies of earlier ones, which would count the words
    of one text many times.  Texts that share their smallest shingle hash are
    compared, and left out only where ``least`` of the shingles of both are shared."""
    found: dict[int, list[np.ndarray]] = {}  # sorted hashes: a sample's would not fit as sets
    kept = []
    for t in texts:
        own = np.unique(np.array([zlib.crc32(" ".join(t[i:i + words]).encode("utf-8", "surrogatepass"))
                                  for i in range(max(len(t) - words + 1, 1))], np.uint32))
        others = found.setdefault(int(own[0]), [])
        if not any(_alike(own, x, least) for x in others):
            others.append(own)
            kept.append(t)
    return kept


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether ``least`` of the numbers in either are in both; each has a number once."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def telling_words(toxic: list[list[str]], ordinary: list[list[str]]) -> set[str]:
    """Words that toxic documents hold significantly more often."""
    a = Counter(w for t in toxic for w in set(t))
    a = {w: k for w, k in a.items() if k >= 3}
    b = Counter(w for t in ordinary for w in set(t) if w in a)
    words = list(a)
    tell = _telling(np.array([a[w] for w in words], float), np.array([b[w] for w in words], float),
                    len(toxic), len(ordinary))
    return {w for w, t in zip(words, tell) if t}


def telling_stretches(text: bytes, runs: np.ndarray) -> list[bytes]:
    """The stretches of ``text`` that telling runs cover."""
    grams = _grams(text)
    if not len(runs) or not len(grams):
        return []
    at = np.minimum(np.searchsorted(runs, grams), len(runs) - 1)
    hit = np.flatnonzero(runs[at] == grams)
    if not len(hit):
        return []
    cuts = np.flatnonzero(np.diff(hit) > GRAM - 1) + 1
    return [text[g[0]:g[-1] + GRAM] for g in np.split(hit, cuts)]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """Content of a zstandard dictionary trained on ``samples``; too few of
    them are joined as they are, the most frequent last (and so nearest).  If
    zstandard finds nothing to train on in them, the dictionary is what fits of
    the joined samples: the most frequent ones."""
    import zstandard as zstd

    def joined() -> bytes:
        return b"".join(x for x, _ in reversed(Counter(samples).most_common()))

    different, total = set(), 0
    for x in samples:
        if x not in different:
            different.add(x)
            total += len(x)
            if total > size:
                break
    else:
        return joined()
    try:
        trained = zstd.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except zstd.ZstdError:
        return joined()[-size:]
    return trained


def train(examples: list[tuple[str, int]]) -> Model | None:
    """Dictionaries, step and calibration from labelled texts."""
    y = np.array([float(bool(label)) for _, label in examples])
    one: dict[str, str] = {}  # each word is held once
    words = [[one.setdefault(w, w) for w in words_of(t)] for t, _ in examples]
    toxic, ordinary = ([w for w, label in zip(words, y) if label == k] for k in (1, 0))
    if not toxic or not ordinary:
        return None
    toxic, ordinary = without_copies(toxic), without_copies(ordinary)
    tell = telling_words(toxic, ordinary)
    runs = telling_runs([spaced(" ".join(w)) for w in toxic], [spaced(" ".join(w)) for w in ordinary])
    samples = [spaced(w) for t in toxic for w in t if w in tell]
    samples += [s for t in toxic for w in t if w not in tell for s in telling_stretches(spaced(w), runs)]
    plain = [spaced(" ".join(t[i:i + ORDINARY_WORDS])) for t in ordinary for i in range(0, len(t), ORDINARY_WORDS)]
    model = Model(_trained(ORDINARY_BYTES, plain), _trained(TOXIC_BYTES, samples), 1, (0.0,) * 5)
    measure = Distance(model.ordinary, model.toxic)
    found = [measure.savings(t) for t, _ in examples]
    best = np.inf
    for step in range(1, 12):
        x = np.array([evidence(s, step) for s in found])
        w, loss = _logistic(x, y)
        if loss < best:
            best, model.step, model.weights = loss, step, tuple(w)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Newton steps for penalised logistic regression; weights and loss."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w = w + move * min(1.0, 5 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + ridge * (w @ w) / 2)


def fit_model(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of a bounded sample (runs a job)."""
    prepare(docs.sparkSession)
    return fit(sample(docs, labels, label, rows), train, rows)


def score_text(measure: Distance, model: Model, text: str) -> float:
    x = evidence(measure.savings(text), model.step)
    return float(1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30))))


def scores(model: Model | None):
    """Column function: text -> score from 0 to 1."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        measure = Distance(model.ordinary, model.toxic) if model else None
        for texts in batches:
            yield pa.array([score_text(measure, model, t or "") if model else 0.0 for t in texts.to_pylist()],
                           pa.float64())

    return run


def score_documents(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row; nothing is shuffled."""
    prepare(docs.sparkSession)
    scored = scores(model)(F.col("text").cast("string"))
    return docs.select("doc_id", (id_remainder(3) == HELD_OUT).alias("held_out"), scored.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all columns kept."""
    prepare(docs.sparkSession)
    scored = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                         scores(model)(docs["text"].cast("string")).alias("score"))
    return scored.where(F.col("score") < threshold).select("row.*")
