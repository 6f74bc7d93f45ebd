"""Subword lattices over an existing piece vocabulary, many words at a time.

A word (``▁`` and its characters) can be cut into vocabulary pieces in many
ways; its probability is the sum over all of them of the product of the pieces'
probabilities, by forward recursion; words of less than ``LEAST`` are done again
in log space, where nothing underflows.  Characters that are no piece are spelt
by the vocabulary's byte pieces.  Words of one length form a matrix, and pieces
are found by 64-bit polynomial hashes of substrings.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Probability below which a word is worked on in log space: what underflows
#: beside a larger sum is less than any rounding.
LEAST = 1e-200
#: Elements of a matrix that is worked on at once.
_AREA = 1 << 18


class Vocabulary:
    """Pieces of a sentencepiece model, with their scores."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        self.size = len(ids)
        scores = np.array([sp.get_score(i) for i in ids])
        self.byte_ids = np.zeros(256, np.int64)
        self.usable = np.zeros(self.size, bool)
        names, at = [], []
        for i in ids:
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[1:-1], 16)] = i
                self.usable[i] = True
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                names.append(sp.id_to_piece(i))
                at.append(i)
                self.usable[i] = True
        self.longest = max(map(len, names))
        hashes = np.array([_hash(name) for name in names], np.uint64)
        # keys by place, and where those of a place begin
        place = _place(hashes)
        order = np.argsort(place, kind="stable")
        self.keys, self.ids, place = hashes[order], np.array(at, np.int32)[order], place[order]
        places, first, sharing = np.unique(place, return_index=True, return_counts=True)
        self.first = np.full(1 << 20, -1, np.int32)
        self.first[places] = first
        self.most, self.last = int(sharing.max()), len(hashes) - 1
        # the scores of the vocabulary are minus the rank of a piece
        rank = np.clip(-scores, 0, self.size)
        rank[self.byte_ids] = self.size
        start = np.where(self.usable, 1 / (rank + 2), 0)
        self.start = np.log(start / start.sum(), where=self.usable, out=np.full(self.size, -np.inf))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 for no piece."""
        flat = hashes.ravel()
        out = np.full(flat.shape, -1, np.int32)
        at = self.first[_place(flat)]
        some = np.flatnonzero(at >= 0)
        at, wanted = at[some], flat[some]
        for k in range(self.most):
            there = np.minimum(at + k, self.last)
            same = np.flatnonzero(self.keys[there] == wanted)
            out[some[same]] = self.ids[there[same]]
        return out.reshape(hashes.shape)


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes * _MIX >> np.uint64(44)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hash(piece: str) -> np.uint64:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in _codes(piece):
            h = h * _BASE + c + np.uint64(1)
    return h


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


class Lattice:
    """The lattices of words of one length.  Matrices have a row per place and a
    column per word."""

    def __init__(self, vocab: Vocabulary, words: list[str]):
        """``words`` have the same number of characters, ``▁`` included."""
        self.vocab, self.n, self.size = vocab, len(words[0]), len(words)
        codes = np.ascontiguousarray(_codes("".join(words)).reshape(self.size, self.n).T)
        power, prefix = np.uint64(1), np.zeros((self.n + 1, self.size), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.n):
                prefix[i + 1] = prefix[i] * _BASE + codes[i] + np.uint64(1)
            self.pieces = []
            for length in range(1, min(vocab.longest, self.n) + 1):
                power = power * _BASE
                self.pieces.append(vocab.find(prefix[length:] - prefix[:-length] * power))
        # characters that are no piece: their bytes
        self.spelt = np.nonzero(self.pieces[0] < 0)
        self.chars = codes[self.spelt]
        self.byte_lists = {int(c): [int(vocab.byte_ids[b]) for b in chr(int(c)).encode("utf-8", "surrogatepass")]
                           for c in np.unique(self.chars)}

    def weights(self, logp: np.ndarray, log: bool = False) -> list[np.ndarray]:
        """Weights of the arcs (``log``: their logarithms), by length and place."""
        by_id = np.append(logp, -np.inf)  # no piece: -1
        spelt = np.array([float(logp[ids].sum()) for ids in self.byte_lists.values()])
        if not log:
            by_id, spelt = np.exp(by_id), np.exp(spelt)
        weights = [by_id[ids] for ids in self.pieces]
        if len(self.chars):
            weights[0][self.spelt] = spelt[np.unique(self.chars, return_inverse=True)[1]]
        return weights

    def forward(self, weights: list[np.ndarray]) -> np.ndarray:
        """Sums over all cuts of each prefix: (n + 1) x words."""
        alpha = np.zeros((self.n + 1, self.size))
        alpha[0] = 1
        for j in range(1, self.n + 1):
            for k in range(1, min(len(weights), j) + 1):
                alpha[j] += alpha[j - k] * weights[k - 1][j - k]
        return alpha

    def backward(self, weights: list[np.ndarray]) -> np.ndarray:
        beta = np.zeros((self.n + 1, self.size))
        beta[self.n] = 1
        for i in range(self.n - 1, -1, -1):
            for k in range(1, min(len(weights), self.n - i) + 1):
                beta[i] += beta[i + k] * weights[k - 1][i]
        return beta

    def log_forward(self, weights: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """:meth:`forward` of the words ``at`` in logarithms, from log weights."""
        alpha = np.zeros((self.n + 1, len(at)))
        for j in range(1, self.n + 1):
            alpha[j] = _logsum(np.stack([alpha[j - k] + weights[k - 1][j - k, at]
                                         for k in range(1, min(len(weights), j) + 1)]))
        return alpha

    def log_backward(self, weights: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.n + 1, len(at)))
        for i in range(self.n - 1, -1, -1):
            beta[i] = _logsum(np.stack([beta[i + k] + weights[k - 1][i, at]
                                        for k in range(1, min(len(weights), self.n - i) + 1)]))
        return beta

    def log_probability(self, logp: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability, the sum over all its cuts."""
        total = self.forward(self.weights(logp))[-1]
        out = np.log(total, where=total >= LEAST, out=np.zeros(self.size))
        small = np.flatnonzero(total < LEAST)
        if len(small):
            out[small] = self.log_forward(self.weights(logp, log=True), small)[-1]
        return out

    def expected(self, counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``counts`` copies of the words."""
        weights = self.weights(logp)
        alpha, beta = self.forward(weights), self.backward(weights)
        scale = np.divide(counts, alpha[-1], where=alpha[-1] >= LEAST, out=np.zeros(self.size))
        small = np.flatnonzero(alpha[-1] < LEAST)
        if len(small):
            logs = self.weights(logp, log=True)
            log_alpha, log_beta = self.log_forward(logs, small), self.log_backward(logs, small)
            rest = np.log(counts[small]) - log_alpha[-1]
        pieces, uses = [], []
        for k, (ids, w) in enumerate(zip(self.pieces, weights), 1):
            # arcs by their place in the flat matrices, those of spelt characters too
            at = np.flatnonzero(w)
            e = alpha.ravel()[at] * w.ravel()[at] * beta.ravel()[at + k * self.size] * scale[at % self.size]
            pieces.append(ids.ravel()[at])
            uses.append(e)
            if len(small):
                pieces.append(ids[:, small].ravel())
                uses.append(np.exp(log_alpha[:-k] + logs[k - 1][:, small] + log_beta[k:] + rest).ravel())
            if k == 1 and len(self.chars):
                full = np.zeros(w.shape)
                full.ravel()[at] = e
                if len(small):
                    full[:, small] = uses[-1].reshape(-1, len(small))
                unknown = full[self.spelt]
        pieces, uses = np.concatenate(pieces), np.concatenate(uses)
        known = pieces >= 0
        out = np.bincount(pieces[known], uses[known], self.vocab.size)
        for c, byte_list in self.byte_lists.items():
            share = unknown[self.chars == c].sum()
            for b in byte_list:
                out[b] += share
        return out


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def by_length(words: list[str]):
    """Positions of words of equal length, in groups of bounded area."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        if len(group):
            step = max(1, _AREA // (int(lengths[group[0]]) + 1))
            for i in range(0, len(group), step):
                yield group[i:i + step]


def log_probabilities(vocab: Vocabulary, words: list[str], logp: np.ndarray, *more: np.ndarray):
    """Natural log of each word's probability; words come without ``▁``.  With
    further ``logp``, a list with the result for each."""
    words, logps = ["▁" + w for w in words], (logp, *more)
    out = [np.zeros(len(words)) for _ in logps]
    for at in by_length(words):
        lattice = Lattice(vocab, [words[i] for i in at])
        for got, p in zip(out, logps):
            got[at] = lattice.log_probability(p)
    return out if more else out[0]


def expected_counts(vocab: Vocabulary, words: list[str], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
    words = ["▁" + w for w in words]
    out = np.zeros(vocab.size)
    for at in by_length(words):
        out += Lattice(vocab, [words[i] for i in at]).expected(counts[at], logp)
    return out
