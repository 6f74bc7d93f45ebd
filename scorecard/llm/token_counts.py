"""Token counts at every prefix (operator 9).

In a subword vocabulary of the byte-pair kind, merges never join two
characters that stand side by side in no piece.  Between a character and a
following space, and on both sides of a line feed, no piece of the vocabulary
reaches (this is checked when the model is loaded), so the text falls into
segments whose counts add up.  Within a segment, however long, the count of every
prefix is found by dynamic programming,

    tokens[i] = tokens[i - len(t)] + 1

where ``t`` is the one piece that ends at ``i`` and stays as it is behind the
last piece of the prefix before it.  A U+2581 in a text is a space, as it is
to the library.  (Merges are made best first, so pieces
are a text's encoding if and only if each two neighbours are that of theirs.)

The prefix table holds the places where the count changes, as characters and
the exact number of tokens from there on, and the end.  A longer prefix can
have fewer tokens.  From the stored table, :func:`total`, :func:`fitting_chars`
and :func:`prefix_tokens` answer questions of length, budget and truncation at
every character, without encoding the text again.

Under a model that is not additive or not of the byte-pair kind, the library
encodes each prefix of a segment: exact, in quadratic time.

Defined results: null and empty texts have no tokens and an empty table.
Special strings in texts are ordinary text, as is the library's default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Remembered, prepare, text_or_empty

LIMIT = 4096
#: Segments that a worker remembers, in each of two generations.
REMEMBERED = 200_000
#: Segments longer than this are not remembered.
LONG = 64
#: Characters of prefixes that are encoded at once, about.
ENCODED = 1 << 22
#: Pairs of pieces that a worker remembers.
PAIRS = 1 << 20
PREFIXES = "struct<chars: array<int>, tokens: array<int>>"
#: The model reads its own mark, U+2581, in a text as a space.
_SEGMENT = re.compile(r"\n|[ ▁]*[^ ▁\n]+|[ ▁]+")


class Counter:
    """Exact counts by a sentencepiece model, by remembered segments."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.additive = self._additive()
        # what the line feed and the mark before it add to a segment's count
        self.lead = len(self.model.encode("\n"))
        self.dummy = "▁" if self.model.normalize("a").startswith("▁") else ""
        self.memory = Remembered(lambda new: self.learn(new, first=False), REMEMBERED)
        self.firsts = Remembered(lambda new: self.learn(new, first=True), REMEMBERED)
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.pieces, self.longest = self._pieces()

    def _additive(self) -> bool:
        """Whether no piece reaches over a segment's end, and texts stay as they are."""
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        split = not any("\n" in n or re.search("[^▁]▁", n) for n in names)
        same = all(self.model.normalize(t).removeprefix("▁") == t.replace(" ", "▁")
                   for t in ("a", "A  b ", " a\tb", "ﬁ Å é ①"))
        return split and same and len(self.model.encode("\n")) + 1 == len(self.model.encode("\n\n"))

    def segments(self, text: str) -> list[str]:
        return _SEGMENT.findall(text) if self.additive else [text]

    def _pieces(self) -> tuple[set[str], int]:
        """The pieces that texts fall into, and the longest one's characters;
        none if the model is not known to be of the byte-pair kind."""
        m = self.model
        ids = range(m.get_piece_size())
        own = [i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        scores = [m.get_score(i) for i in own]
        # scores of byte-pair pieces are minus their rank; user-defined pieces have zero
        if (not self.additive or sum(map(m.is_byte, ids)) != 256 or any(map(m.is_unused, own))
                or any(x >= 0 or x != int(x) for x in scores)):
            return set(), 0
        names = [m.id_to_piece(i) for i in own]
        whole = {n for n, got in zip(names, m.encode(["\n" + n for n in names], out_type=str, num_threads=1))
                 if got[self.lead:] == [n]}
        return whole, max(map(len, whole), default=0)

    def _stay(self, before: str, piece: str) -> bool:
        """Whether two pieces side by side stay as they are."""
        if self.n_pairs >= PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        out = self.model.encode("\n" + before + piece, out_type=str)[self.lead:] == [before, piece]
        self.pairs.setdefault(before, {})[piece] = out
        return out

    def _by_pieces(self, text: str, tokens: list[int], last: list[str]) -> None:
        """Append the tokens and the last piece of every prefix of ``text`` from
        the ``len(tokens)``-th on; spaces are marks.  A last piece of "" stays
        beside any."""
        pieces, longest, pairs, none = self.pieces, self.longest, self.pairs, {}
        for i in range(len(tokens), len(text) + 1):
            for j in range(i - longest if i > longest else 0, i):
                piece = text[j:i]
                if piece in pieces:
                    before = last[j]
                    stays = pairs.get(before, none).get(piece) if before else True
                    if stays is None:
                        stays = self._stay(before, piece)
                    if stays:
                        tokens.append(tokens[j] + 1)
                        last.append(piece)
                        break
            else:  # a character that is no piece is spelt in bytes
                tokens.append(tokens[-1] + len(text[i - 1].encode()))
                last.append("")

    def _programmed(self, segments: list[str], first: bool) -> list[int]:
        """As :meth:`_encoded`; segments in order go on from what they share."""
        mark = self.dummy if first else ""
        out, tokens, last, previous = [], [0], [""], ""
        for s in segments:
            text = mark + s.replace(" ", "▁")
            same = 0
            for x, y in zip(text, previous):
                if x != y:
                    break
                same += 1
            del tokens[same + 1:], last[same + 1:]
            self._by_pieces(text, tokens, last)
            out += tokens[len(mark) + 1:]
            previous = text
        return out

    def _encoded(self, segments: list[str], first: bool) -> list[int]:
        """Tokens of every prefix but the empty one of each segment, in one list."""
        # the model puts a mark before a text; behind a line feed it doesn't count
        before, lead = ("", 0) if first else ("\n", self.lead)
        out, some, size = [], [], 0
        for s in segments:
            for k in range(1, len(s) + 1):
                some.append(before + s[:k])
                size += k
                if size >= ENCODED:
                    out += [len(x) - lead for x in self.model.encode(some, num_threads=1)]
                    some, size = [], 0
        return out + [len(x) - lead for x in self.model.encode(some, num_threads=1)]

    def learn(self, segments: list[str], first: bool) -> list[bytes]:
        """For each segment, pairs of numbers: the characters at which the
        count changes and the tokens from there on; the last is its end."""
        order = sorted(range(len(segments)), key=segments.__getitem__)
        place = np.argsort(order)
        segments = [segments[i] for i in order]
        flat = (self._programmed if self.pieces else self._encoded)(segments, first)
        tokens = np.array(flat, np.int32)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        ends = np.cumsum(sizes)
        keep = np.diff(tokens, prepend=np.int32(0)) != 0
        keep[ends - sizes] = tokens[ends - sizes] != 0
        keep[ends - 1] = True
        chars = np.arange(1, len(tokens) + 1) - np.repeat(ends - sizes, sizes)
        raw = np.stack([chars[keep].astype(np.int32), tokens[keep]], axis=1).tobytes()
        cuts = [0, *(8 * np.cumsum(keep)[ends - 1]).tolist()]
        return [raw[cuts[i]:cuts[i + 1]] for i in place.tolist()]

    def changes(self, segments: set[str], first: bool) -> dict[str, bytes]:
        short = {s for s in segments if len(s) <= LONG} if self.additive else set()
        known = (self.firsts if first else self.memory).having(short)
        long = [s for s in segments if s not in short]
        return {**{s: known[s] for s in short}, **dict(zip(long, self.learn(long, first)))} if long else known

    def tables(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        split = [self.segments(t) if t else [] for t in texts]
        firsts = self.changes({x[0] for x in split if x}, True)
        others = self.changes({s for x in split for s in x[1:]}, False)
        return [self._joined([firsts[x[0]], *map(others.__getitem__, x[1:])] if x else []) for x in split]

    @staticmethod
    def _joined(changes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not changes:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        pairs = np.frombuffer(b"".join(changes), np.int32).reshape(-1, 2)
        sizes = np.fromiter(map(len, changes), np.int64, len(changes)) // 8
        ends = pairs[np.cumsum(sizes) - 1]
        before = np.cumsum(ends, axis=0, dtype=np.int32) - ends
        out = _changes(*(pairs + np.repeat(before, sizes, axis=0)).T)
        return out[:, 0], out[:, 1]

    def table(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.tables([text])[0]

    def prefix(self, text: str, chars: int, table=None) -> int:
        """Exact tokens of ``text[:chars]``, from the table."""
        starts, tokens = self.table(text) if table is None else table
        at = int(np.searchsorted(starts, chars, side="right"))
        return int(tokens[at - 1]) if at else 0


def _changes(chars: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The rows of ``chars, tokens`` where tokens change, and the last."""
    keep = np.diff(tokens, prepend=np.int32(0)) != 0
    keep[-1:] = True
    return np.stack([chars[keep], tokens[keep]], axis=1)


@lru_cache(maxsize=2)
def counter(model: bytes) -> Counter:
    return Counter(model)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.array([], np.int32)])))


def prefix_tables(model_file: str):
    """Column function: text -> ``struct<chars, tokens>``, where the count changes."""
    with open(model_file, "rb") as f:
        model = f.read()

    @F.arrow_udf(PREFIXES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(model)
        for texts in batches:
            rows = own.tables([t or "" for t in texts.to_pylist()])
            yield pa.StructArray.from_arrays([_lists([r[0] for r in rows]), _lists([r[1] for r in rows])],
                                             ["chars", "tokens"])

    return run


def total(table: Column) -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.get(table["tokens"], F.size(table["tokens"]) - 1), F.lit(0)).cast("long")


def fitting_chars(table: Column, budget: int | Column) -> Column:
    """Characters of the longest prefix within ``budget`` tokens."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    chars, tokens = table["chars"], table["tokens"]
    last = F.coalesce(F.array_max(F.transform(tokens, lambda x, i: F.when(x <= budget, i))), F.lit(-1))
    # the place before the next change
    cut = F.coalesce(F.get(chars, last + 1) - 1, F.get(chars, last))
    return F.coalesce(F.when(total(table) <= budget, F.get(chars, F.size(chars) - 1)).otherwise(cut),
                      F.lit(0)).cast("long")


def prefix_tokens(table: Column, chars: int | Column) -> Column:
    """Tokens of the first ``chars`` characters, or of the whole text if it is shorter."""
    chars = F.lit(chars) if isinstance(chars, int) else chars
    at = F.size(F.filter(table["chars"], lambda x: x <= chars)) - 1
    return F.coalesce(F.get(table["tokens"], at), F.lit(0)).cast("long")


def count_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_bytes, prefixes`` of each row of ``docs``; other columns
    are ignored, and nothing is shuffled."""
    prepare(docs.sparkSession)
    text = text_or_empty()
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                       prefix_tables(model_file)(text).alias("prefixes"))
