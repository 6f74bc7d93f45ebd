"""Token ids as ORC files (operator 6).

Documents are dealt into ranges of ascending ``doc_id``, sorted, encoded and
written as ORC: integer run-length encoding in stripes, row indexes, and Bloom
filters on ``doc_id``.  Readers split the files by stripes; a filter on
``doc_id`` skips files, stripes and row groups by minimum, maximum and Bloom
filter.

Texts are cut into units, each encoded once by the library and remembered: at
spaces and line feeds, and between a letter and an ASCII mark.  The split pattern
parts there too and looks at nothing beyond, the normaliser joins nothing across,
and no special token holds such a place (marks before a letter exclude ``'``, which
begins contractions, and ``|`` is never cut off).  Letters here are those of ASCII,
and U+00C0 to U+017F before a mark.  ASCII capitals are lowered first, except
before a character outside ASCII (it may be a combining mark) and where ``<|``, with
which special tokens begin, occurs.  So the ids are those of the whole text.

Units lie in numpy arrays: their bytes, up to 15 with their number, are the keys of
a table of ids, and only units not met before become Python strings.

Defined results: null text is empty and holds the end id only; null ids of
documents come first, and rows of one id are in the order of their text's
hash; an empty table gives files without rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .common import prepare, text_or_empty

END_ID = 1
#: Units that a worker remembers, plain units that go to the library as one text,
#: and bytes of text that are worked on at once.
REMEMBERED, JOINED, PART_BYTES = 700_000, 1024, 1 << 20
#: Bytes of a unit that are its key; longer units are remembered by name.
KEY_BYTES = 15
#: What special tokens begin with.
SPECIAL = b"<|"
#: ORC writer settings.
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
           "orc.create.index": "true", "orc.row.index.stride": "1000",
           "orc.stripe.size": str(16 << 20), "compression": "zstd"}


_MIX = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: Bits of the first and the second 8 bytes that units of a size have.
_KEEP = np.array([[(1 << 8 * min(n, 8)) - 1 for n in range(KEY_BYTES + 1)],
                  [(1 << 8 * max(n - 8, 0)) - 1 for n in range(KEY_BYTES + 1)]], np.uint64)
_BEGINS, _ENDS, _MAYBE, _FORCED = 1, 2, 4, 64


def _tables() -> tuple[bytes, bytes, np.ndarray]:
    """Kinds of bytes (0 white space, 1 letter, 2 mark, 3 apostrophe, 4 other), and
    whether a unit begins or ends between two kinds (``_FORCED``: in any case)."""
    kind, flags = bytearray([4] * 256), bytearray(256)
    for b in range(33, 127):
        kind[b] = 1 if chr(b).isalpha() else 4 if chr(b).isdigit() or chr(b) == "|" else 3 if chr(b) == "'" else 2
    kind[10] = kind[32] = 0
    for a, b, forced in product(range(5), range(5), (0, _FORCED)):
        cut = bool(forced) or (a, b) in ((1, 2), (1, 3), (2, 1))
        begins, ends = b > 0 and (a == 0 or cut), a > 0 and (b == 0 or cut)
        flags[forced | a << 3 | b] = (_BEGINS * begins | _ENDS * ends | _MAYBE * (a == 4 and b in (2, 3)))
    latin = np.zeros((256, 256), bool)
    latin[0xC3:0xC6, 0x80:0xC0] = True
    latin[[0xC3, 0xC3, 0xC4], [0x97, 0xB7, 0xB0]] = False  # two signs, and the I whose lower case has a mark
    return bytes(kind), bytes(flags), latin


_KIND, _FLAGS, _LATIN = _tables()


@lru_cache(maxsize=2)
def _worker(tokenizer: bytes):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the cores
    from tokenizers import Tokenizer

    return WordEncoder(Tokenizer.from_buffer(tokenizer))


class _Entries:
    """Units met before and their ids, in arrays: keys (two numbers) in an open hash
    table, ids in one row.  The more recently used half stays when there are ``limit``."""

    def __init__(self, limit: int):
        self.limit, self.now, self.size, self.n_ids = limit, 0, 0, 0
        self.bits = max(2 * limit - 1, 1).bit_length()
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.columns = {"low": np.zeros(1, np.uint64), "high": np.zeros(1, np.uint64), "seen": np.zeros(1, np.int32),
                        "at": np.zeros(1, np.int64), "n": np.zeros(1, np.int64)}
        self.ids = np.zeros(1, np.int32)
        self.long: dict[bytes, int] = {}

    def _first(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * _MIX[0] ^ high * _MIX[1]
        h ^= h >> np.uint64(29)
        h *= _MIX[2]
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _index(self) -> None:
        """Deal all entries into slots anew; those of long units have no key."""
        self.slots = np.full(1 << self.bits, -1, np.int32)
        low, high = self.columns["low"][:self.size], self.columns["high"][:self.size]
        short = np.flatnonzero(high)
        slot, _ = self._claim(low[short], high[short])
        self.slots[slot] = short

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for none."""
        lows, highs, last = self.columns["low"], self.columns["high"], len(self.slots) - 1
        slot = self._first(low, high)
        out = self.slots[slot]
        # an empty slot ends the search, another key's leads to the next
        left = np.flatnonzero((out >= 0) & ((lows[out] != low) | (highs[out] != high)))
        while len(left):
            slot[left] = slot[left] + 1 & last
            got = self.slots[slot[left]]
            out[left] = got
            left = left[(got >= 0) & ((lows[got] != low[left]) | (highs[got] != high[left]))]
        return out

    def _claim(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of keys that have no entry yet, and for each key the row that stands for it."""
        slot, owner, left = self._first(low, high), np.zeros(len(low), np.int64), np.arange(len(low))
        while len(left):
            at = slot[left]
            free = self.slots[at] == -1
            self.slots[at[free]] = -2 - left[free]
            holder = -2 - self.slots[at].astype(np.int64)
            own = np.maximum(holder, 0)
            same = (holder >= 0) & (low[own] == low[left]) & (high[own] == high[left])
            owner[left[same]] = holder[same]
            left = left[~same]
            slot[left] = slot[left] + 1 & len(self.slots) - 1
        return slot, owner

    def add(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New entries for keys that have none: the entry of each, and the rows that stand for the entries."""
        if 4 * (self.size + len(low)) > 3 * len(self.slots):
            self.bits = (2 * (self.size + len(low))).bit_length()
            self._index()
        slot, owner = self._claim(low, high)
        new = np.flatnonzero(owner == np.arange(len(low)))
        entry = np.zeros(len(low), np.int32)
        entry[new] = np.arange(self.size, self.size + len(new), dtype=np.int32)
        self.slots[slot[new]] = entry[new]
        return entry[owner], new

    def learn(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Append entries with their ``n`` ids each."""
        stop, stop_ids = self.size + len(n), self.n_ids + len(ids)
        for name, values in (("low", low), ("high", high), ("seen", self.now), ("at", self.n_ids + np.cumsum(n) - n),
                             ("n", n)):
            if stop > len(self.columns[name]):
                self.columns[name] = np.resize(self.columns[name], 2 * stop)
            self.columns[name][self.size:stop] = values
        if stop_ids > len(self.ids):
            self.ids = np.resize(self.ids, 2 * stop_ids)
        self.ids[self.n_ids:stop_ids] = ids
        self.size, self.n_ids = stop, stop_ids

    def take(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``entries``, one after the other, and where those of each end."""
        n = self.columns["n"][entries]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.columns["at"][entries] - ends + n, n) + np.arange(total)], ends

    def forget(self) -> None:
        if self.size <= self.limit:
            return
        keep = np.sort(np.argsort(-self.columns["seen"][:self.size], kind="stable")[:self.limit // 2])
        moved = np.full(self.size, -1, np.int32)
        moved[keep] = np.arange(len(keep))
        self.long = {k: int(moved[i]) for k, i in self.long.items() if moved[i] >= 0}
        ids, _ = self.take(keep)
        low, high, n, seen = (self.columns[c][keep] for c in ("low", "high", "n", "seen"))
        self.size = self.n_ids = 0
        self.learn(low, high, ids, n)
        self.columns["seen"][:self.size] = seen
        self._index()


class WordEncoder:
    """Encodes texts unit by unit, as the module's text says."""

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = tokenizer
        ids = tokenizer.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[i for piece, i in ids.items() if piece.endswith("</w>")]] = True
        self.known = _Entries(REMEMBERED)
        # lower-case ASCII letters are as they are to the normaliser and the split
        self.model = Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")

    def _learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, and how many each has.  A unit of letters ends in the
        one piece that ends a word, so many go to the library as one text."""
        texts = b" ".join(units).decode().split(" ")
        # a letter whose lower case has a mark is more than a letter
        kind = np.array([0 if not t.isalpha() else (1 if t.islower() else 2) if t.isascii() else
                         2 if t.lower().isalpha() else 0 for t in texts], np.int8)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, tokenizer in ((1, self.model), (2, self.tokenizer)):
            where = np.flatnonzero(kind == k)
            for i in range(0, len(where), JOINED):
                part = where[i:i + JOINED]
                joined = " ".join([texts[j] for j in part.tolist()])
                ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(part):
                    found.append((part, ids, np.diff(cuts, prepend=0)))
                else:
                    kind[part] = 0
        other = np.flatnonzero(kind == 0)
        if len(other):
            rows = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in other.tolist()],
                                                                    add_special_tokens=False)]
            found.append((other, np.array([i for ids in rows for i in ids], np.int32),
                          np.array([len(ids) for ids in rows], np.int64)))
        order = np.concatenate([f[0] for f in found])
        ids, n = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
        if np.array_equal(order, np.arange(len(order))):
            return ids, n
        begin, back = np.cumsum(n) - n, np.argsort(order)
        n, begin = n[back], begin[back]
        return ids[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(len(ids))], n

    def _entries(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of each unit ``data[begin:end]``; those not known are learnt."""
        known, size = self.known, end - begin
        known.forget()
        known.now += 1
        short = np.minimum(size, KEY_BYTES)
        keys = sliding_window_view(np.frombuffer(data, np.uint8), 16)[begin].view("<u8")
        low = keys[:, 0] & _KEEP[0][short]
        high = keys[:, 1] & _KEEP[1][short] | short.astype(np.uint64) << np.uint64(56)
        entry = known.find(low, high)
        longer = np.flatnonzero(size > KEY_BYTES)
        if len(longer):
            units = [data[a:b] for a, b in zip(begin[longer].tolist(), end[longer].tolist())]
            new = list(dict.fromkeys(u for u in units if u not in known.long))
            if new:
                known.long.update(zip(new, range(known.size, known.size + len(new))))
                known.learn(0, 0, *self._learn(new))
            entry[longer] = [known.long[u] for u in units]
        missed = np.flatnonzero(entry < 0)
        if len(missed):
            low, high = low[missed], high[missed]
            entry[missed], new = known.add(low, high)
            rows = missed[new]
            units = [data[a:b] for a, b in zip(begin[rows].tolist(), end[rows].tolist())]
            known.learn(low[new], high[new], *self._learn(units))
        known.columns["seen"][entry] = known.now
        return entry

    def _part(self, data: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a stretch of text that begins and ends at white space or a
        text's border, and how many of them lie before each of ``cuts``."""
        data = b" " + data + b" " * 16
        codes = np.frombuffer(data, np.uint8)
        kinds = np.frombuffer(data.translate(_KIND), np.uint8)
        pairs = kinds[:-1] << 3
        pairs |= kinds[1:]
        pairs[cuts] |= _FORCED
        flags = np.frombuffer(pairs.tobytes().translate(_FLAGS), np.uint8)
        maybe = np.flatnonzero(flags & _MAYBE)
        if len(maybe):  # a letter of two bytes before a mark
            flags = flags.copy()
            flags[maybe[_LATIN[codes[maybe - 1], codes[maybe]]]] |= _BEGINS | _ENDS
        begin, end = np.flatnonzero(flags & _BEGINS) + 1, np.flatnonzero(flags & _ENDS) + 1
        if SPECIAL not in data:
            # a capital that a mark may follow is left to the library
            lower = np.frombuffer(bytearray(data.lower()), np.uint8)
            joined = np.flatnonzero(codes[1:] >= 128)
            lower[joined] = codes[joined]
            data = lower.tobytes()
        ids, ends = self.known.take(self._entries(data, begin, end))
        return ids, np.concatenate([[0], ends])[np.searchsorted(begin, cuts + 1)]

    def encode_bytes(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after the other in ``data``, and where each text's ids end."""
        raw, parts, at, total, done = data.tobytes(), [], 0, 0, [np.zeros(0, np.int64)]
        k = 0
        while at < len(data):
            stop = min(at + PART_BYTES, len(data))
            if stop < len(data):
                stop = raw.rfind(b" ", at, stop) + 1 or raw.find(b" ", stop) + 1 or len(data)
            j = int(np.searchsorted(ends, stop, "right"))
            ids, before = self._part(raw[at:stop], ends[k:j] - at)
            done.append(total + before)
            parts.append(ids)
            at, k, total = stop, j, total + len(ids)
        done.append(np.full(len(ends) - k, total, np.int64))
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate(done)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit integers."""
        rows = [t.encode() for t in texts]
        ids, ends = self.encode_bytes(np.frombuffer(b"".join(rows), np.uint8),
                                      np.cumsum([len(r) for r in rows], dtype=np.int64))
        return [part.tobytes() for part in np.split(ids, ends[:-1])] if rows else []


def read_tokenizer(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(tokenizer: bytes, end_id: int | None = END_ID):
    """Column function: text -> ``array<int>`` of ids, the end id last."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = _worker(tokenizer)
        for texts in batches:
            texts = texts.cast(pa.large_binary()).fill_null(b"")
            _, offsets, data = texts.buffers()
            begin = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
            data = np.frombuffer(data or b"", np.uint8)[begin[0]:begin[-1]]
            ids, ends = words.encode_bytes(data, begin[1:] - begin[0])
            if end_id is not None:
                ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))

    return encode


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int | None = END_ID) -> None:
    """Write ``doc_id, seq, n_tokens, ids`` of ``docs`` as ORC to ``path``, in
    ascending order of ``doc_id``.  ``seq`` ascends too: the range above bit 33,
    the row within it below."""
    prepare(docs.sparkSession)
    encode = encoder(read_tokenizer(tokenizer_file), end_id)
    text = docs.select("doc_id", text_or_empty().alias("text"))
    # the shuffle takes texts, and what is encoded stays in its range
    ordered = (text.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie"))
    encoded = ordered.select("doc_id", F.monotonically_increasing_id().alias("seq"), encode("text").alias("ids"))
    encoded = encoded.select("doc_id", "seq", F.size("ids").cast("long").alias("n_tokens"), "ids")
    encoded.write.options(**OPTIONS).orc(path)


def read_ids(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The files of :func:`write_ids`; filters on ``doc_id`` are pushed down."""
    return spark.read.schema(f"doc_id {id_type}, seq bigint, n_tokens bigint, ids array<int>").orc(path)


def ids_crc32():
    """Column function: unsigned crc32 of ids as little-endian unsigned 32-bit
    integers."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            flat, ends = np.asarray(lists.flatten(), "<u4"), np.cumsum([0, *lists.value_lengths().to_pylist()])
            yield pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])], pa.int64())

    return run


def starts_of(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files.

    ``start`` is a sum within the document's range plus the sums of all ranges
    before it, of which there is a row each.
    """
    part = F.shiftright("seq", 33).alias("part")
    rows = files.select("doc_id", part, "seq", "n_tokens", ids_crc32()("ids").alias("ids_crc32"))
    # only the counts are read again for the ranges' sums
    whole = files.groupBy(part).agg(F.sum("n_tokens").alias("n"))
    before = whole.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
            .join(before, "part")
            .select("doc_id", (F.col("_before") + F.col("_within")).alias("start"), "n_tokens", "ids_crc32"))


def token_file_index(docs: DataFrame, tokenizer_file: str, path: str | None = None) -> DataFrame:
    """Write the files (below the shared folder without ``path``), read them
    back, and return :func:`starts_of` them.  The write runs when called."""
    path = path or shared_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer_file)
    return starts_of(read_ids(docs.sparkSession, path, docs.schema["doc_id"].dataType.simpleString()))
