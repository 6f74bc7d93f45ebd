"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 4).

**Fingerprint.**  The 64 bits of XXH64 (seed 42) of every word shingle vote;
a bit is set if more than half of the shingles set it.

**Keys.**  The perfect binary Golay code [23, 12] decodes every 23-bit word
to the one codeword within 3 bits.  A fingerprint is cut into segments of
22, 21 and 21 bits, each padded with zeros to 23.  For a segment x, let p(x)
be the codeword that x decodes to, and K(x) the codewords that x or a word
one bit away decodes to (1 to 6 of them).  If x and y differ in one bit, p(y)
is in K(x) and p(x) in K(y); if they differ in two, the word between them
shows that K(x) and K(y) meet.

**Pigeonhole.**  Up to four errors over three segments leave either

* a segment Z without error, and then another, B, with two at most: both
  fingerprints offer (Z, k) for every k in K(B), for each of the six (Z, B); or
* at least one error everywhere, so (1, 1, 1) or (2, 1, 1) in some order: two
  segments A, B with exactly one, and one, C, with two at most, of whose three
  parts one has none.  The parity of A differs, so the fingerprint whose A is
  even offers (k, p(B)) for k in K(A), and the other (p(A), k) for k in K(B),
  each with a part of C and the parities that follow.

So about 75 keys of 33 bits or more find every pair of up to four differing
bits, and chance meetings stay few.  Fingerprints that share a key are
compared.  A bucket of two is settled where it is counted; larger ones are
compared in blocks of bounded size, each of which returns a spanning forest of
its links, never all pairs.

Only distinct fingerprints are keyed, so copies cost nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, block_of, forest, in_units, starts, units
from .common import id_text, prepare, split_hot, stored
from .components import connected_components

#: Words of a shingle, and the most bits in which linked fingerprints differ.
SHINGLE_WORDS = 4
MAX_BITS = 4
#: Bits of the segments, from the lowest.
SEGMENTS = (22, 21, 21)
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011


@lru_cache(maxsize=1)
def golay_table() -> np.ndarray:
    """For each 23-bit word the index (12 bits) of its codeword."""
    data = np.arange(1 << 12, dtype=np.int64)
    code = np.zeros_like(data)
    for i in range(12):
        code ^= np.where(data >> i & 1, GENERATOR << i, 0)
    table = np.empty(1 << 23, np.int16)
    one = [1 << i for i in range(23)]
    errors = [0, *one]
    errors += [a | b for i, a in enumerate(one) for b in one[:i]]
    errors += [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    for e in errors:
        table[code ^ e] = data
    return table


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text (:mod:`xxhash` for the shingles)."""
    import xxhash

    split = text.encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return 0
    joined = b" ".join(split)
    size = xxhash.xxh64_intdigest
    if len(split) <= words:
        hashes = np.array([size(joined, 42)], np.uint64)
    else:
        lengths = np.fromiter(map(len, split), np.int64, len(split)) + 1
        ends = np.cumsum(lengths)
        begin = (ends - lengths)[:len(split) - words + 1].tolist()
        end = (ends - 1)[words - 1:].tolist()
        hashes = np.fromiter((size(joined[a:b], 42) for a, b in zip(begin, end)), np.uint64, len(end))
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        votes += np.unpackbits(hashes[i:i + 4096].view(np.uint8).reshape(-1, 8),
                               axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = votes * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(words: int = SHINGLE_WORDS):
    """Column function: text -> fingerprint, as a signed ``bigint``."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t or "", words) for t in texts.to_pylist()],
                                    np.uint64).view(np.int64))

    return run


def fingerprint_hex(fp) -> F.Column:
    """16 lowercase hex digits of a signed fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned fingerprints: ``row, key``.  Rows to compare share a
    key, which holds its kind (one of 15) in the bits from the 40th up."""
    table = golay_table()
    words, primary, near, parity = [], [], [], []
    shift = 0
    for bits in SEGMENTS:
        word = (fps >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
        shift += bits
        flips = np.concatenate([[0], 1 << np.arange(bits)])
        decoded = np.sort(table[word[:, None] ^ flips[None, :]], axis=1)
        new = np.ones(decoded.shape, bool)
        new[:, 1:] = decoded[:, 1:] != decoded[:, :-1]
        row, col = np.nonzero(new)
        words.append(word)
        primary.append(table[word].astype(np.int64))
        near.append((row, decoded[row, col].astype(np.int64)))
        parity.append((np.bitwise_count(word) & 1).astype(np.int64))
    rows, keys = [], []

    def add(row, key):
        rows.append(row)
        keys.append(key | np.int64(len(keys)) << 40)

    for z, whole in enumerate(words):
        for row, k in (near[b] for b in range(3) if b != z):
            add(row, whole[row] << 12 | k)
    for a, b in PAIRS:
        c = 3 - a - b
        odd = parity[a].astype(bool)
        (even_row, even_k), (odd_row, odd_k) = near[a], near[b]
        even_k, even_row = even_k[~odd[even_row]], even_row[~odd[even_row]]
        odd_k, odd_row = odd_k[odd[odd_row]], odd_row[odd[odd_row]]
        row = np.concatenate([even_row, odd_row])
        code = np.concatenate([even_k << 12 | primary[b][even_row], primary[a][odd_row] << 12 | odd_k])
        code = code << 1 | (parity[a] ^ parity[b])[row]
        # the first pair of segments also stands for (1, 1, 1)
        code = code << 1 | (0 if (a, b) == PAIRS[0] else parity[c][row])
        for part in (words[c] & 127, words[c] >> 7 & 127, words[c] >> 14):
            add(row, code << 8 | part[row])
    return np.concatenate(rows), np.concatenate(keys)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        row, key = golay_keys(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], ["key", "fp"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key another row has; holds one batch."""
    key = fp = np.empty(0, np.int64)
    met = np.empty(0, bool)
    for batch in batches:
        # the last row waits for the next batch
        key = np.concatenate([key[-1:], batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp[-1:], batch.column(1).to_numpy(zero_copy_only=False)])
        met = np.concatenate([met[-1:], np.zeros(batch.num_rows, bool)])
        same = key[1:] == key[:-1]
        met[1:] |= same
        met[:-1] |= same
        out = np.flatnonzero(met[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(fp[out])], ["key", "fp"])
    if met[-1:].any():
        yield pa.RecordBatch.from_arrays([pa.array(key[-1:]), pa.array(fp[-1:])], ["key", "fp"])


def _links(max_bits: int):
    unit = ["key", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in units(batches, unit):
            fps, left, right, own = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
                                     for c in ("fp", "left", "right", "own"))
            fps = fps.view(np.uint64)
            begin = starts(table, unit)
            found_u, found_v = [], []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(fps)]):
                one, two = fps[a:b][own[a:b] == left[a]], fps[a:b][own[a:b] == right[a]]
                if not len(one) or not len(two):
                    continue
                bits = np.bitwise_count(one[:, None] ^ two[None, :])
                i, j = np.nonzero((bits <= max_bits) & (bits > 0))
                if len(i):
                    u, v = forest(one[i].view(np.int64), two[j].view(np.int64))
                    found_u.append(u)
                    found_v.append(v)
            if found_u:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found_u)), pa.array(np.concatenate(found_v))], ["u", "v"])

    return run


def linked_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges ``u, v`` between rows of ``distinct`` (one column ``fp``), which
    connect exactly what all links connect.  Runs a job when called.

    ``max_bits`` is 4 at most: the keys promise no more.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys find links of up to {MAX_BITS} bits")
    keys = distinct.select("fp").mapInArrow(_key_rows, "key bigint, fp bigint")
    # most keys are met once; the rest is a small table
    keys = stored(in_units(keys, ["key"], []).mapInArrow(_met, "key bigint, fp bigint"), "simhash-met")
    close = F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= max_bits
    buckets = (keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"),
                                       F.max("fp").alias("high"))
               .where((F.col("n") > 2) | (F.col("n") == 2) & close))
    pairs = buckets.where("n = 2").select(F.col("low").alias("u"), F.col("high").alias("v"))
    large = buckets.where("n > 2").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = keys.join(large, "key")
    # a row meets every block of its bucket, its own included
    rows = rows.select("key", "fp", block_of(F.col("fp"), F.col("blocks")).alias("own"),
                       F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
                       "own", "fp")
    compared = in_units(rows, ["key", "left", "right"], []).mapInArrow(_links(max_bits), "u bigint, v bigint")
    return pairs.unionByName(compared)


def fingerprint_components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp, n, component, component_id`` for each distinct fingerprint of
    ``fps`` (columns ``doc_id, fp``): ``n`` rows have it, ``component`` is one
    fingerprint for all that links reach, and ``component_id`` is the smallest
    id of their rows."""
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")),
                      "fingerprints")
    found = connected_components(linked_fingerprints(distinct, max_bits))
    placed = (distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "least", "n", F.coalesce("component", "fp").alias("component")))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    return stored(split_hot(placed, smallest, ["component"], "members", distinct.count())
                  .select("fp", "n", "component", "component_id"), "fingerprint-components")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id, kept``.

    Reads ``doc_id`` and ``text``; other columns are ignored.  Null or blank
    text has fingerprint zero, and is linked like any other.  ``component_id``
    is the smallest id reached, null ids aside (null if there is no other);
    ``kept`` marks the rows that have it, so rows that repeat an id are one
    document.  Runs jobs when called.
    """
    prepare(docs.sparkSession)
    fps = stored(docs.select("doc_id", fingerprints(words)(F.col("text").cast("string")).alias("fp")), "simhash")
    comps = fingerprint_components(fps, max_bits)
    return split_hot(fps, comps, ["fp"], "n", fps.count()).select(
        "doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group, all columns kept, whatever their
    names and types: the one of the smallest id (null ids last), of those that
    share it, of the smallest hash of the text, and of those, of the smallest
    hash of the whole row.  An empty table stays empty, and a very long text is
    one row like any other.  Runs jobs when called.

    Fingerprints are made once and stored without the texts; the chosen
    rows are found again by id and hash of the text."""
    prepare(docs.sparkSession)
    text = docs["text"].cast("string")
    fps = stored(docs.select("doc_id", fingerprints(words)(text).alias("fp"), F.xxhash64(text).alias("text_hash")), "simhash")
    comps = fingerprint_components(fps, max_bits)
    # the first row of each fingerprint, with the number of rows equal to it, and the first of those of a group
    firsts = (fps.groupBy("fp", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("ties"))
              .groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "ties"))
                                 .alias("best")))
    chosen = stored(firsts.join(comps, "fp").groupBy("component").agg(F.min("best").alias("best"))
                    .select(id_text("best.doc_id").alias("own_id"), "best.text_hash", "best.ties"), "kept-of-groups")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), id_text("doc_id").alias("own_id"),
                       F.xxhash64(text).alias("text_hash"))
    kept = split_hot(rows, chosen, ["own_id", "text_hash"], "ties", fps.count())
    if chosen.where("ties > 1").isEmpty():
        return kept.select("row.*")
    # rows of one id and one text: any of them, by the hash of the whole row
    tied = kept.where("ties > 1").groupBy("own_id", "text_hash").agg(
        F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.where("ties = 1").select("row.*").unionByName(tied.select("row.*"))
