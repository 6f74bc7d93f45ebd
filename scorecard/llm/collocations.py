"""Phrase collocations by tries of candidates (operator 13).

A text is lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and these into
words at spaces and tabs.  Phrases are 2 to 4 words next to each other in a piece.

1. Words and pairs.  Each task counts them in blocks; Spark sums the blocks.
   Words and pairs with ``LEAST`` or more occurrences are kept.
2. Candidates of k words go into double-array tries, which are broadcast,
   ``TOGETHER`` at a time.  Numpy advances the states of all text positions at once,
   a level for each word, and counts the accepting states; Spark sums the shards.
3. Candidates of k + 1 words.  A phrase can be frequent only if its first k
   words are (Apriori), so in the same walk every accepting state is counted
   with the words that follow it.  Those with ``LEAST`` or more occurrences are the
   next candidates; at the last level these counts, which are exact, are final.
4. Scores are exact whole numbers (decimals of 38 digits).

Candidates are dealt by the hash of their first two words into as many tries as it
takes for ``TRIE`` phrases each, about, whatever their number; a trie is built in a
task, the driver holds one, and a worker ``TOGETHER`` of them.  So many tries cost one
pass over the texts, in which each position meets a single trie.

Defined results: null text is empty, null ``lang`` is ``und``; empty texts have no
words; repeated rows and ids count each.  A very long text passes in parts of ``PART``
bytes cut between words, phrases across the cut included.  Ties of score and
occurrences are ordered by phrase.  Empty tables give no rows.  Columns other than
``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, split_hot, stored

#: Words of the longest phrase, occurrences of a candidate, phrases returned for each language.
LONGEST, LEAST, TOP = 4, 30, 2000
#: A phrase is dropped if a longer one around it has this share of its occurrences (percent).
COVERED = 80
SCALE = 2_000_000
#: Phrases of a trie, about, and tries that one pass over the texts takes along.
TRIE, TOGETHER = 100_000, 8
#: Bytes of text that are split into words at once; words that are counted at once.
PART, BLOCK = 1 << 20, 1_500_000
#: Distinct words that a task numbers before it begins anew.
NUMBERED = 500_000
#: Rows of the Arrow batches that tasks return.
ROWS_OUT = 20_000
#: Parts in which a language's phrases are ranked before the last ranking.
RANKED = 8

#: The letters that are lower-cased and the characters that end a piece.
UPPER, LOWER, ENDS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b".,;:!?\n\x0b\x0c\r"
#: The end of a piece among words; the byte is in no UTF-8 text.
END = b"\xff"
_TABLE = bytes.maketrans(UPPER + ENDS, LOWER + END * len(ENDS))
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
COUNTS_SQL = "lang string, phrase string, n bigint"


# --- words as numbers -------------------------------------------------------

def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text and the ends of its pieces, in parts."""
    at = 0
    while at < len(text):
        to = at + PART
        if to < len(text):  # not within a word
            to = min([i for i in (text.find(b" ", to), text.find(b"\t", to)) if i >= 0], default=len(text))
        yield text[at:to].translate(_TABLE).replace(END, b" \xff ").split()
        at = to


class Numbered:
    """Numbers for words, by first appearance; the end of a piece is 0."""

    def __init__(self):
        self.ids = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[END]
        self.words: list[bytes] = []

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))

    def listed(self) -> list[bytes]:
        """All words by number."""
        if len(self.words) < len(self.ids):
            self.words = list(self.ids)
        return self.words


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Numbered, np.ndarray, int]]:
    """``lang, numbering, words, starts`` of blocks of text.

    Phrases that begin before ``starts`` are the block's own; the words after it
    are there to complete them.
    """
    numbers, waiting, total = Numbered(), defaultdict(list), 0

    def emptied(reading=None):
        for lang in list(waiting):
            ids = np.concatenate(waiting.pop(lang))
            if lang == reading:  # in the middle of a text
                starts = max(len(ids) - (LONGEST - 1), 0)
                waiting[lang].append(ids[starts:])
                yield lang, numbers, ids, starts
            else:
                yield lang, numbers, ids, len(ids)

    for batch in batches:
        texts, langs = (batch.column(c) for c in ("text", "lang"))
        for lang, text in zip(langs.to_pylist(), texts.cast(pa.binary())):
            for part in words_of(text.as_py() or b""):
                waiting[lang].append(numbers.of(part))
                total += len(part)
                if total >= BLOCK:
                    yield from emptied(lang)
                    total = 0
            waiting[lang].append(np.zeros(1, np.int32))
            if len(numbers.ids) > NUMBERED:
                yield from emptied()
                numbers, total = Numbered(), 0
    yield from emptied()


def _rows(lang: str, parts: list[tuple[pa.Array, np.ndarray]], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Phrases with their counts, in small batches; a phrase joins what ``parts`` (texts
    and places in them) have for it."""
    for i in range(0, len(n), ROWS_OUT):
        texts = [words.take(pa.array(at[i:i + ROWS_OUT])) for words, at in parts]
        phrases = pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.binary())) if len(texts) > 1 else texts[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), phrases.cast(pa.string()),
                                          pa.array(n[i:i + ROWS_OUT])], schema=COUNTS)


def words_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, of pairs, and of all words (the empty phrase)."""
    for lang, numbers, ids, starts in blocks(batches):
        own, size = ids[:starts], len(numbers.ids)
        n = np.bincount(own, minlength=size)
        n[0] = 0
        found = np.flatnonzero(n)
        words = pa.array(numbers.listed(), pa.binary())
        yield from _rows(lang, [(words, found)], n[found])
        yield from _rows(lang, [(pa.array([b""], pa.binary()), np.zeros(1, np.int64))], n.sum(keepdims=True))
        a, b = own[:len(ids) - 1], ids[1:starts + 1]
        inside = (a > 0) & (b > 0)
        pairs, n = np.unique(a[inside].astype(np.int64) * size + b[inside], return_counts=True)
        yield from _rows(lang, [(words, pairs // size), (words, pairs % size)], n)


# --- double-array tries -----------------------------------------------------

class DoubleArrayTrie:
    """Phrases of (lang, words).  The state after code ``c`` in state ``s`` is
    ``base[s] + c`` if ``check`` there is ``s``.  State 0 is dead, 1 the root; a
    language is the root's first symbol."""

    def __init__(self, phrases: list[tuple[str, str]], part: int = 0):
        phrases = sorted(phrases)
        self.part, self.names = part, sorted({lang for lang, _ in phrases})
        at = {lang: i for i, lang in enumerate(self.names)}
        self.lang_of = np.array([at[lang] for lang, _ in phrases], np.int32)
        texts = [phrase.encode() for _, phrase in phrases]
        self.text, self.ends = b"".join(texts), np.cumsum([0, *map(len, texts)], dtype=np.int32)
        keys = [(lang, *text.split(b" ")) for (lang, _), text in zip(phrases, texts)]
        seen: dict = defaultdict(int)
        for key in keys:
            for x in key:
                seen[x] += 1
        # frequent symbols have small codes, so that children lie close
        self.codes = {x: i for i, x in enumerate(sorted(seen, key=lambda x: (-seen[x], isinstance(x, bytes), x)), 1)}
        self._lay(self._children(keys), len(self.codes))
        self.langs = {x: self.base[1] + c for x, c in self.codes.items() if isinstance(x, str)}
        self.depth = max((len(k) - 1 for k in keys), default=0)

    def __len__(self) -> int:
        return len(self.lang_of)

    def phrases(self) -> pa.Array:
        """The phrases by number."""
        return pa.BinaryArray.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(self.ends), pa.py_buffer(self.text)])

    def _children(self, keys: list[tuple]) -> list[dict[int, int]]:
        """Children by code of the plain trie's nodes; the root is node 0."""
        nodes, self._ends = [{}], {}
        for i, key in enumerate(keys):
            at = 0
            for x in key:
                c = self.codes[x]
                to = nodes[at].get(c)
                if to is None:
                    to = nodes[at][c] = len(nodes)
                    nodes.append({})
                at = to
            self._ends[at] = i
        return nodes

    def _lay(self, nodes: list[dict[int, int]], symbols: int) -> None:
        """Find a base for each node: those with most children first, the last
        ones, with a single child, fill the gaps."""
        used = np.zeros(2 * (len(nodes) + symbols) + 4, bool)
        used[:2] = True
        state, base, low, hint, end = {0: 1}, {}, 2, 2, 2
        for at in sorted(range(len(nodes)), key=lambda i: -len(nodes[i])):
            kids = nodes[at]
            if not kids:
                break
            codes = np.fromiter(sorted(kids), np.int64, len(kids))
            offset = codes - codes[0]
            while used[low]:
                low += 1
            # nodes with several children begin where the last one fitted; the others fill the gaps before it
            start, window = max(hint, low) if len(kids) > 1 else low, 256
            while True:  # the end always fits
                if start + window + offset[-1] >= len(used):
                    used = np.concatenate([used, np.zeros(len(used) + window + int(offset[-1]), bool)])
                near = start + np.flatnonzero(~used[start:start + window])
                fits = near[~used[near[:, None] + offset].any(axis=1)]
                if len(fits):
                    break
                start, window = start + window, max(min(2 * window, (1 << 20) // len(kids)), 1)
            first, hint = int(fits[0]), start
            used[first + offset] = True
            end = max(end, first + int(offset[-1]) + 1)
            base[at] = first - int(codes[0])
        order = [0]
        for at in order:  # parents first: states of children follow from the base
            for c, kid in nodes[at].items():
                state[kid] = base[at] + c
                order.append(kid)
        size = end + symbols + 1
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.accept = np.full(size, -1, np.int32)
        for at, kids in enumerate(nodes):
            if kids:
                self.base[state[at]] = base[at]
                for c in kids:
                    self.check[base[at] + c] = state[at]
        for at, i in self._ends.items():
            self.accept[state[at]] = i
        del self._ends

    def advance(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next states; 0 where there is none, and for code 0."""
        to = self.base[states] + codes  # no state is below minus the number of codes
        return np.where((self.check[to] == states) & (codes > 0), to, 0)


def owner(first: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
    """The part of phrases that begin with two words, from the words' CRC-32."""
    return (31 * first + second) % parts


class Walk:
    """The states of some tries, of ``parts`` in all, over blocks of text.

    Each position is walked by the one trie that holds the phrases of its first
    two words, so the work does not grow with the number of tries.
    """

    def __init__(self, tries: list[DoubleArrayTrie], parts: int):
        self.tries, self.parts, self.numbers = tries, parts, None

    def _learn(self, numbers: Numbered) -> None:
        """Codes of the words in each trie, and their checksums."""
        words = numbers.listed()
        if numbers is not self.numbers:
            self.numbers, self.sums = numbers, np.zeros(0, np.int64)
            self.codes = [np.zeros(0, np.int32) for _ in self.tries]
        new = words[len(self.sums):]
        if new:
            self.sums = np.concatenate([self.sums, np.fromiter(map(zlib.crc32, new), np.int64, len(new))])
            self.codes = [np.concatenate([c, np.fromiter((t.codes.get(w, 0) for w in new), np.int32, len(new))])
                          for c, t in zip(self.codes, self.tries)]

    def accepted(self, lang: str, numbers: Numbered, ids: np.ndarray, starts: int):
        """For each trie (by place) and level: the start positions of accepted
        phrases, and their numbers."""
        self._learn(numbers)
        first = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        first = first[first < starts]
        if self.parts > 1:
            part = owner(self.sums[ids[first]], self.sums[ids[first + 1]], self.parts)
            order = np.argsort(part, kind="stable")
            first, part = first[order], part[order]
        for i, (trie, codes) in enumerate(zip(self.tries, self.codes)):
            if lang not in trie.langs:
                continue
            at = first if self.parts == 1 else first[slice(*np.searchsorted(part, [trie.part, trie.part + 1]))]
            states = np.full(len(at), trie.langs[lang], np.int32)
            for level in range(trie.depth):
                inside = at + level < len(ids)
                at, states = at[inside], states[inside]
                states = trie.advance(states, codes[ids[at + level]])
                alive = states > 0
                at, states = at[alive], states[alive]
                found = trie.accept[states]
                yield i, level + 1, at[found >= 0], found[found >= 0]


def stepped(batches: Iterator[pa.RecordBatch], tries: list[DoubleArrayTrie], parts: int) -> Iterator[pa.RecordBatch]:
    """Counts of the tries' phrases, which have one length, and of each with every
    word that follows it."""
    walk, counts = Walk(tries, parts), [np.zeros(len(t), np.int64) for t in tries]
    phrases = [t.phrases() for t in tries]
    for lang, numbers, ids, starts in blocks(batches):
        size, words = len(numbers.ids), pa.array(numbers.listed(), pa.binary())
        for i, level, at, found in walk.accepted(lang, numbers, ids, starts):
            counts[i] += np.bincount(found, minlength=len(counts[i]))
            inside = at + level < len(ids)
            at, found = at[inside], found[inside].astype(np.int64)
            after = ids[at + level]
            longer, n = np.unique((found * size + after)[after > 0], return_counts=True)
            yield from _rows(lang, [(phrases[i], longer // size), (words, longer % size)], n)
    for trie, texts, n in zip(tries, phrases, counts):
        for j, lang in enumerate(trie.names):
            own = np.flatnonzero((trie.lang_of == j) & (n > 0))
            yield from _rows(lang, [(texts, own)], n[own])


# --- the corpus -------------------------------------------------------------

def built_tries(phrases: DataFrame, size: int = TRIE) -> tuple[DataFrame, int]:
    """``part, trie`` (pickled) of tries of about ``size`` phrases each, of all
    ``lang, phrase``, and the number of parts.

    A phrase's part follows from its first two words (:func:`owner`).
    """
    parts = max(-(-phrases.count() // size), 1)

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        trie = DoubleArrayTrie(list(zip(group["lang"], group["phrase"])), int(key[0]))
        return pd.DataFrame({"part": [int(key[0])], "trie": [pickle.dumps(trie)]})

    first, second = (F.crc32(F.encode(F.split("phrase", " ")[i], "UTF-8")) for i in (0, 1))
    part = F.pmod(31 * first + second, F.lit(parts)).cast("int")
    return stored(phrases.select("lang", "phrase", part.alias("part")).groupBy("part")
                  .applyInPandas(build, "part int, trie binary"), "phrase-tries"), parts


def walked(texts: DataFrame, phrases: DataFrame, walk, size: int = TRIE, together: int = TOGETHER) -> DataFrame:
    """``lang, phrase, n``: the sums of ``walk`` over all tries and texts, a pass
    over the texts for each ``together`` tries."""
    spark, done = texts.sparkSession, []
    built, parts = built_tries(phrases, size)
    names = sorted(row["part"] for row in built.select("part").collect())  # a number a trie
    for at in range(0, len(names), together):
        sent = [spark.sparkContext.broadcast(pickle.loads(built.where(F.col("part") == i).first()["trie"]))
                for i in names[at:at + together]]
        rows = texts.mapInArrow(lambda batches, sent=sent: walk(batches, [b.value for b in sent], parts), COUNTS_SQL)
        done.append(stored(rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "walked"))
        for b in sent:
            b.unpersist()
    if not done:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in
                                       (("lang", "string"), ("phrase", "string"), ("n", "long"))])
    union = done[0]
    for d in done[1:]:
        union = union.unionByName(d)
    return union  # a phrase comes from a single trie: no further sum


def frequent_phrases(docs: DataFrame, least: int = LEAST, size: int = TRIE) -> DataFrame:
    """``lang, phrase, n`` of words and phrases with ``least`` or more occurrences,
    and, under the empty phrase, the number of all words.  Runs the passes over
    the texts when it is called."""
    prepare(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    enough = (F.col("n") >= least) | (F.col("phrase") == "")
    short = stored(texts.mapInArrow(words_and_pairs, COUNTS_SQL).groupBy("lang", "phrase")
                   .agg(F.sum("n").alias("n")).where(enough), "words-and-pairs")
    n_words = F.size(F.split("phrase", " "))
    counts, level = short.where(n_words == 1), short.where(n_words == 2)
    for k in range(2, LONGEST):
        rows = stored(walked(texts, level, stepped, size).where(enough), "candidates")
        counts, level = counts.unionByName(rows.where(n_words == k)), rows.where(n_words == k + 1)
    return stored(counts.unionByName(level), "phrase-counts")


def _joined(words, start, n):
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, size: int = TRIE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases.

    ``a``, ``l`` and ``r`` are the occurrences of the phrase and of the two parts of its
    lowest-scoring cut, ``n`` those of all words, and the score is ``2000000 a / (l + r)``,
    rounded down.
    """
    counts = frequent_phrases(docs, least, size)
    words = F.split("phrase", " ")
    phrases = counts.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))

    # both parts of every cut meet their counts; a word that begins very many phrases does not gather them
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.inline(F.array(
        F.struct(F.lit("l").alias("side"), _joined("words", F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit("r").alias("side"), _joined("words", F.col("k") + 1, F.size("words")).alias("part")))))
    sides = stored(sides, "phrase-cuts")
    asked = sides.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n_asked"))
    known = stored(counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
                   .join(asked, ["lang", "part"]), "asked-counts")
    met = split_hot(sides, known, ["lang", "part"], "n_asked", sides.count())
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"),
                                                       F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    score = F.expr(f"cast(a as decimal(38, 0)) * {SCALE} div (cast(l as decimal(20, 0)) + r)")
    scored = (both.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
              .groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")))

    # the most frequent longer phrase around each
    inner = phrases.where(F.size("words") > 2).select(
        "lang", "a", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("len"))
    inner = inner.select("lang", "a", "words", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1))
                         .alias("at")).select("lang", _joined("words", F.col("at"), F.col("len")).alias("phrase"), "a")
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    covered = F.expr(f"cast(around as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {COVERED}")
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | ~covered)

    # each part of a language is cut to its best, then the language
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score",
                       F.pmod(F.xxhash64("phrase"), F.lit(RANKED)).alias("part"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = first.where(F.col("rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = counts.where("phrase = ''").select("lang", "n")
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                                       "score")
