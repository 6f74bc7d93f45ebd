"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from helpers import SCHEMA, SF001, empty_docs, read, tricky_docs, tricky_texts

from scorecard.llm import collocations as C
from scorecard.llm import queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    """Occurrences of all phrases of up to 4 words, by language."""
    f = defaultdict(Counter)
    for text, lang in rows:
        own = f[lang or "und"] if lang is None else f[lang]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                own.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return f


def expected(rows, least, top):
    out = []
    for lang, f in counts(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in often.items():
            for m in range(2, len(p)):
                covered.update(q for i in range(len(p) - m + 1) if 100 * a >= 80 * f[q := p[i:i + m]])
        best = []
        for p, a in often.items():
            if p not in covered:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -score)
                for i, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_op13_whole_table(spark):
    rows = [(r[1], r[2]) for r in read(SF001, "documents")]
    assert got(queries.op13_collocations(spark, SF001)) == expected(rows, C.LEAST, C.TOP)


@pytest.mark.parametrize("size", [200_000, 100])
def test_many_tries_and_tricky_texts(spark, size):
    rng = random.Random(2)
    words = ["a", "B", "b", "cc", "é", "日本", "x y", "d\x1ce", "🙂", "don't"]
    texts = tricky_texts() + [
        "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "\r\n", "! ", "\x0b"])
                for _ in range(rng.randrange(120))) for _ in range(60)]
    rows = [(i, t, rng.choice(["en", "de", "", None, "und"]), None, 0) for i, t in enumerate(texts)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'p' AS phrase", "2 AS a", "3 AS rank")
    want = expected([(r[1], r[2]) for r in rows], 3, 25)
    assert got(C.collocations(docs, least=3, top=25, size=size)) == want


def test_tables_without_phrases(spark):
    assert got(C.collocations(empty_docs(spark))) == []
    assert got(C.collocations(tricky_docs(spark, extra=True), least=10**9)) == []


@pytest.mark.parametrize("part,block,numbered", [(7, 5, 1000), (1 << 20, 1, 1), (30, 1000, 4)])
def test_cuts_of_long_texts(monkeypatch, part, block, numbered):
    monkeypatch.setattr(C, "PART", part)
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "NUMBERED", numbered)
    rng = random.Random(part)
    rows = [("".join(rng.choice(["a", "b", "c", "dddd"]) + rng.choice([" ", " ", "\t", ". "]) for _ in range(200)),
             rng.choice(["en", "de"])) for _ in range(6)] + [("", "en"), ("x" * 100, "de")]
    f = counts(rows)
    batches = [pa.RecordBatch.from_pydict({"text": [t for t, _ in rows[i:i + 2]], "lang": [x for _, x in rows[i:i + 2]]})
               for i in range(0, len(rows), 2)]

    def summed(found):
        total = Counter()
        for b in found:
            for lang, p, n in zip(*[c.to_pylist() for c in b.columns]):
                total[lang, p] += n
        return +total

    short = summed(C.words_and_pairs(iter(batches)))
    assert short == Counter({(x, " ".join(p)): n for x in f for p, n in f[x].items() if len(p) < 3} | {
        (x, ""): sum(n for p, n in f[x].items() if len(p) == 1) for x in f})
    for k in (2, 3):
        trie = C.DoubleArrayTrie([(x, " ".join(p)) for x in f for p in f[x] if len(p) == k])
        assert summed(C.stepped(iter(batches), [trie], 1)) == {
            (x, " ".join(p)): n for x in f for p, n in f[x].items() if k <= len(p) <= k + 1}


def test_double_array():
    rng = random.Random(9)
    phrases = {(rng.choice(["x", "y"]), " ".join(rng.choice("abcdefghijkl") * rng.randrange(1, 3)
                                                 for _ in range(rng.randrange(1, 5)))) for _ in range(3000)}
    trie = C.DoubleArrayTrie(list(phrases))
    assert (trie.check >= 0).sum() > 0.5 * len(trie.check)  # dense
    found = set()
    stack = [(trie.langs[x], x, []) for x in trie.langs]
    letters = {c: w for w, c in trie.codes.items() if isinstance(w, bytes)}
    import numpy as np
    while stack:
        s, lang, words = stack.pop()
        if trie.accept[s] >= 0:
            assert (trie.names[trie.lang_of[trie.accept[s]]], trie.phrases()[trie.accept[s]].as_py()) == (
                lang, " ".join(words).encode())
            found.add((lang, " ".join(words)))
        codes = np.array(sorted(letters))
        for c, t in zip(codes, trie.advance(np.full(len(codes), s), codes)):
            if t:
                stack.append((int(t), lang, [*words, letters[c].decode()]))
    assert found == phrases
