"""Byte-level BPE, token files and token counts against the libraries."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from helpers import SF01, empty_docs, read, sha, texts, tricky_docs, tricky_texts
from pyspark.sql import functions as F

from scorecard.llm import bpe, queries, token_counts, token_orc


@pytest.fixture(scope="module")
def ranks():
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.WORDS)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def test_op1_equals_library(spark, ranks):
    got = {r.doc_id: r for r in queries.op1_byte_bpe(spark, SF01).collect()}
    want = texts(SF01)
    assert got.keys() == want.keys()
    for i, t in want.items():
        ids = ranks.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()))
        assert got[i].decoded_sha256 == sha(t.encode())


def test_bpe_parts_are_safe(ranks):
    rng = random.Random(1)
    for t in [x for x in tricky_texts() if x]:
        for size in (1, 7, 50, 1000):
            assert "".join(bpe.parts(t, size)) == t
            if len(t) < 20000 or size >= 1000:
                assert bpe.encode_text(ranks, t, size) == ranks.encode_ordinary(t)
    alphabet = "ab1 \n\t'.,é日   s"
    for _ in range(300):
        t = "".join(rng.choice(alphabet) for _ in range(60))
        assert bpe.encode_text(ranks, t, 3) == ranks.encode_ordinary(t)


def test_bpe_tricky_rows_and_round_trip(spark, ranks):
    docs = tricky_docs(spark, extra=True)
    out = bpe.encode_documents(docs, queries.RANKS, P.PATTERN, part_chars=1000).collect()
    assert len(out) == docs.count()
    want = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in out) == want
    assert bpe.encode_documents(empty_docs(spark), queries.RANKS, P.PATTERN).count() == 0
    nothing = spark.createDataFrame([(None,), ([],), ([0],)], "ids array<int>")
    got = nothing.select(bpe.decoder(queries.RANKS, P.PATTERN)("ids").alias("b")).collect()
    assert [r.b if r.b is None else bytes(r.b) for r in got] == [None, b"", ranks.decode_bytes([0])]


def test_op6_equals_library(spark, words):
    got = sorted(queries.op6_token_orc(spark, SF01).collect())
    start = 0
    for (i, t), row in zip(sorted(texts(SF01).items()), got, strict=True):
        ids = words.encode(t, add_special_tokens=False).ids + [1]
        assert (row.doc_id, row.start, row.n_tokens) == (i, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_of_tricky_rows(spark, words, tmpdir_path):
    docs = tricky_docs(spark, extra=True)
    path = f"{tmpdir_path}/ids"
    token_orc.write_ids(docs, path, queries.WORDS)
    files = token_orc.read_ids(spark, path)
    want = sorted((str(r.doc_id), words.encode(r.text or "", add_special_tokens=False).ids + [1])
                  for r in docs.collect())
    assert sorted((str(r.doc_id), r.ids) for r in files.collect()) == want
    rows = sorted(token_orc.starts_of(files).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known) and rows[0].doc_id is None
    assert token_orc.token_file_index(empty_docs(spark), queries.WORDS).count() == 0


def test_token_files_prune_by_id(spark, tmpdir_path):
    path = f"{tmpdir_path}/ids"
    token_orc.write_ids(spark.read.parquet(f"{SF01}/documents.parquet"), path, queries.WORDS)
    one = token_orc.read_ids(spark, path).where("doc_id = 77")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in one._jdf.queryExecution().toString()
    assert one.count() == 1


def test_op9_equals_library(spark, pieces):
    got = {r.doc_id: r for r in queries.op9_token_counts(spark, SF01).collect()}
    for i, t in texts(SF01).items():
        n = len(pieces.encode(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 4096)


def test_token_counts_of_every_prefix(spark, pieces):
    own = token_counts.counter(open(queries.PIECES, "rb").read())
    assert own.additive
    rng = random.Random(3)
    samples = [t for t in tricky_texts() if t and len(t) < 400]
    samples += ["".join(rng.choice("ab the\n  \té日1.") for _ in range(80)) for _ in range(40)]
    for t in samples:
        table = own.table(t)
        for k in range(len(t) + 1):
            assert own.prefix(t, k, table) == len(pieces.encode(t[:k])), (t, k)


def test_a_mark_in_a_text_is_a_space(pieces):
    own = token_counts.counter(open(queries.PIECES, "rb").read())
    rng = random.Random(8)
    samples = ["▁ ", " ▁ ▁ ", "▁", "▁▁▁▁ the", "the▁the", "\n▁\n", "a▁\n ▁b"]
    samples += ["".join(rng.choice(["▁", "▁", " ", " ", "\n", "the", "a", "é", "日", "\t", "1."]) for _ in range(25))
                for _ in range(300)]
    for t in samples:
        table = own.table(t)
        assert [own.prefix(t, k, table) for k in range(len(t) + 1)] == [
            len(pieces.encode(t[:k])) for k in range(len(t) + 1)], t


def test_token_counts_tricky_rows(spark, pieces):
    docs = tricky_docs(spark, extra=True)
    table = F.col("prefixes")
    got = token_counts.count_documents(docs, queries.PIECES).select(
        "doc_id", token_counts.total(table).alias("n"), token_counts.fitting_chars(table, 50).alias("fit"),
        token_counts.prefix_tokens(table, 40).alias("p"), "prefixes").collect()
    plain = sorted((str(r.doc_id), len(pieces.encode(r.text or ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n) for r in got) == plain
    whole = {r.text or "" for r in docs.collect()}
    for r in got:
        assert any(len(pieces.encode(t[:r.fit])) <= 50 for t in whole)
    assert token_counts.count_documents(empty_docs(spark), queries.PIECES).count() == 0


def test_stored_table_answers_every_prefix(spark, pieces):
    rng = random.Random(4)
    samples = ["".join(rng.choice("日本語東京abcdeTHE1234=+/é🙂\t") for _ in range(300)), "ab1" * 100, "x" * 300,
               " " * 150 + "a" + " " * 90, base64.b64encode(rng.randbytes(240)).decode(), "internationalisation" * 12,
               "a the\n\n thing " + "thereinafter_" * 20 + " end ", "", " a"]
    own = token_counts.counter(open(queries.PIECES, "rb").read())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "doc_id bigint, text string")
    table = F.col("prefixes")
    ask = [5, 40, 100]
    got = token_counts.count_documents(docs, queries.PIECES).select(
        "doc_id", "prefixes", *[token_counts.fitting_chars(table, b).alias(f"f{b}") for b in ask],
        *[token_counts.prefix_tokens(table, k).alias(f"p{k}") for k in ask]).collect()
    assert len(got) == len(samples)
    for r in got:
        t = samples[r.doc_id]
        want = [len(pieces.encode(t[:k])) for k in range(len(t) + 1)]
        stored = np.array(r.prefixes.chars, int), np.array(r.prefixes.tokens, int)
        assert [own.prefix("", k, stored) for k in range(len(t) + 1)] == want
        for b in ask:
            assert r[f"f{b}"] == max(k for k, n in enumerate(want) if n <= b), (t, b)
            assert r[f"p{b}"] == want[min(b, len(t))], (t, b)


def test_token_counts_without_additive_segments(pieces):
    own = token_counts.Counter(open(queries.PIECES, "rb").read())
    own.additive, own.pieces = False, set()
    for t in ("the cat\n sat " * 8, "日本" * 50):
        assert [own.prefix(t, k, own.table(t)) for k in range(len(t) + 1)] == [
            len(pieces.encode(t[:k])) for k in range(len(t) + 1)]


def test_word_splits_of_the_tokenizer(words):
    rng = random.Random(5)
    encode = token_orc.WordEncoder(words)
    for _ in range(200):
        t = "".join(rng.choice(["ab", "Don't", " ", "\n", "\t", "é", "é", ".", "!?", "7", "İ", "ΣΑΣ",
                                "<|endoftext|>", " ", "ﬁ", "日"]) for _ in range(25))
        assert np.frombuffer(encode.encode([t])[0], np.int32).tolist() == words.encode(t, add_special_tokens=False).ids, t


def test_word_splits_with_little_memory(words, monkeypatch):
    for name, value in (("REMEMBERED", 8), ("PART_BYTES", 10), ("JOINED", 3)):
        monkeypatch.setattr(token_orc, name, value)
    rng = random.Random(6)
    encode = token_orc.WordEncoder(words)
    signs = ["ab", "don't", "LL'", "'S", "''", " ", "\n", "\0", "é", "É,", "H\u0331", "T\u0308.", "=\u0338", "×.", "(x", "-", "_",
             "|>", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "İ.", "ŉ!", "½", "日", "🙂", "abcdefghijklmno", "abcdefghijklmnop"]
    for _ in range(60):
        rows = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 9))]
        got = [np.frombuffer(ids, np.int32).tolist() for ids in encode.encode(rows)]
        assert got == [words.encode(t, add_special_tokens=False).ids for t in rows]
    dense = "".join(f"{a}{b}." for a in "abcdefghijklm" for b in "nopqrstuvwxyz")  # more units than slots, no space
    assert np.frombuffer(encode.encode([dense])[0], np.int32).tolist() == words.encode(dense, add_special_tokens=False).ids


def test_units_met_before_skip_the_library(words):
    class Counting:
        def __init__(self):
            self.units = 0

        def __getattr__(self, name):
            return getattr(words, name)

        def encode_batch_fast(self, texts, **options):
            self.units += sum(len(t.split(" ")) for t in texts)
            return words.encode_batch_fast(texts, **options)

    encode = token_orc.WordEncoder(counting := Counting())
    encode.model = counting
    encode.encode(["house cat"])
    got = encode.encode(["House, CAT! (cat) house-cat.", "house?"])
    assert counting.units == 2 + len({",", "!", "(", ")", "-", ".", "?"})
    assert [np.frombuffer(ids, np.int32).tolist() for ids in got] == [
        words.encode(t, add_special_tokens=False).ids for t in ("House, CAT! (cat) house-cat.", "house?")]


def test_documents_have_long_texts():
    assert max(len(r[1] or "") for r in read(SF01, "documents")) > 10000
