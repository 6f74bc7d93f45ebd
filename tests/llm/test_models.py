"""Language model, mixing, quality, toxicity and the pipeline."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import SF01, empty_docs, held_out, read, texts, tricky_docs

import corpus_pipeline
from scorecard.llm import lattice, lattice_lm, mixing, oracle_sql, quality, queries, toxicity


def by_hand(vocab, word, logp):
    """Sum over all cuts of a word, one character at a time."""
    names = {int(i): None for i in vocab.ids}
    table = {int(h): int(i) for h, i in zip(vocab.keys, vocab.ids)}
    text = "▁" + word
    sums = [1.0] + [0.0] * len(text)
    for i in range(len(text)):
        single = table.get(int(lattice._hash(text[i])))
        if single is None:
            cost = math.exp(sum(logp[vocab.byte_ids[b]] for b in text[i].encode()))
            sums[i + 1] += sums[i] * cost
        for j in range(i + 1, min(i + vocab.longest, len(text)) + 1):
            piece = table.get(int(lattice._hash(text[i:j])))
            if piece is not None:
                sums[j] += sums[i] * math.exp(logp[piece])
    assert names
    return sums[-1]


def test_lattice_sums_all_cuts():
    vocab = lattice.vocabulary(open(queries.PIECES, "rb").read())
    words = ["the", "a", "thation", "grün", "🙂x", "日本語", "x" * 30, "don't"]
    got = np.exp(lattice.log_probabilities(vocab, words, vocab.start))
    assert np.allclose(got, [by_hand(vocab, w, vocab.start) for w in words], rtol=1e-9)
    uses = lattice.expected_counts(vocab, words, np.ones(len(words)), vocab.start)
    assert (uses >= 0).all() and uses.sum() >= len(words)


def test_lattice_of_several_models_is_built_once(monkeypatch):
    vocab = lattice.vocabulary(open(queries.PIECES, "rb").read())
    words = ["the", "a", "thation", "grün", "🙂x", "日本語", "the", "don't"]
    other = np.where(vocab.usable, -math.log(vocab.usable.sum()), -np.inf)
    built, init = [], lattice.Lattice.__init__
    monkeypatch.setattr(lattice.Lattice, "__init__", lambda self, v, w: (built.extend(w), init(self, v, w))[1])
    first, second = lattice.log_probabilities(vocab, words, vocab.start, other)
    assert sorted(built) == sorted("▁" + w for w in words)
    for got, logp in ((first, vocab.start), (second, other)):
        assert np.allclose(np.exp(got), [by_hand(vocab, w, logp) for w in words], rtol=1e-9)


def test_lattice_of_very_long_words(monkeypatch):
    vocab = lattice.vocabulary(open(queries.PIECES, "rb").read())
    words = ["日本語" * 60, "the", "𐀀" * 180, "x" * 180, "ab" * 90, "grün"]
    want = lattice.log_probabilities(vocab, words, vocab.start)
    counts = np.array([1.0, 2, 3, 1, 1, 1])
    uses = lattice.expected_counts(vocab, words, counts, vocab.start)
    # these underflow; in log space all give the same
    assert np.isfinite(want).all() and want.min() < -1000 and np.isfinite(uses).all()
    assert abs(uses[vocab.byte_ids].sum() - 3 * 180 * 4) < 1e-6 * 3 * 180 * 4
    monkeypatch.setattr(lattice, "LEAST", 2.0)
    assert np.allclose(lattice.log_probabilities(vocab, words, vocab.start), want, rtol=1e-12)
    assert np.allclose(lattice.expected_counts(vocab, words, counts, vocab.start), uses, rtol=1e-9)


def test_op5_base_and_counts(spark):
    docs = {i: t.encode().lower().split() for i, t in texts(SF01).items()}
    train = Counter()
    for i, words in docs.items():
        if not held_out(i, 10, 0):
            train.update(words)
            train["end"] += 1
    total, distinct = sum(train.values()), len(train)
    rows = queries.op5_lattice_lm(spark, SF01).collect()
    assert len(rows) == len(docs)
    for r in rows:
        tokens = [*docs[r.doc_id], "end"]
        base = sum(math.log10((train[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held_out(r.doc_id, 10, 0), len(tokens), total)
        assert r.n_known == sum(train[w] > 0 for w in tokens)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0 and math.isfinite(r.score)


def test_lm_tricky_rows(spark):
    docs = tricky_docs(spark, extra=True)
    rows = lattice_lm.score_documents(docs, queries.PIECES, steps=1, block_docs=4).collect()
    assert len(rows) == docs.count() and all(math.isfinite(r.score) for r in rows)
    assert lattice_lm.score_documents(empty_docs(spark), queries.PIECES).count() == 0


def test_score_is_the_sum_over_all_cuts(spark):
    """The marginal of each text by a plain sum over segmentations, under the vocabulary's scores."""
    from scorecard.llm.lattice import vocabulary

    texts = ["the cat sat", "", "Zyx q the", "é \t日本 the the"]
    docs = spark.createDataFrame([(7 * i + 10**12 * i, t) for i, t in enumerate(texts)] * 2, "doc_id bigint, text string")
    rows = lattice_lm.score_documents(docs, queries.PIECES, block_docs=2).collect()
    assert len(rows) == 8
    vocab = vocabulary(open(queries.PIECES, "rb").read())

    def marginal(word):
        from scorecard.llm.lattice import log_probabilities
        return log_probabilities(vocab, [word], vocab.start)[0]
    for r in rows:
        text = texts[[7 * i + 10**12 * i for i in range(4)].index(r.doc_id)]
        want = sum(marginal(w.decode()) for w in lattice_lm.words_of(text.encode())) - math.log(vocab.size + 1)
        assert abs(r.score - want / math.log(10)) < 1e-9 and math.isfinite(r.mixture_score)


def test_op5_score_learns(spark):
    """On held-out rows the score is near the base score, which knows the training words too."""
    rows = [r for r in queries.op5_lattice_lm(spark, SF01).collect() if r.held_out]
    base, score, spelt = (sum(r[c] for r in rows) for c in ("base_score", "score", "lattice_score"))
    assert rows and all(math.isfinite(r.score) for r in rows)
    assert score > 1.25 * base and spelt < 1.5 * base


def test_poisson_draws():
    con = duckdb.connect()
    con.sql("create table documents as select i as doc_id, 'abcd' as text, if(i % 3 = 0, 'x', 'y') as source "
            "from range(6000) t(i)")
    rows = con.sql(oracle_sql.MIXING).fetchall()
    share = Counter(r[1] for r in rows)
    assert abs(share["x"] / len(rows) - math.sqrt(1 / 3) / (math.sqrt(1 / 3) + math.sqrt(2 / 3))) < 0.03


def test_mixing_tricky_rows(spark):
    docs = tricky_docs(spark, extra=True)
    got = mixing.mix(docs)
    assert got.columns == docs.columns and got.count() > 0
    assert mixing.mix(empty_docs(spark)).count() == 0
    one = docs.where("doc_id = 4")
    many = mixing.replicate(one, weights={"src1": 1.0}, target_chars=2000.0)
    assert abs(many.first().rate - 2000) < 1e-6 and abs(many.count() - 2000) < 250
    assert mixing.replicate(docs, weights={"nowhere": 1.0}).count() == 0
    assert "Python" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("name, column, least", [("op8_quality", 1, 0.97), ("op10_toxicity", 2, 0.9)])
def test_classifiers_on_held_out_rows(spark, name, column, least):
    truth = {r[0]: r[column] for r in read(SF01, "labels")}
    rows = queries.QUERIES[name](spark, SF01).collect()
    assert len(rows) == len(texts(SF01)) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == held_out(r.doc_id, 3, 1) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in test) >= least * len(test)


def test_classifiers_tricky_rows(spark):
    docs = tricky_docs(spark, extra=True)
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(17)], "doc_id bigint, quality int, toxic int")
    for part in (quality, toxicity):
        for labels in (none, some, none.limit(0)):
            model = part.fit_model(docs, labels)
            rows = part.score_documents(docs, model).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.drop_toxic(docs, None).columns == docs.columns
    assert toxicity.drop_toxic(empty_docs(spark), None).count() == 0


def test_toxicity_trains_on_whole_ordinary_texts(monkeypatch):
    seen = {}
    trained = toxicity._trained

    def spy(size, samples):
        seen.setdefault(len(seen), samples)
        return trained(size, samples)

    monkeypatch.setattr(toxicity, "_trained", spy)
    ordinary = [" ".join(f"w{d}x{i}" for i in range(700)) for d in range(300)]
    toxic = [f"{t} slurword slurword" for t in ordinary[:40]]
    assert toxicity.train([(t, 0) for t in ordinary] + [(t, 1) for t in toxic])
    assert {w for s in seen[0] for w in s.decode().split()} == {w for t in ordinary for w in t.split()}


def test_copies_of_a_sample_are_found_in_little_memory():
    """20,000 rows of 400 words are compared in one task."""
    import tracemalloc

    words = [f"w{i}" for i in range(1000)]
    rng = np.random.default_rng(5)
    texts = [[words[i] for i in rng.integers(0, 1000, 400)] for _ in range(300)]
    near = [*texts[0][:-4], "other", "ending", "of", "it"]
    far = [*texts[1][:200], *texts[2][:200]]
    tracemalloc.start()
    kept = toxicity.without_copies([*texts, near, far, texts[3], [], []])
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept == [*texts, far, []] and held < 300 * 10_000


def test_samples_of_a_small_dictionary_are_joined():
    few = [b" a ", b" b ", b" b "]
    assert toxicity._trained(6, few) == b" a  b " and toxicity._trained(0, []) == b""
    assert 0 < len(toxicity._trained(256, [bytes([i % 250 + 1]) * 40 for i in range(2000)])) <= 256


def test_pipeline_rows(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF01)
    assert clean.columns == docs.columns
    left = {r.doc_id: r.text for r in clean.select("doc_id", "text").collect()}
    kept = {}
    for i, t in left.items():
        kept[t] = max(i, kept.get(t, i))
    unique = corpus_pipeline.drop_copies(spark, clean, SF01)
    assert {r.doc_id for r in unique.select("doc_id").collect()} == set(kept.values())
    from test_duplicates import simhash_by_hand
    rows = [(i, t) for t, i in kept.items()]
    want = {c for _, _, c in simhash_by_hand(rows)}
    near = corpus_pipeline.drop_near_copies(spark, unique, SF01)
    assert {str(r.doc_id) for r in near.select("doc_id").collect()} == want
    mixed = corpus_pipeline.mix_sources(spark, near, SF01)
    out = corpus_pipeline.encode(spark, mixed, SF01)
    assert out.count() == mixed.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
