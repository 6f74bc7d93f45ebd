"""Exact, SimHash and embedding duplicates, and components."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF01, SCHEMA, components, empty_docs, sentence, sha, texts, tricky_docs
from pyspark.sql import functions as F

from scorecard.llm import common, embedding_dedup, exact_dedup, queries, simhash
from scorecard.llm.components import connected_components

SMALL = {"least": 4, "most": 9, "cut": r"\s[a-m]"}


def exact_by_hand(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        out.append((str(i), str(keep), len(same), i == keep, sha((t or "").encode())))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_exact_dedup_by_hand(spark, sizes):
    docs = tricky_docs(spark, extra=True)
    got = exact_dedup.duplicate_groups(docs, **sizes).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == \
        exact_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert exact_dedup.duplicate_groups(empty_docs(spark)).count() == 0


def test_drop_copies_keeps_whole_rows(spark):
    docs = tricky_docs(spark, extra=True)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    rows = docs.select("doc_id", "text").collect()
    kept = {(r.text or ""): max((s.doc_id for s in rows if (s.text or "") == (r.text or "") and s.doc_id is not None),
                                default=None) for r in rows}
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted((str(v), k) for k, v in kept.items())
    assert exact_dedup.drop_copies(empty_docs(spark)).count() == 0


def test_chunks_join_to_the_text(spark):
    docs = tricky_docs(spark)
    for sizes in ({}, SMALL):
        text = common.text_or_empty()
        bad = docs.where(F.array_join(exact_dedup.chunks(text, **sizes), "") != text)
        assert bad.isEmpty()


def test_colliding_identifiers_are_not_used(spark):
    rows = [(1, "abc def"), (2, "xyz uvw"), (3, "abc def")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    weak = (lambda c: F.length(c).cast("long"), exact_dedup.IDENTIFIERS[1])
    got = exact_dedup.duplicate_groups(docs, identifiers=weak).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == \
        exact_by_hand(rows)
    with pytest.raises(ValueError):
        exact_dedup.duplicate_groups(docs, identifiers=weak[:1])


def test_exact_dedup_runs_no_python(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    for df in (exact_dedup.duplicate_groups(docs), exact_dedup.drop_copies(docs)):
        assert "Python" not in df._jdf.queryExecution().toString()


# --- SimHash -----------------------------------------------------------------

def fingerprint_by_hand(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ")
             .replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_by_hand(rows):
    fps = [(i, fingerprint_by_hand(t or "")) for i, t in rows]
    distinct = sorted({f for _, f in fps})
    a = np.array(distinct, np.uint64)
    links = [(distinct[i], distinct[j]) for i in range(len(a))
             for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= 4) if j > i]
    comp = components(distinct, links)
    least = {}
    for i, f in fps:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    return sorted((str(i), f"{f:016x}", str(least.get(comp[f]))) for i, f in fps)


def test_op4_by_hand(spark):
    got = queries.op4_simhash(spark, SF01).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == \
        simhash_by_hand(list(texts(SF01).items()))


def test_simhash_tricky_rows(spark):
    docs = tricky_docs(spark, extra=True)
    got = simhash.near_duplicates(docs).collect()
    want = simhash_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {str(r.doc_id) for r in kept.collect()} == {c for _, _, c in want}
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    assert simhash.drop_near_duplicates(empty_docs(spark)).count() == 0


def test_fingerprint_equals_sparks_hash(spark):
    t = "one two three four"
    h = spark.range(1).select(F.xxhash64(F.lit(t)).alias("h")).first().h
    assert simhash.fingerprint(t) == h % (1 << 64)


def test_golay_code_is_perfect():
    table = simhash.golay_table()
    assert (np.bincount(table) == 2048).all() and len(np.bincount(table)) == 4096


def test_golay_keys_miss_no_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 64, 60_000, dtype=np.uint64)
    other = base.copy()
    for k in range(60_000):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            other[k] ^= np.uint64(1) << np.uint64(b)
    keys = []
    for fps in (base, other):
        row, key = simhash.golay_keys(fps)
        keys.append(set(zip(row.tolist(), key.tolist())))
        assert len(keys[-1]) == len(row)
    assert {r for r, _ in keys[0] & keys[1]} == set(range(60_000))


@pytest.mark.parametrize("rows", [1, 2, 3, 100])
def test_keys_met_once_go(rows):
    keys = [1, 1, 2, 3, 3, 3, 3, 4, 5, 5]
    table = pa.table({"key": keys, "fp": list(range(10))})
    got = [r for b in simhash._met(iter(table.to_batches(max_chunksize=rows))) for r in b.to_pylist()]
    assert got == [{"key": k, "fp": i} for i, k in enumerate(keys) if keys.count(k) > 1]
    assert list(simhash._met(iter([]))) == []


@pytest.mark.parametrize("block", [1, 3, 512])
def test_linked_fingerprints_in_blocks(spark, block):
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 40)}
    seed = 0x0123456789ABCDEF
    for _ in range(120):
        x = seed
        for b in rng.choice(64, 3, replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(np.array([f % (1 << 64) for f in fps], np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    a = np.array(fps).view(np.uint64)
    links = [(fps[i], fps[j]) for i in range(len(a)) for j in range(i) if np.bitwise_count(a[i] ^ a[j]) <= 4]
    edges = [(r.u, r.v) for r in simhash.linked_fingerprints(df, block=block).collect()]
    assert components(fps, edges) == components(fps, links)
    assert {frozenset(e) for e in edges} and len(edges) < len(links) * 60


# --- embeddings --------------------------------------------------------------

def vectors_by_hand(rows, threshold=0.93):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1]
          and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, n = set(), {}
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and a[0] != b[0]:
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.add((a[0], b[0]))
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    comp = components({r[0] for r in ok}, links)
    return sorted((str(r[0]), n.get(r[0], 0), str(comp.get(r[0], r[0]))) for r in rows)


def vectors(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for group in range(12):
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((k, (centre + 0.08 * rng.standard_normal(16)).tolist(), group % 2))
            k += 1
    same = rng.standard_normal(16).tolist()
    rows += [(k + i, same, 0) for i in range(30)] + [(k + 30, same, 1), (k + 31, same, None)]
    k += 32
    rows += [(k, None, 0), (k + 1, [], 0), (k + 2, [0.0] * 16, 0), (k + 3, [float("nan")] * 16, 0),
             (k + 4, [None] * 16, 0), (k + 5, [float("inf")] + [1.0] * 15, 0), (None, same, 0), rows[0],
             (k + 6, [1.0, 2.0], 0), (k + 7, [2.0, 4.0], 0), (k + 8, [-0.0, 1.0], 0), (k + 9, [0.0, 1.0], 0)]
    return rows


@pytest.mark.parametrize("block", [2, 512])
def test_embeddings_by_hand(spark, block):
    rows = vectors(spark)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    df = df.selectExpr("*", "1 as node", "2 as n", "'x' as vector", "3 as component_id")
    got = embedding_dedup.near_duplicates(df, block=block).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == vectors_by_hand(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_hash_recall_near_the_threshold():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = 0.93
    z = cos * x + np.sqrt(1 - cos * cos) * y
    args = (embedding_dedup.TABLES, embedding_dedup.PROJECTIONS, embedding_dedup.WIDTH, embedding_dedup.SEED)
    met = (embedding_dedup.hash_keys(x, *args) == embedding_dedup.hash_keys(z, *args)).any(axis=1)
    assert met.mean() > 0.97


# --- components and joins ------------------------------------------------------

def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)]                     # a long path
    edges += [(1000, 1000 + i) for i in range(1, 500)]              # a star
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges + [(5, None), (None, None)], "u bigint, v bigint")
    got = {r.node: r.component for r in connected_components(df).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(df.limit(0)).count() == 0


def test_split_hot_joins_all(spark):
    left = spark.range(1000).selectExpr("if(id < 900, 0, id) as k", "id as x")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("m"))
    got = common.split_hot(left, right, ["k"], "n", 1000, share=10)
    assert sorted(map(tuple, got.select("k", "x", "m").collect())) == \
        sorted((0 if i < 900 else i, i, 0 if i < 900 else i) for i in range(1000))


def test_near_copies_are_found(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(2, 6) + str(rng.randint(0, 99)) for _ in range(600))
            for _ in range(8)]
    rows = []
    for k, t in enumerate(base):
        words = t.split()
        for c in range(4):
            changed = list(words)
            if c:
                changed[rng.randrange(600)] = "changed"
            rows.append((10 * k + c, " ".join(changed), "en", "s", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    found = sum(got[i] == i - i % 10 for i in got)
    assert found >= 0.9 * len(got) and all(got[i] // 10 == i // 10 for i in got)
    assert sentence(rng, 3)


def test_one_row_of_each_near_duplicate_group(spark):
    base = [f"w{i}" for i in range(400)]
    near = [" ".join(base), " ".join([*base, "."]), " ".join([*base, "!"])]
    other = [" ".join(f"v{i}" for i in range(400)) + end for end in ("", " .", " !")]
    third = " ".join(f"u{i}" for i in range(400))
    rows = [(None, t) for t in near] + [(7, t) for t in other] + [(9, third), (9, third), (None, third), (11, "alone x y z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    groups = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert groups == {(None, None), (7, 7), (9, 9), (None, 9), (11, 11)}
    got = simhash.drop_near_duplicates(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["11", "7", "9", "None"]
    assert all(tuple(r) in rows for r in got)
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_vectors_with_one_hash_get_another_name(spark):
    from scorecard.llm import embedding_dedup as E

    nodes = spark.createDataFrame([(i % 3, [float(i), 1.0]) for i in range(50)], "label int, vector array<double>")
    clash = [lambda *cols: F.lit(7).cast("bigint"), lambda *cols: F.xxhash64(*cols)]
    assert E.identified(nodes, clash).select("node").distinct().count() == 50
    with pytest.raises(ValueError):
        E.identified(nodes, clash[:1])


def test_ties_with_map_columns_and_hot_components(spark):
    docs = spark.createDataFrame([(i // 2, "the same few words here", {"k": i}) for i in range(60)]
                                 + [(None, "x", None), (None, "x", {"a": 1}), (None, None, None)],
                                 "doc_id bigint, text string, tags map<string, int>").repartition(5)
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    again = simhash.drop_near_duplicates(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert (0, "the same few words here") in {(r.doc_id, r.text) for r in rows}
    assert sum(r.doc_id is not None for r in rows) == 1
