"""Small tables and brute-force versions of the operators' contracts."""

import hashlib
import os
import random
import zlib

import duckdb

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names clash with columns the operators make.
CLASHES = "row string, fp bigint, recipe string, keep_id bigint, kept boolean, doc string, copy int, score double, " \
          "component_id bigint, block bigint, ids string, rate double, n bigint, hot boolean"

VOCAB = ["the", "of", "and", "Haus", "grün", "été", "niño", "data", "lake", "spark", "token", "x1", "42", "don't",
         "we'll", "ﬁn", "Å", "日本", "🙂", "idiot", "foo,", "bar.", "***", "\t", "a\nb", "  "]


def read(sf_dir, table):
    path = f"{sf_dir}/{table}.parquet"
    return duckdb.sql(f"select * from read_parquet('{path if os.path.isfile(path) else path + '/*'}')").fetchall()


def texts(sf_dir):
    return {r[0]: r[1] or "" for r in read(sf_dir, "documents")}


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def tricky_texts():
    """Null, empty, blank, very long, and long without spaces."""
    rng = random.Random(7)
    return [None, "", " ", "\n\n", "a", " a", "a ", " x y", sentence(rng, 3), sentence(rng, 300),
            sentence(rng, 30000), "ab1" * 60000, "x" * 5000, "<|endoftext|> <s> </s> <unk>", "Á é",
            "one two three four five six", "one two three four five six", "ONE two three FOUR five six"]


def tricky_docs(spark, extra=False):
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(tricky_texts())]
    rows += [(None, "no id", None, None, None), (None, None, None, None, None), rows[9], rows[9],
             (3, "another text of id three", "de", "src0", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for c in CLASHES.split(", "):
            name, kind = c.split(" ")
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def held_out(doc_id, mod, at):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod == at


def components(nodes, links):
    """Smallest node that links reach, by union-find."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
