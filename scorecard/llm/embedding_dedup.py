"""Near-duplicate embeddings by Euclidean p-stable hashing (operator 3).

Vectors are normalised in double precision, so a cosine is a distance.  Each
of ``tables`` hash tables cuts ``projections`` Gaussian projections, shifted at
random, into steps of ``width``; equal step numbers (as a 64-bit hash) and
equal labels put two vectors into one bucket.  A pair at cosine 0.93 (distance
0.374) shares a step with probability 0.864 and a bucket of one table with
probability 0.864^12 = 0.17, so 24 tables find 0.989 of such pairs, and of those
at 0.96 or more over 0.999.

Pairs that share a bucket are checked by their exact cosine.  Equal vectors of
one label are first reduced to one, with their number.  Buckets are compared
in blocks of bounded size (:mod:`blocks`): a block returns the number of links of
each vector and a spanning forest of the links, never all pairs.  A pair that
meets in several tables counts in the first only.

Defined results: a null label, a null, empty or zero vector, or one with a
null or non-finite component links with nothing, nor does a null id; it is
its own component.  Vectors of different lengths never link.  Rows equal in
id, label and vector are one vector, and each of them is returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, block_of, forest, in_units, starts, units
from .common import prepare, split_hot, stored
from .components import connected_components

THRESHOLD = 0.93
TABLES = 24
PROJECTIONS = 12
WIDTH = 2.2
SEED = 42


@lru_cache(maxsize=8)
def _projections(dim: int, tables: int, projections: int, width: float, seed: int):
    rng = np.random.default_rng([seed, dim])
    return (rng.standard_normal((dim, tables * projections)),
            rng.uniform(0, width, tables * projections),
            rng.integers(1, 1 << 63, projections, dtype=np.uint64) | np.uint64(1))


def hash_keys(vectors: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """Bucket hashes (rows x tables) of normalised vectors (rows x dim)."""
    lines, shift, mix = _projections(vectors.shape[1], tables, projections, width, seed)
    steps = np.floor((vectors @ lines + shift) / width).astype(np.int64).view(np.uint64)
    steps = steps.reshape(len(vectors), tables, projections)
    keys = np.zeros((len(vectors), tables), np.uint64)
    for i in range(projections):
        keys = (keys ^ steps[:, :, i]) * mix[i]
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def _hashed(tables: int, projections: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, node = batch.column("vector"), batch.column("node").to_numpy(zero_copy_only=False)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                x = _matrix(vectors.take(pa.array(at)), np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                keys = hash_keys(x / np.linalg.norm(x, axis=1, keepdims=True), tables, projections, width, seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[at]), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "keys"])

    return run


def _compare(threshold: float):
    unit = ["label", "dim", "table", "key", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in units(batches, unit):
            begin = starts(table, unit)
            node, size, side, at = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
                                    for c in ("node", "n", "side", "table"))
            same = (table.column("left").combine_chunks().to_numpy(zero_copy_only=False)
                    == table.column("right").combine_chunks().to_numpy(zero_copy_only=False))
            us, vs, ws = [], [], []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), table.num_rows]):
                part = table.slice(a, b - a)
                x = _matrix(part.column("vector"), np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                one = np.flatnonzero(side[a:b] == 0)
                two = one if same[a] else np.flatnonzero(side[a:b] == 1)
                i, j = np.nonzero(x[one] @ x[two].T >= threshold)
                i, j = one[i], two[j]
                if same[a]:
                    i, j = i[i < j], j[i < j]
                if len(i) and at[a]:
                    # pairs that have met in an earlier table count there
                    keys = _matrix(part.column("keys"), np.int64)[:, :at[a]]
                    new = np.concatenate([~(keys[i[s:s + 65536]] == keys[j[s:s + 65536]]).any(axis=1)
                                          for s in range(0, len(i), 65536)])
                    i, j = i[new], j[new]
                if not len(i):
                    continue
                ids, n = node[a:b], size[a:b]
                links = np.bincount(i, n[j], b - a) + np.bincount(j, n[i], b - a)
                linked = np.flatnonzero(links)
                u, v = forest(ids[i], ids[j])
                us += [ids[linked], u]
                vs += [ids[linked], v]
                ws += [links[linked].astype(np.int64), np.zeros(len(u), np.int64)]
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, ws)],
                                                 ["u", "v", "links"])

    return run


def linkable(column: str = "embedding") -> F.Column:
    """Whether a vector has a cosine with others."""
    x = F.col(column)
    return F.coalesce((F.size(x) > 0)
                      & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
                      & F.exists(x, lambda e: e != 0), F.lit(False))


#: Ways to name a vector by 64 bits, tried in this order until no two vectors share a name.
IDENTIFIERS = tuple(lambda *cols, salt=salt: F.xxhash64(F.lit(salt), *cols) for salt in range(8))


def identified(nodes: DataFrame, identifiers=IDENTIFIERS) -> DataFrame:
    """``nodes`` (distinct ``label, vector``) with a verified ``node`` number."""
    for identifier in identifiers:
        named = nodes.withColumn("node", identifier("label", "vector"))
        if named.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
            return named
    raise ValueError("two vectors share every identifier")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES,
                    projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED,
                    block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id, embedding, label``; other
    columns are ignored): ``vec_id, n_links, component_id, kept``.

    An empty table gives no rows.  Runs jobs when called.
    """
    prepare(vectors.sparkSession)
    rows = stored(vectors.select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"),
        (linkable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).alias("ok")), "vectors")
    good = rows.where("ok")
    # one node for equal vectors of a label; -0.0 is 0.0
    key = [F.col("label"), F.transform("vector", lambda e: e + F.lit(0.0)).alias("vector")]
    members = good.select("vec_id", *key)
    nodes = identified(stored(members.distinct().groupBy("label", "vector").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n")), "vector-nodes"))
    hashed = nodes.select("node", "vector").mapInArrow(
        _hashed(tables, projections, width, seed), "node bigint, keys array<bigint>")
    hashed = stored(nodes.select("node", "label", F.size("vector").alias("dim"), "n", "vector")
                    .join(hashed, "node"), "vector-keys")
    slots = hashed.select("label", "dim", "node", F.posexplode("keys").alias("table", "key"))
    buckets = (slots.groupBy("label", "dim", "table", "key").agg(F.count(F.lit(1)).alias("members"))
               .where("members > 1")
               .withColumn("n_blocks", F.ceil(F.col("members") / block).cast("int")).drop("members"))
    places = (slots.join(buckets, ["label", "dim", "table", "key"])
              .withColumn("own", block_of(F.col("node"), F.col("n_blocks")))
              .withColumn("other", F.explode(F.expr("sequence(0, n_blocks - 1)")))
              .select("node", "table", "key", F.least("own", "other").alias("left"),
                      F.greatest("own", "other").alias("right"),
                      (F.col("own") > F.col("other")).cast("int").alias("side")))
    work = places.join(hashed, "node").select(
        F.xxhash64("label").alias("label"), "dim", "table", "key", "left", "right", "side",
        "node", "n", "vector", "keys")
    unit = ["label", "dim", "table", "key", "left", "right"]
    found = stored(in_units(work, unit, ["side"]).mapInArrow(
        _compare(threshold), "u bigint, v bigint, links bigint"), "vector-links")
    counts = found.where("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("u <> v").select("u", "v"))
    placed = (nodes.join(counts, "node", "left").join(comps, "node", "left")
              .select("label", "vector", "least", "n", "node",
                      (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                      F.coalesce("component", "node").alias("component")))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    placed = stored(split_hot(placed, smallest, ["component"], "members", nodes.count())
                    .select("label", "vector", "n", "n_links", "component_id"), "vector-components")
    linked = split_hot(members, placed, ["label", "vector"], "n", members.count()).select(
        "vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                        F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
