"""Response cache (EV14): an expensive scorer runs once per distinct prompt.

The cache is a table ``cache_key, top_logprobs, error`` in the shared
store.  The key is content-addressed: SHA-256 over the rater, the prompt
template version, the question with its place in the rubric, examples and
polarity, the temperature and the SHA-256 of the text.  Hashing the text once per text (before the
grid expansion) keeps the per-row key cheap even for long texts.

* :func:`table` keeps the cache bucketed and sorted by key;
* work list = grid ``left_anti`` cache (only these rows go to the scorer);
* lookup = grid ``left`` join cache;
* append = ``unionByName`` / append-mode write of the new responses.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rubric columns that a prompt or its answer depends on.
RUBRIC_PARTS = ["concept", "dimension", "question_label", "question", "examples", "positive_contribution"]


def text_hash(text="input_text") -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.sha2(t, 256)


def cache_key(prompt_version: str, temperature: Column | None = None) -> Column:
    """Key of one grid row (needs model, the rubric columns and text_hash).

    Every part is written as ``length:value``, a NULL as ``-``, so neither
    NULLs nor separators inside a part make two prompts share a key.
    """
    temp = temperature if temperature is not None else F.lit(None)
    parts = [F.col("model"), F.lit(prompt_version), *[F.col(c) for c in RUBRIC_PARTS], temp, F.col("text_hash")]
    return F.sha2(F.concat(*[_part(p.cast("string")) for p in parts]), 256)


def _part(value: Column) -> Column:
    return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def with_cache_key(grid: DataFrame, prompt_version: str) -> DataFrame:
    temp = F.col("temperature") if "temperature" in grid.columns else None
    return grid.withColumn("cache_key", cache_key(prompt_version, temp))


def unique(cache: DataFrame) -> DataFrame:
    """One row per key.  Equal keys mean equal prompts (e.g. exact copies of
    a text), so the responses are interchangeable; ``min`` picks a whole row
    deterministically (one without error, if there is one), as a
    partial/final aggregation."""
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "top_logprobs", "error"))
    return cache.groupBy("cache_key").agg(best.alias("r")).select("cache_key", "r.top_logprobs", "r.error")


def work_keys(todo: DataFrame) -> DataFrame:
    """Distinct prompts of a work list: each is scored once."""
    return todo.dropDuplicates(["cache_key"])


def missing(grid: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows still to be scored (anti-join on the key)."""
    return grid.join(cache.select("cache_key"), "cache_key", "left_anti")


def lookup(grid: DataFrame, cache: DataFrame) -> DataFrame:
    """Grid rows with their cached response (NULL when not cached) and a
    ``cached`` flag."""
    c = unique(cache).select("cache_key", F.col("top_logprobs").alias("cached_top_logprobs"),
                     F.col("error").alias("cached_error"), F.lit(True).alias("_hit"))
    return (grid.join(c, "cache_key", "left")
            .withColumn("cached", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit"))


def append(cache: DataFrame, responses: DataFrame) -> DataFrame:
    """New cache contents: the old rows plus responses for new keys."""
    new = missing(unique(succeeded(responses)), cache)
    return cache.unionByName(new)


def succeeded(responses: DataFrame) -> DataFrame:
    """Responses to keep: a failed call is tried again on the next run."""
    return responses.where(F.col("error").isNull()).select("cache_key", "top_logprobs", "error")


def write(responses: DataFrame, path: str, mode: str = "append") -> str:
    unique(succeeded(responses)).write.mode(mode).parquet(path)
    return path


#: Buckets of a new cache table.
BUCKETS = 200


def table(spark: SparkSession, path: str, buckets: int | None = None) -> str:
    """The name of the cache table at ``path``, made if there is none yet:
    bucketed and sorted by key, so that a lookup shuffles the keys it looks
    for but never the cache.  A path keeps the number of buckets it was made with, which
    every session has to name alike (``BUCKETS`` by default)."""
    name = "response_cache_" + hashlib.sha256(path.encode()).hexdigest()[:16]
    n = buckets or BUCKETS
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (cache_key STRING, "
              "top_logprobs ARRAY<STRUCT<token: STRING, logprob: DOUBLE>>, error STRING) "
              f"USING parquet CLUSTERED BY (cache_key) SORTED BY (cache_key) INTO {n} BUCKETS "
              f"LOCATION '{path}'")
    return name


def add(responses: DataFrame, name: str) -> None:
    """Append responses for new keys to the cache table ``name``."""
    spark = responses.sparkSession
    unique(succeeded(responses)).write.insertInto(name)
    spark.catalog.refreshTable(name)


def wanted_texts(texts: DataFrame, todo: DataFrame) -> DataFrame:
    """``label, input_text, text_hash, wanted``: one text for each hash that
    misses responses, and the configuration rows it misses.  The work list is
    narrow; a text moves only if it is wanted."""
    asked = todo.groupBy("text_hash").agg(F.min("label").alias("_label"), F.collect_set("config_id").alias("wanted"))
    own = texts.select("label", "input_text", text_hash().alias("_hash"))
    return (own.join(asked, (own["label"] == asked["_label"]) & (own["_hash"] == asked["text_hash"]))
            .select("label", "input_text", "text_hash", "wanted").dropDuplicates(["text_hash"]))
