"""The registered queries of this package; each takes (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, collocations, embedding_dedup, exact_dedup, lattice_lm, mixing, prefix_trie, quality, simhash,
               token_counts, token_orc, toxicity, url_filter)
from .common import documents

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Verdict, host and path of the url rules.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def bpe_digests(encoded: DataFrame) -> DataFrame:
    """Digest columns of :func:`bpe.encode_documents`."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          bpe.ids_sha256(F.col("ids")).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(bpe.encode_documents(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` is the model that learns; the lattice by the vocabulary's own scores is ``lattice_score``."""
    return (lattice_lm.score_documents(documents(spark, sf_dir), PIECES)
            .withColumnRenamed("score", "lattice_score").withColumn("score", F.col("mixture_score")))


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_file_index(documents(spark, sf_dir), WORDS)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.in_shuffled_order(mixing.replicate(documents(spark, sf_dir)))
    return mixed.select("doc.doc_id", "doc.source", "doc.text", F.round("rate", 6).alias("rate"),
                        "n_copies", "copy", "shuffle_key")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score_documents(docs, quality.fit_model(docs, labels(spark, sf_dir)))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_documents(documents(spark, sf_dir), PIECES)
    n_tokens = token_counts.total(F.col("prefixes"))
    return counted.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"),
                          (n_tokens > token_counts.LIMIT).alias("over_limit"),
                          token_counts.fitting_chars(F.col("prefixes"), token_counts.LIMIT).alias("fitting_chars"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.fit_model(docs, labels(spark, sf_dir)))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = url_filter.rule_table(spark, URL_RULES)
    weights = url_filter.fit_model(url_filter.labelled_by_rules(pages, rules))
    return url_filter.judge(pages, rules, weights)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie.nodes(prefix_trie.rebuilt_paths(conversations))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_byte_bpe, op2_exact_dedup, op3_embedding_dedup, op4_simhash, op5_lattice_lm, op6_token_orc, op7_mixing,
    op8_quality, op9_token_counts, op10_toxicity, op11_url_filter, op12_prefix_trie,
    op13_collocations, pipeline)}
