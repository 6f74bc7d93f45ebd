"""A corpus pipeline out of the operators of ``scorecard.llm``.

``STAGES`` run in order; each works on the Parquet table that the one before
wrote.  Columns other than those of ``documents`` pass through unharmed.

1. toxicity: documents that score 0.7 or more go;
2. exact dedup: of equal texts the one with the largest id stays;
3. SimHash near-dedup: of each group the one with the smallest id stays;
4. mixing: documents are replicated to the target weights of their sources and
   globally shuffled, so an id may occur several times from here on;
5. byte-level BPE: the token ids of every copy, decoded again, as digests.

Null and empty texts, empty tables, ties and repeated rows have the results
that the operators define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scorecard.llm import bpe, exact_dedup, mixing, simhash, toxicity
from scorecard.llm.common import documents, stored
from scorecard.llm.queries import RANKS, bpe_digests, labels


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1; the model is fitted to labelled rows of ``docs`` themselves."""
    return toxicity.drop_toxic(docs, toxicity.fit_model(docs, labels(spark, sf_dir)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5."""
    return bpe_digests(bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: Toxicity, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; all but the last are written and reread."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
