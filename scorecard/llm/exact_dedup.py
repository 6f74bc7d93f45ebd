"""Exact deduplication by recipes of content-defined chunks (operator 2).

1. Every text is cut into chunks.  Where a chunk ends depends only on the
   characters near the place (a white space before certain letters, after a
   minimum length), so equal passages of different documents are cut alike.
2. All chunks of the corpus are reduced to distinct contents; this is the
   only time that text moves, each distinct chunk once per task that reads
   it.  A chunk's identifier is verified: over all distinct contents,
   equal identifiers must mean equal contents.  Should two contents share a
   64-bit identifier, 256-bit ones are taken, and verified in turn.
3. A document's recipe is the ordered list of its chunks' identifiers.  Two
   texts are equal exactly if their recipes are, so from here on only lists
   of numbers are compared.

All of it is DataFrame expressions: no Python runs on the executors.

Defined results: null text counts as empty, and all empty texts are equal.
Of equal texts the row with the largest ``doc_id`` stays; a null id is
smaller than any other.  Rows with the same id and text are one document, so
each of them says ``kept`` if their id stays; :func:`drop_copies` returns a
single row of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_hot, stored, text_or_empty

#: Characters of the shortest and the longest chunk (but for a text's last).
MIN_CHUNK, MAX_CHUNK = 1024, 8192
#: What follows a chunk: white space and a letter of the first half.
CUT = r"\s[a-mA-M]"

#: Identifiers, tried in this order until the corpus verifies one.
IDENTIFIERS = (
    lambda chunk: F.xxhash64(chunk),
    lambda chunk: F.sha2(chunk.cast("binary"), 256),
)


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK, cut: str = CUT) -> Column:
    """The chunks of ``text``, in order; joined, they are the text again."""
    pattern = f"(?s).{{{least},{most}}}?(?={cut})|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def verified(docs: DataFrame, identifier, text: Column, **sizes) -> bool:
    """Whether equal identifiers mean equal chunks in all of ``docs``."""
    distinct = (docs.select(F.explode(chunks(text, **sizes)).alias("chunk"))
                .select(identifier(F.col("chunk")).alias("id"), "chunk").distinct())
    return (distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")).isEmpty()


def choose_identifier(docs: DataFrame, identifiers=IDENTIFIERS, **sizes):
    """The first identifier that the corpus verifies (runs a job)."""
    for identifier in identifiers:
        if verified(docs, identifier, text_or_empty(), **sizes):
            return identifier
    raise ValueError("two different chunks share every identifier")


def recipe(text: Column, identifier, **sizes) -> Column:
    """The identifiers of the chunks of ``text``, in order."""
    return F.transform(chunks(text, **sizes), identifier)


def duplicate_groups(docs: DataFrame, identifiers=IDENTIFIERS, **sizes) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept,
    n_chunks, text_sha256``.

    Reads ``doc_id`` and ``text``; other columns are ignored.  The
    verification runs when this is called.  Large groups of copies are
    pre-aggregated and joined without a shuffle (:func:`common.split_hot`).
    """
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    identifier = choose_identifier(docs, identifiers, **sizes)
    recipes = stored(docs.select("doc_id", recipe(F.col("text"), identifier, **sizes).alias("recipe"),
                                 F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")),
                     "recipes")
    groups = stored(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"),
                                                  F.count(F.lit(1)).alias("group_size")),
                    "recipe-groups")
    return split_hot(recipes, groups, ["recipe"], "group_size", recipes.count()).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.size("recipe").cast("long").alias("n_chunks"), "text_sha256")


def drop_copies(docs: DataFrame, identifiers=IDENTIFIERS, **sizes) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    The row with the largest ``doc_id`` stays.  Copies meet in a partial
    aggregate before the shuffle, so a large group sends one row per task.
    Further columns may have any name and type; rows that tie in id and text
    differ in them only, and one of these rows stays whole.
    """
    identifier = choose_identifier(docs, identifiers, **sizes)
    whole = docs.select(recipe(text_or_empty(), identifier, **sizes).alias("recipe"),
                        F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return (whole.groupBy("recipe")
            .agg(F.max_by("row", F.struct(F.col("row.doc_id").isNotNull(), "row.doc_id")).alias("row"))
            .select("row.*"))
