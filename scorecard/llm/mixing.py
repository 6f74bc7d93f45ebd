"""Mixing sources to target weights by Poisson replication (operator 7).

A source with share ``w`` of the target and ``c`` of the corpus' characters is
to be repeated ``w * target / c`` times on average.  Each document draws its
number of copies from a Poisson distribution with that mean, by inverting the
distribution at a number in [0, 1) that a hash of seed and document gives;
so the draw needs no shuffle and comes out alike after a lost executor.  Copies
are exploded and put in a global order by a hash of document and copy.

All of it is DataFrame expressions: no Python runs on the executors.

A mean over 500 is drawn as the sum of several equal parts, so that the
distribution's first term does not vanish.  The table of a part reaches as far as
2^-52, the step of the hashed number, so no draw is cut.

Defined results: a null source is a source of its own; null text has no
characters; a source without characters, or of weight zero, keeps no copies;
rows equal in id and text draw alike, and are replicated each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, stored, text_or_empty

#: Sources without a weight of their own weigh as their characters to this
#: power: 1 leaves the corpus as it is, 0 gives all sources the same share.
ALPHA = 0.5
SEED = 42
#: The largest mean that is drawn in one part.
PART = 500.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1), in steps of 2^-52, by the MD5 of joined texts."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double")
            / F.lit(float(1 << 52)))


def distribution(mean: Column) -> Column:
    """P(copies <= k) for k = 0, 1, ..., until the rest is below 2^-52."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))
    return F.aggregate(
        F.sequence(F.lit(1), most), start,
        lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(
            acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["p"] * mean / k)).alias("sums")),
        lambda acc: acc["sums"])


def draw(seed: int, key: Column, parts: Column, sums: Column) -> Column:
    """Copies of a document: in each part, the sums that its number reaches."""
    return F.aggregate(
        F.sequence(F.lit(1), parts), F.lit(0),
        lambda n, i: n + F.size(F.filter(sums, lambda s: s <= uniform(F.lit(str(seed)), key, i.cast("string")))))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA,
                 target_chars: float | None = None) -> DataFrame:
    """``source, chars, weight, rate`` for each source.

    ``weights`` gives target shares by source name; without it every source
    weighs ``chars ** alpha``, and with it sources it does not name weigh
    nothing.  ``target_chars`` is the size of the mixture (the corpus' own by
    default).
    """
    spark = docs.sparkSession
    sizes = docs.select("source", F.length(text_or_empty()).alias("c")).groupBy("source").agg(
        F.sum("c").cast("long").alias("chars"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(float(alpha))))
    else:
        given = spark.createDataFrame(list(weights.items()) or [("", 0.0)], "name string, weight double")
        weighed = (sizes.join(given, sizes["source"].eqNullSafe(given["name"]), "left").drop("name")
                   .withColumn("weight", F.coalesce("weight", F.lit(0.0))))
    totals = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("chars").alias("all_chars"))
    target = F.col("all_chars").cast("double") if target_chars is None else F.lit(float(target_chars))
    return weighed.crossJoin(totals).select(  # totals is one row
        "source", "chars", F.coalesce(F.try_divide("weight", "all_weight"), F.lit(0.0)).alias("weight"),
        F.coalesce(F.try_divide(F.try_divide("weight", "all_weight") * target, F.col("chars").cast("double")),
                   F.lit(0.0)).alias("rate"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA,
              target_chars: float | None = None, seed: int = SEED) -> DataFrame:
    """``doc`` (a struct of all columns of ``docs``), ``rate, n_copies, copy,
    shuffle_key``: a row for each copy of each document, copies from 0.

    The table of rates is written first (a row per source), so Spark
    broadcasts it if it is below the session's threshold, and else shuffles.
    """
    rates = source_rates(docs, weights, alpha, target_chars)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    rates = stored(rates.where("rate > 0").select(
        F.col("source").alias("of"), "rate", parts.alias("parts"),
        distribution(F.col("rate") / parts).alias("sums")), "source-rates")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    key = id_text("doc.doc_id")
    drawn = whole.join(rates, F.col("doc.source").eqNullSafe(F.col("of"))).select(
        "doc", "rate", draw(seed, key, F.col("parts"), F.col("sums")).cast("long").alias("n_copies"))
    return drawn.where("n_copies > 0").select(
        "doc", "rate", "n_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)).alias("copy")
    ).withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"order {seed}"), key, F.col("copy").cast("string"))))


def in_shuffled_order(mixed: DataFrame) -> DataFrame:
    """Deal rows by the hash of their key and sort each partition by it: a
    uniform order over the whole mixture, without a sampling pass."""
    return mixed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA,
        target_chars: float | None = None, seed: int = SEED) -> DataFrame:
    """The mixture in its global order: columns of ``docs``, each copy a row."""
    mixed = replicate(docs, weights, alpha, target_chars, seed)
    return in_shuffled_order(mixed).select("doc.*")
