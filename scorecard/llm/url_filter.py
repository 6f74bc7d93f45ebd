"""URL filters by rules and a classifier of character n-grams (operator 11).

A rule is a host and a path; it fits its host and all subdomains where the
url's path starts with the rule's.  The longest rule that fits (host and path
together, then the longer host, then ``block`` before ``allow``) decides.  Urls
that no rule fits are left to logistic regression on hashed character n-grams
of host and path, trained from a small labelled url table.

All of it is DataFrame expressions: no Python runs on the executors.

* Features: the n-grams of 3 to 5 characters of host and path, each with marks
  at its ends, hashed to ``BUCKETS`` numbers; a url's vector holds each bucket
  once and has length one.
* Training: ``STEPS`` full passes over the labelled table, which has
  ``LABELLED`` rows at most, each a partial aggregate of the gradient by bucket.
  The driver gets one number a bucket a pass.  Gradients are summed as whole
  numbers of 2^-30, so that no order of rows changes the model.

Defined results: a null url, or one without ``://``, has an empty host and
path, which no rule fits, and goes to the classifier.  Only A-Z of the host are
lower-cased.  Repeated urls and ids are judged each.  Very long urls take
memory and time in proportion to their length.  Without labelled urls every
verdict of the classifier is ``allow``.  An empty table gives no rows.  Columns
of other names are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_hot, stored

BUCKETS = 4096
GRAMS = (3, 4, 5)
STEPS = 20
RATE = 4.0
#: Rows of the labelled table, at most; they are taken by their url's hash.
LABELLED = 4_000
#: Rules up to this number are matched by one expression, more by a join.
INLINE_RULES = 100
#: Whole numbers that a gradient of 1 stands for.
UNIT = float(1 << 30)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``verdict, rule_host, rule_path`` of listed rules."""
    rows = [F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("verdict", "rule_host", "rule_path"))]) for r in rules]
    if not rows:
        return spark.range(0).select(*[F.lit("").alias(n) for n in ("verdict", "rule_host", "rule_path")])
    return spark.range(1).select(F.inline(F.array(*rows)))


def _rank(host: Column, path: Column, verdict: Column) -> Column:
    """A rule as a struct whose greatest value is the rule that decides."""
    return F.struct((F.length(host) + F.length(path)).alias("size"), F.length(host).alias("host_size"),
                    verdict.alias("verdict"), F.concat(host, path).alias("rule"))


def match_rules(urls: DataFrame, rules: DataFrame, inline: int = INLINE_RULES) -> DataFrame:
    """``urls`` (with ``host`` and ``path``) and ``best``, the deciding rule.

    A short list of rules is read by the driver and becomes one expression.  A
    longer one is joined: each distinct url meets the rules at its host's
    suffixes and its path's prefixes of the lengths that rules have, so that
    a rule is found by equality; frequent keys and urls do not gather
    (:func:`common.split_hot`).
    """
    few = rules.limit(inline + 1).collect()  # at most inline + 1 rows
    if len(few) <= inline:
        fits = [F.when(((F.col("host") == r.rule_host) | F.col("host").endswith("." + r.rule_host))
                       & F.col("path").startswith(r.rule_path),
                       _rank(F.lit(r.rule_host), F.lit(r.rule_path), F.lit(r.verdict))) for r in few]
        if not fits:
            fits = [F.when(F.lit(False), _rank(F.lit(""), F.lit(""), F.lit("")))]
        return urls.withColumn("best", F.array_max(F.array(*fits)))
    rules = stored(rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")), "url-rules")
    shape = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
                      F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")).first()  # one row
    ends = _with(F.split("host", r"\."), lambda labels: F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape.labels))),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")))
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in shape.lengths]), lambda n: n <= F.length("path")),
                         lambda n: F.col("path").substr(F.lit(1), n))
    distinct = stored(urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_urls")), "distinct-urls")
    keys = (distinct.select("host", "path", F.explode(ends).alias("rule_host"), starts.alias("starts"))
            .select("host", "path", "rule_host", F.explode("starts").alias("rule_path")))
    sized = stored(rules.join(keys.groupBy("rule_host", "rule_path").agg(F.count(F.lit(1)).alias("n")),
                              ["rule_host", "rule_path"]), "met-url-rules")
    met = split_hot(keys, sized, ["rule_host", "rule_path"], "n", keys.count())
    best = met.groupBy("host", "path").agg(F.max(_rank(F.col("rule_host"), F.col("rule_path"), F.col("verdict")))
                                           .alias("best"))
    decided = stored(distinct.join(best, ["host", "path"], "left"), "judged-urls")
    return split_hot(urls, decided, ["host", "path"], "n_urls", urls.count()).drop("n_urls")


def _with(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once for the row: a column that a
    lambda uses is else computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _grams(name: str, text: Column) -> Column:
    """Buckets of the n-grams of a text between marks."""
    def of_size(chars, n):
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), lambda i: i <= F.size(chars) - n)
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(name), *[F.get(chars, i + k) for k in range(n)]),
                                                    F.lit(BUCKETS)).cast("int"))

    def grams(chars):
        return F.concat(*[of_size(chars, n) for n in GRAMS])
    return _with(F.concat(F.array(F.lit("^")), F.split(text, ""), F.array(F.lit("$"))), grams)


def buckets(host: Column, path: Column) -> Column:
    """The distinct buckets of a url, ascending."""
    return F.array_sort(F.array_distinct(F.concat(_grams("host", host), _grams("path", path))))


def probability(features: Column, weights: list[float]) -> Column:
    """Of label 1; ``weights`` has one number a bucket, and the intercept."""
    table = F.from_json(F.lit(str(weights)), "array<double>")  # folded to a constant

    def chance(own):
        total = F.aggregate(own, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
        margin = total / F.sqrt(F.greatest(F.size(own), F.lit(1)).cast("double")) + F.lit(weights[-1])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    return _with(features, chance)


def fit_model(labelled: DataFrame, rows: int = LABELLED, steps: int = STEPS) -> list[float]:
    """Weights from ``url, label`` (1: block), by adaptive gradient steps.

    ``rows`` distinct urls are taken at most, by hash; a url with two labels counts
    as 1.  Null urls and labels are left out.
    """
    urls = (labelled.where("url IS NOT NULL AND label IS NOT NULL").groupBy("url")
            .agg(F.max(F.col("label").cast("int")).alias("label"))
            .orderBy(F.xxhash64("url"), "url").limit(rows))
    sample = stored(urls.select("label", buckets(host_of(F.col("url")), path_of(F.col("url"))).alias("features")),
                    "labelled-urls")
    weights, seen = [0.0] * (BUCKETS + 1), [0.0] * (BUCKETS + 1)
    n = sample.count()
    for _ in range(steps if n else 0):
        error = F.rint((F.col("label") - probability(F.col("features"), weights)) * F.lit(UNIT)).cast("long")
        scale = F.sqrt(F.greatest(F.size("features"), F.lit(1)).cast("double"))
        errors = sample.select(error.alias("e"), F.rint(error / scale).cast("long").alias("share"), "features")
        every = F.array(F.struct(F.lit(BUCKETS).alias("bucket"), F.col("e").alias("g")))
        each = F.transform("features", lambda b: F.struct(b.alias("bucket"), F.col("share").alias("g")))
        for bucket, total in errors.select(F.inline(F.concat(every, each))).groupBy("bucket").agg(
                F.sum("g")).collect():  # at most BUCKETS + 1 rows
            g = total / UNIT / n
            seen[bucket] += g * g
            if g:
                weights[bucket] += RATE * g / math.sqrt(seen[bucket])
    return weights


def judge(pages: DataFrame, rules: DataFrame, weights: list[float], inline: int = INLINE_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, probability`` for each row of ``pages``.

    ``rule`` is the deciding rule (host and path) or null; ``probability`` is the
    classifier's, of block, and decides where there is no rule (over 0.5).
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = probability(buckets(F.col("host"), F.col("path")), weights)
    return (match_rules(urls, rules, inline).withColumn("probability", p)
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.when(F.col("probability") > 0.5, "block").otherwise("allow"))
                    .alias("verdict"), "probability"))


def labelled_by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, label`` of the urls that a rule decides: a labelled table to
    train from where no other is given."""
    urls = pages.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return (match_rules(urls, rules).where("best IS NOT NULL")
            .select("url", (F.col("best.verdict") == "block").cast("int").alias("label")))
