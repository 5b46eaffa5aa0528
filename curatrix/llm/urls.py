"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the urls that no rule fits.

A url's host is what follows its first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its path goes on to ``?``, ``#`` or the end.  A rule
fits its host and all subdomains where the url's path begins with the rule's; the longest rule wins (that with the longer host and path
together; block before allow if both have the same host and path).  The classifier sees the n-grams of ORDERS of ``^host$`` and of ``path$``, each marked with its part, hashed
into 2**BITS buckets (Spark's HashingTF and LogisticRegression), and learns from a small labelled table of urls: the operator takes any; the
query labels the urls of ``pages`` by its rules, and takes of either verdict the LABELLED hosts and paths with the lowest hashes,
which bounds the training and leaves every url to be judged.

DataFrame functions and Spark's own ML stages only; no row leaves the JVM.  Characters are taken from an
array, so that time grows with the url's length.

Defined results: null urls and those without ``://`` have empty host and path, fit no rule and are scored by the bias; very long urls
are read whole; equal urls get equal results; without labelled urls every score is 0.5, and a score of 0.5 is allowed; with labels of
one verdict, the score follows it; repeated rows are judged one by one; an empty table gives an empty result; extra columns are kept out.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm._run import Scratch, table

#: Lengths of n-grams, their buckets (as a power of two), labelled urls of either verdict to learn from.
ORDERS, BITS, LABELLED = (2, 3, 4), 14, 1000
#: Ridge and rounds of the regression.
RIDGE, ROUNDS = 1e-3, 60
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str  # begins with /

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query (fixed values).
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    found = F.instr(text, "://")
    rest = F.when(found > 0, F.substring(text, found + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def ruling(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The rule that fits best, as struct<rule, verdict>; null if none does."""
    first = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.host, r.path))
    fits = [((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path) for r in first]
    return F.coalesce(*[F.when(f, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for f, r in zip(fits, first, strict=True)], F.lit(None).cast("struct<rule: string, verdict: string>"))


def _grams(part: str, text: Column, orders: Sequence[int]) -> Column:
    """The n-grams of a text, each after the name of its part."""

    def each(chars: Column, n: int) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(F.lit(part), *[F.get(chars, i + k) for k in range(n)]))
        return F.when(F.size(chars) >= n, found).otherwise(F.array().cast("array<string>"))

    # the characters are bound to a variable, so that they are made once
    return F.get(F.transform(F.array(F.split(text, "")), lambda chars: F.concat(*[each(chars, n) for n in orders])), F.lit(0))


def grams(host: str = "host", path: str = "path", orders: Sequence[int] = ORDERS) -> Column:
    """What the classifier sees of a url."""
    both = [F.when(F.col(c) != "", _grams(f"{c[0]}:", mark(F.col(c)), orders)).otherwise(F.array().cast("array<string>")) for c, mark in ((host, lambda x: F.concat(F.lit("^"), x, F.lit("$"))), (path, lambda x: F.concat(x, F.lit("$"))))]
    return F.concat(*both)


def _hashed(rows: DataFrame, bits: int) -> DataFrame:
    rows = rows.withColumn("_grams", grams())
    return HashingTF(numFeatures=1 << bits, binary=True, inputCol="_grams", outputCol="_features").transform(rows).drop("_grams")


def fit(labelled: DataFrame, most: int = LABELLED, bits: int = BITS) -> LogisticRegressionModel | None:
    """A model of (url, verdict) rows, of ``most`` different hosts and paths of either verdict at most; None without any.

    Those with the lowest hashes are taken; other verdicts than allow and block are left out, and where a host and path have both, block counts.
    """
    host, path = parts()
    known = labelled.select(host.alias("host"), path.alias("path"), F.when(F.col("verdict") == "block", 1.0).when(F.col("verdict") == "allow", 0.0).alias("label")).filter("label IS NOT NULL")
    known = known.groupBy("host", "path").agg(F.max("label").alias("label"))
    order = [F.xxhash64("host", "path"), F.col("host"), F.col("path")]
    picked = known.filter("label = 1").orderBy(*order).limit(most).unionAll(known.filter("label = 0").orderBy(*order).limit(most))
    # the bounded sample in one partition: sums in one order, so that reruns agree
    sample = Scratch(labelled.sparkSession, "urls").save(_hashed(picked, bits).select("label", "_features").coalesce(1), "sample")
    if sample.isEmpty():
        return None
    learner = LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_both", predictionCol="_is", rawPredictionCol="_raw", family="binomial", regParam=RIDGE, maxIter=ROUNDS, standardization=False)
    return learner.fit(sample)


def labels_by_rules(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(url, verdict) of the urls that a rule fits."""
    return pages.select("url", ruling(rules, *parts()).verdict.alias("verdict")).filter("verdict IS NOT NULL")


def judge(pages: DataFrame, model: LogisticRegressionModel | None, rules: Sequence[Rule] = RULES, bits: int = BITS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (of the classifier, that the url is to be blocked) of every url."""
    host, path = parts()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if model is None:
        scored = rows.withColumn("score", F.lit(0.5))
    else:
        scored = model.transform(_hashed(rows, bits)).withColumn("score", F.round(F.get(vector_to_array("_both"), F.lit(1)), 9))
    found = scored.withColumn("_rule", ruling(rules, F.col("host"), F.col("path")))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(labels_by_rules(pages)))


QUERIES = {"op13_urls": op13_urls}
ORACLE_SQL: dict[str, str] = {}
