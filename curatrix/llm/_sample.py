"""Bounded training samples of labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(mod: int, rest: int) -> F.Column:
    """Whether the row is kept from training: crc32 of doc_id as text, mod ``mod``, is ``rest``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == rest


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, out_of_training: F.Column, most: int) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """Up to ``most`` (label, text) rows of either class, those with the lowest hash of doc_id; and each class's rows in all.

    The counts cover every label.  Labels other than 0 and 1, rows held out and ids without a document are left
    out; of rows with equal doc_id the least text counts.  The picked ids number 2 * most at most, which bounds what
    is broadcast and how many texts the driver fetches.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("doc_id").isNotNull() & ~out_of_training).groupBy("doc_id").agg(F.max("_y").alias("_y"))
    counts = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    order = [F.xxhash64("doc_id", F.lit(1)), F.col("doc_id")]
    picked = known.filter("_y = 1").orderBy(*order).limit(most).unionAll(known.filter("_y = 0").orderBy(*order).limit(most))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").filter("text is not null").groupBy("doc_id").agg(F.first("_y").alias("_y"), F.min("text").alias("text")).select("_y", "text")
    return sorted((r[0], r[1]) for r in rows.collect()), counts
