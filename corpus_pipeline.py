"""Curation of a corpus in five stages, each written as Parquet and read again by the next.

Every stage works on all that the one before it kept.  All but the last return the columns of ``documents``;
the last adds size, text_crc32, shard and slot.  Near-duplicates are documents whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more; one of each group stays, that with the least doc_id.

Defined results: null and empty texts are clean, have no near-duplicates and no benchmark words, take no words of the mixture and have
size 1 in their shard; very long texts are read whole; null sources are a source of their own; rows with equal doc_id, and repeated rows, are rows of their own
until the near-duplicate stage keeps one of them; ties are broken by doc_id (null last), the text's hash and the row; empty tables give empty results;
extra columns are kept, whatever their names, but for the four that the last stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm import decontaminate, jaccard, mixture, shards, toxicity
from curatrix.llm._run import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the toxicity classifier rejects; it learns from the labels of those it is given."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixture.mix(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shards and slots; columns that already have these names are replaced."""
    docs = docs.drop("size", "text_crc32", "shard", "slot")
    return shards.interleave(docs).withColumnsRenamed({"_size": "size", "_crc": "text_crc32", "_shard": "shard", "_slot": "slot"})


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The toxicity stage trains a classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
