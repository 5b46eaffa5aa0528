"""Sharding by proportional stratified interleaving.

Rows of a source are put in a seeded pseudo-random order and get the fraction (2 rank - 1) / (2 rows of the
source); all rows are then taken in the order of that fraction and cut into shards of equal counts, so every
shard holds every source in the mixture's proportion.  Law: ``rows``.

Both rankings are done in buckets: a shuffle deals rows by (source, hash bucket), then by fraction bucket;
each bucket is ranked on its own, and starts at the count of the buckets before it.  A source that holds a
third of all rows is thus many buckets, and no task sees a whole source.

Defined results: null text has size 1 and the checksum of the empty string; null source is a source of its own;
null doc_id sorts first; rows with equal doc_id are ordered by size and checksum; an empty table gives an empty
result; other columns, whatever their names, are kept by ``interleave``, but for those that have the names of its four own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm._run import shuffle_partitions, sql_text, table

#: Shards, and the seed of the order in a source.
SHARDS, SEED = 8, 7
#: Hash buckets of a source, fraction buckets of all, for each shuffle partition.
PER_PARTITION = 8


#: Columns that ``interleave`` adds.
ADDED = ("_size", "_crc", "_shard", "_slot")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs with _size, _crc, _shard and _slot (gapless from 0 in each shard)."""
    kept = [c for c in docs.columns if c not in ADDED]
    # rows stay in a struct, so that no name of theirs can clash
    own = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    return _dealt(own, shards, seed).select(*[F.col(f"row.`{c}`") for c in kept], *ADDED)


def _dealt(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """doc_id, source, text and further columns of docs with those of ADDED."""
    spark, total = docs.sparkSession, docs.count()
    buckets = shuffle_partitions(spark) * PER_PARTITION
    text = sql_text().cast("binary")
    rows = docs.withColumns({"_size": F.octet_length(text).cast("long") + 1, "_crc": F.crc32(text), "_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))})
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    place = (F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long")
    rows = rows.withColumn("_order", order).withColumn("_bucket", place)

    # rank in the source: rows of earlier hash buckets, then the place in the own one
    counts = rows.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    of_source = Window.partitionBy("_source")
    before = F.sum("_n").over(of_source.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    starts = counts.select("_source", "_bucket", before.alias("_before"), F.sum("_n").over(of_source).alias("_of"))
    own = Window.partitionBy("_source", "_bucket").orderBy("_order", "doc_id", "_size", "_crc")
    rank = 2 * (F.row_number().over(own) + F.col("_before")) - 1
    ranked = rows.join(starts, ["_source", "_bucket"]).withColumn("_rank", rank)
    ranked = ranked.withColumns({"_part": F.col("_rank") / (2 * F.col("_of")), "_bucket": F.expr(f"_rank * {buckets} div (2 * _of)")})

    # how many rows precede each bucket of fractions follows from the sources' counts: of n rows, those of rank k with (2k - 1) buckets < 2 n bucket
    sizes = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_of")).groupBy("_of").agg(F.count(F.lit(1)).alias("_times"))
    each = sizes.select("_of", "_times", F.explode(F.expr(f"sequence(0L, {buckets - 1}L)")).alias("_bucket"))
    heads = each.groupBy("_bucket").agg(F.sum(F.expr(f"_times * (((2 * _of * _bucket - 1) div {buckets} + 1) div 2)")).alias("_head"))
    own = Window.partitionBy("_bucket").orderBy("_part", "_source", "_order", "doc_id", "_size", "_crc")
    placed = ranked.join(heads, "_bucket").withColumn("_at", F.row_number().over(own) + F.col("_head") - 1)
    shard = F.expr(f"_at * {shards} div {max(1, total)}")
    out = placed.withColumn("_shard", shard.cast("int"))
    first = F.expr(f"(_shard * {total}L + {shards - 1}) div {shards}")
    return out.withColumn("_slot", F.col("_at") - first).drop("_bucket", "_before", "_of", "_rank", "_part", "_head", "_at", "_order", "_source")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document; counts are at most one apart."""
    docs = _dealt(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), SHARDS, SEED)
    return docs.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_shards": op5_shards}
ORACLE_SQL = {
    "op5_shards": """
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, source, coalesce(text, '') AS x FROM documents),
s AS (SELECT doc_id, source, strlen(x) + 1 AS size, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS o, coalesce('=' || source, '') AS src,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM d, tab),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY src ORDER BY o, doc_id NULLS FIRST, size, crc) - 1) / (2 * count(*) OVER (PARTITION BY src)) AS part FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY part, src, o, doc_id NULLS FIRST, size, crc) - 1 AS place, count(*) OVER () AS n FROM r),
q AS (SELECT *, place * 8 // n AS shard FROM p)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, (place - (shard * n + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM q
"""
}
