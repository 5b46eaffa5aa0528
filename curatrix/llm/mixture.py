"""Mixing sources to target weights; DataFrame functions only.

Words of a source are laid end to end (in the order of a hash of doc_id) and packed into blocks of BLOCK words.  The
driver turns the sources' sizes into targets, targets into numbers of slots, and draws how many slots of each
source go to each output shard (multinomial draws over what is left to draw, so that the totals are met).  Slot j
of a source is its block permutation(j mod blocks) in pass j div blocks; the permutation is a keyed
swap-or-not shuffle, evaluated by index.  ``packed`` joins slots and packed blocks by index; ``taken`` counts what that takes of each document.

What the driver holds is one row for each source.  Running sums are taken in hash buckets, so a source with a third of all rows
is many tasks.

Defined results: null and empty texts have size 0 and are never taken; null source is the last source; rows with
equal doc_id are ordered by size; repeated rows are documents of their own; an empty table gives an empty
result; other columns are not read by ``taken`` and kept by ``mix``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm._run import Scratch, shuffle_partitions, sql_text, table

#: Words of a block, output shards, weights in turn, the most that a source is taken, and the seed.
BLOCK, SHARDS, WEIGHTS, MOST, SEED = 128, 8, (5, 2, 1), 3, 11
#: Rounds of the shuffle; hash buckets of a source for each shuffle partition; slots laid out by one row.
ROUNDS, PER_PARTITION, PIECE = 12, 8, 1 << 16
#: Sources up to this number are broadcast; more are joined by a shuffle.
SMALL = 10_000
#: A word.
WORD = r"[^\x20\x09-\x0D]+"
#: One copy, in the whole numbers that shares are added up in.
ONE = 1 << 20


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> list[float]:
    """Words to take from each source: shares of all sizes by weight, none above ``most`` times its size."""
    caps = [most * s for s in sizes]
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(w[i] for i in open_)
        full = [i for i in open_ if left * w[i] / total > caps[i]]
        if not full:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in full:
            out[i] = float(caps[i])
        open_ -= set(full)
        left = float(sum(sizes)) - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def draws(slots: list[int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Slots of each source (columns) in each output shard (rows): multinomial draws by what is left, all slots used."""
    rng, left, out = np.random.default_rng(seed), np.array(slots, np.int64), np.zeros((shards, len(slots)), np.int64)
    total = int(left.sum())
    for k in range(shards):
        want = total * (k + 1) // shards - total * k // shards
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[k] += got
            left -= got
            want -= int(got.sum())
    return out


def _permuted(x: F.Column, n: F.Column, *key: F.Column) -> F.Column:
    """The keyed pseudo-random permutation of 0 to n - 1 at x: in each round, x and its mirror image change places or not."""

    def step(a: F.Column, r: F.Column) -> F.Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), *key, r), n) - a, n)
        bit = F.pmod(F.xxhash64(F.lit(SEED + 1), *key, r, F.greatest(a, mirror)), F.lit(2))
        return F.when(bit == 0, a).otherwise(mirror)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


class Mix:
    """The plan of one mix: rows, sources, slots of the output shards and the words' places in their sources."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST):
        spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixture")
        self.block, buckets = block, shuffle_partitions(spark) * PER_PARTITION
        size = F.regexp_count("text", F.lit(WORD)).cast("long")
        rows = docs.select("doc_id", source_key().alias("_source"), sql_text().alias("text")).select("doc_id", "_source", F.xxhash64("text").alias("_th"), size.alias("size"))
        # buckets are ranges of the hash, so the order of a source does not depend on how many there are
        rows = rows.withColumn("_hash", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 32)))
        self.rows = rows = scratch.save(rows.withColumn("_bucket", F.expr(f"_hash * {buckets} div {1 << 32}").cast("int")), "rows")

        # one row for each source: its size, target, blocks and slots
        sums = [(r[0], r[1]) for r in rows.groupBy("_source").agg(F.sum("size")).collect()]
        sums.sort(key=lambda r: (r[0] == "", r[0].encode()))
        want = targets([s for _, s in sums], weights, most)
        blocks = [-(-s // block) for _, s in sums]
        slots = [min(most * n, max(1, round(n * t / s))) if s else 0 for (_, s), t, n in zip(sums, want, blocks, strict=True)]
        sources = spark.createDataFrame([(k, s, t) for (k, s), t in zip(sums, want, strict=True)], "_source string, source_size long, target double")
        self.sources = F.broadcast(sources) if len(sums) <= SMALL else sources

        # slots of each source and output shard, laid out in pieces, each the block of an index
        drawn = draws(slots, shards)
        starts = np.cumsum(drawn, axis=0) - drawn
        plan = [(k, sums[s][0], blocks[s], int(starts[k, s]), int(drawn[k, s])) for k in range(shards) for s in range(len(sums)) if drawn[k, s]]
        plan = spark.createDataFrame(plan, "shard int, _source string, n long, start long, many long")
        pieces = plan.withColumn("piece", F.explode(F.expr(f"sequence(0L, (many - 1) div {PIECE})"))).repartition(shuffle_partitions(spark), "_source", "start", "piece")
        slot = F.explode(F.expr(f"sequence(start + piece * {PIECE}, start + least(many, (piece + 1) * {PIECE}) - 1)")).alias("slot")
        index = _permuted(F.col("slot") % F.col("n"), F.col("n"), F.col("_source"), F.expr("slot div n"))
        #: shard, _source, slot and block: every slot's block.
        self.slots = pieces.select("shard", "_source", "n", slot).select("shard", "_source", "slot", index.alias("block"))

        # the place of each document's words in its source
        sized = rows.filter("size > 0")
        upto = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        heads = sized.groupBy("_source", "_bucket").agg(F.sum("size").alias("_in")).select("_source", "_bucket", (F.sum("_in").over(upto) - F.col("_in")).alias("_head"))
        own = Window.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id", "size", "_th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = sized.join(heads, ["_source", "_bucket"]).withColumn("at", F.sum("size").over(own) - F.col("size") + F.col("_head")).drop("_head", "_bucket", "_hash")
        #: The blocks that each document's words are in: block, words of it from word ``skip`` of the document on.
        covers = placed.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
        begin = f"greatest(at, block * {block})"
        self.covers = covers.withColumns({"words": F.expr(f"least(at + size, (block + 1) * {block}) - {begin}"), "skip": F.expr(f"{begin} - at")})


def source_key() -> F.Column:
    """The source behind an equals sign, '' where it is null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, _th (hash of the text), _source, size, source_size, target and taken of every row."""
    plan = Mix(docs, **options)
    uses = plan.slots.groupBy("_source", "block").agg(F.count(F.lit(1)).alias("uses"))
    met = plan.covers.join(uses.hint("merge"), ["_source", "block"], "left")  # grows with the input: never broadcast
    sums_of = met.groupBy("_source", "at", "doc_id", "_th", "size").agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).cast("long").alias("taken"))
    empty = plan.rows.filter("size = 0").select("_source", "doc_id", "_th", "size", F.lit(0).cast("long").alias("taken"))
    both = sums_of.select(*empty.columns).unionAll(empty)
    return both.join(plan.sources, "_source").select("doc_id", "_th", "_source", "size", "source_size", "target", "taken")


def packed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: shard, slot (0 up in each shard's source), source, block and words (an array) of every slot, joined by index.

    A block gathers its words from BLOCK documents at most, as each gives one word or more; the last block of a source may be shorter.
    """
    plan = Mix(docs, **options)
    words = docs.select("doc_id", source_key().alias("_source"), sql_text().alias("text")).select("doc_id", "_source", F.xxhash64("text").alias("_th"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("own"))
    words = words.dropDuplicates(["doc_id", "_source", "_th"])  # repeated rows have the same words
    key = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_source") == F.col("_from")) & (F.col("_th") == F.col("_of"))
    parts = plan.covers.join(words.withColumnsRenamed({"doc_id": "_id", "_source": "_from", "_th": "_of"}), key)
    parts = parts.select("_source", "block", "at", F.slice("own", F.col("skip").cast("int") + 1, F.col("words").cast("int")).alias("own"))
    blocks = parts.groupBy("_source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "own"))), lambda x: x["own"])).alias("words"))
    source = F.when(F.col("_source") != "", F.substring("_source", F.lit(2), F.length("_source"))).alias("source")
    return plan.slots.join(blocks.hint("merge"), ["_source", "block"]).select("shard", "slot", source, "block", "words")


def copies(docs: DataFrame, **options) -> DataFrame:
    """doc_id, _th and _source of every document with words, and _times: how often it is repeated.

    The shares taken / size of a source are laid end to end, by classes of size, and every whole number passed is a copy.  A
    document gets its share rounded up or down, on average its share; as neighbours are of like size, the words of the
    copies stay near the words taken.  Repeated rows of one document share a place and are repeated alike.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "copies")
    each = taken(docs, **options).filter("size > 0").groupBy("doc_id", "_th", "_source", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken"))
    each = each.withColumns({"_share": F.expr(f"cast(round(taken / (n * size) * {ONE}) as long)"), "_class": F.expr("cast(floor(8 * log2(n * size)) as int)")})
    each = each.withColumn("_hash", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 32)))
    each = each.withColumn("_bucket", F.expr(f"_hash * {shuffle_partitions(spark)} div {1 << 32}").cast("int"))
    each = scratch.save(each.select("doc_id", "_th", "_source", "_class", "_bucket", "_hash", "_share"), "shares")
    upto = Window.partitionBy("_source").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = each.groupBy("_source", "_class", "_bucket").agg(F.sum("_share").alias("_in"))
    heads = heads.select("_source", "_class", "_bucket", (F.sum("_in").over(upto) - F.col("_in") + F.pmod(F.xxhash64(F.lit(SEED), "_source"), F.lit(ONE))).alias("_head"))
    own = Window.partitionBy("_source", "_class", "_bucket").orderBy("_hash", "doc_id", "_th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = each.join(heads, ["_source", "_class", "_bucket"]).withColumn("_end", F.sum("_share").over(own) + F.col("_head"))
    return ends.select("doc_id", "_th", "_source", F.expr(f"cast(_end div {ONE} - (_end - _share) div {ONE} as int)").alias("_times"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, repeated so that each source's words meet what is taken of it; see ``copies``."""
    each = copies(docs.select("doc_id", "source", "text"), **options).filter("_times > 0")
    each = each.withColumnsRenamed({"doc_id": "_id", "_th": "_of", "_source": "_from"})
    # rows stay in a struct, so that no name of theirs can clash
    rows = docs.select("doc_id", F.xxhash64(sql_text()).alias("_th"), source_key().alias("_source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = rows.join(each.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_of")) & (F.col("_source") == F.col("_from")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return taken(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op10_mixture": op10_mixture}
ORACLE_SQL: dict[str, str] = {}
