"""Line dedup: range-partitioned line fingerprints, first occurrences, and per-document bitmaps; DataFrame functions only.

Every line of ``least`` code points or more (after stripping and lower-casing) becomes a row of a 128-bit fingerprint,
document and position.  Rows are range-partitioned by (fingerprint, document) and sorted by position within, so a
fingerprint that very many documents share spans many partitions; each partition streams the first occurrence in
a document and gathers the positions behind it.  Counting documents for each fingerprint pre-aggregates, so one
row for each fingerprint and partition is shuffled.  Lines to drop come back as bitmaps, 63 lines to a word, only words with a
bit set being stored; texts meet them once, and no text is shuffled for the search itself.

Defined results: null and empty texts are one empty line; documents are told apart by doc_id, so rows with equal
doc_id count as one document and each keeps or loses its own lines; a null doc_id is one document below all others;
an empty table gives an empty result; other columns are not read by the query and kept by ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm._run import Scratch, shuffle_partitions, sql_text, table

#: Code points of a key, and documents that hold it, from which its lines are dropped.
LEAST, COPIES = 40, 5
#: Lines in a word of a bitmap.
WORD = 63
#: Fingerprints to drop that are sent to all tasks, at most; more are joined by a shuffle, each dealt over so many tasks.
KEYS_SENT, SALTS = 200_000, 64

_STRIP = " \t\n\u000b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: F.Column) -> F.Column:
    """The line stripped of white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_STRIP))
    # lower() is exact, and faster, where every character is ASCII
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines() -> F.Column:
    return F.split(F.col("_text"), "\n", -1)


def drop_bitmaps(docs: DataFrame, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """doc_id, _th (hash of the text) and _drop, a map from word number to the bits of the lines to drop, of documents that lose any."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lines")
    rows = docs.select("doc_id", sql_text().alias("_text")).withColumn("_th", F.xxhash64("_text"))
    lines = rows.select("doc_id", "_th", F.posexplode(_lines()).alias("pos", "line")).filter(F.char_length("line") >= least)
    keys = lines.select("doc_id", "_th", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least)
    prints = keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "_th", "pos")
    dealt = prints.repartitionByRange(shuffle_partitions(spark), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    first = scratch.save(dealt.groupBy("h1", "h2", "doc_id").agg(F.collect_list(F.struct("_th", "pos")).alias("places")), "first")
    spread = first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= copies)
    spread = scratch.save(spread, "spread")
    if spread.count() <= KEYS_SENT:
        met = first.join(F.broadcast(spread), ["h1", "h2"])
    else:  # a fingerprint of very many documents is dealt over SALTS tasks
        salted = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = first.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["h1", "h2", "salt"])
    lost = met.filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    places = lost.select("doc_id", F.explode("places").alias("at")).select("doc_id", "at._th", "at.pos").repartition("doc_id", "_th")
    bit = F.expr(f"shiftleft(1L, pos % {WORD})")
    words = places.groupBy("doc_id", "_th", F.expr(f"pos div {WORD}").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return scratch.only(words.groupBy("doc_id", "_th").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_drop")), "bitmaps")


def _marked(docs: DataFrame, least: int, copies: int) -> DataFrame:
    """docs with _text, _n, _dropped and _kept (the text of the lines that stay)."""
    marks = drop_bitmaps(docs, least, copies).withColumnsRenamed({"doc_id": "_id", "_th": "_of"})
    rows = docs.withColumn("_text", sql_text()).withColumn("_th", F.xxhash64("_text"))
    # the marks are the build side: narrow, and the long texts need no sort
    both = rows.join(marks.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_of")), "left")
    stays = lambda line, i: F.coalesce(F.expr("_drop")[F.floor(i / WORD).cast("int")], F.lit(0).cast("long")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % WORD)) == 0
    kept = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(F.filter(_lines(), stays), "\n"))
    dropped = F.when(F.col("_drop").isNull(), 0).otherwise(F.aggregate(F.map_values("_drop"), F.lit(0), lambda a, b: a + F.bit_count(b)))
    return both.withColumns({"_n": F.size(_lines()).cast("long"), "_dropped": dropped.cast("long"), "_kept": kept}).drop("_id", "_of", "_th", "_drop")


def dedup_lines(docs: DataFrame, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """docs, all columns, with the lines that stay as their text."""
    # rows stay in a struct, so that no name of theirs can clash
    own = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return _marked(own, least, copies).select(*[F.col("_kept").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and the SHA-256 of what is kept."""
    docs = _marked(table(spark, sf_dir, "documents").select("doc_id", "text"), LEAST, COPIES)
    return docs.select("doc_id", F.col("_n").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op8_lines": op8_lines}
ORACLE_SQL = {
    "op8_lines": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -1)) >= 5),
m AS (SELECT k.*, bad.key IS NOT NULL AND k.doc_id IS DISTINCT FROM bad.last AS gone FROM k LEFT JOIN bad USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
}
