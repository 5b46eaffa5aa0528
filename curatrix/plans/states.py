"""Registered queries of saved states, streams, table functions and typed documents, over files and streams that Spark makes of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators import versions
from curatrix.plans import table_functions
from curatrix.plans.queries import _EDITED, ORACLE_SQL as _LIBRARY
from curatrix.plans.view import samples, sql
from curatrix.sources import polled, readers, store, writers
from curatrix.streaming import edits

#: Seconds that an edit rests, and that edits may be late.
QUIET, LATE = 3600, 7200
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def k1_saved_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two saves, each of all its rows: what the pointer names now, beside what it named before."""
    root = store.shared_folder(spark, "states")
    rows = samples(spark, sf_dir).select("pos", "id", "genre")
    versions.save_current(rows, {"name": "first"}, root, "1")
    _, old = versions.load_current(spark, root)
    versions.save_current(rows.filter("pos % 5 <> 0").withColumn("genre", F.upper("genre")), {"name": "second"}, root, "2")
    metadata, new = versions.load_current(spark, root)
    both = old.join(new.select("id", F.col("genre").alias("now")), "id", "left")
    return both.select("pos", F.col("genre").alias("before"), "now", F.lit(metadata["num_samples"]).cast("long").alias("num_samples"))


def s13_polled_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll's answer for every hundred tracks, streamed twice from one checkpoint: every entry once."""
    root = store.shared_folder(spark, "polls")
    entry = F.when(F.col("pos") % 7 == 0, F.lit('"no object"')).otherwise(F.to_json(F.struct(F.when(F.col("pos") % 5 > 0, F.col("id")).alias("render_id"), F.when(F.col("pos") % 3 > 0, F.col("genre")).alias("name"))))
    answers = samples(spark, sf_dir).groupBy(F.expr("pos div 100").alias("k")).agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))).alias("x"))
    lists = answers.select(F.format_string("%08d.json", "k").alias("name"), F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e["e"]), ","), F.lit("]")).alias("text"))
    writers.write_files(lists, f"{root}/answers")
    for most in (3, 0):
        polled.polled(spark, f"{root}/answers", most).writeStream.format("parquet").option("path", f"{root}/read").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return polled.algorithms(spark.read.parquet(f"{root}/read")).select("poll", "pos", "id", "name")


def e1_debounced_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits of their user: one write for each rest of an hour, unless the text is the one written before."""
    root, key = store.shared_folder(spark, "edits"), "spark.sql.streaming.stateStore.providerClass"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"))
    rows.write.parquet(f"{root}/events")
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        stream = edits.debounced(spark.readStream.schema(rows.schema).parquet(f"{root}/events"), QUIET, f"{LATE} seconds")
        stream.writeStream.format("parquet").option("path", f"{root}/writes").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(edits.WRITTEN).parquet(f"{root}/writes")


def s17_blocks_by_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited blocks by the SQL table function, a partition for each text."""
    table_functions.register(spark)
    own = samples(spark, sf_dir).select(F.expr("pos div 20").alias("doc"), "pos", F.expr(_EDITED).alias("b"))
    docs = own.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "").alias("text"))
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines.createOrReplaceTempView("curatrix_block_lines")
    return spark.sql("SELECT doc, filename, text FROM lyric_blocks(TABLE(curatrix_block_lines) PARTITION BY doc ORDER BY at)")


def s9_typed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for every tenth track, some of them corrupt, some without most fields, written as files and read with types."""
    root = store.shared_folder(spark, "profiles")
    rows = samples(spark, sf_dir).filter("pos % 10 = 0")
    whole = F.to_json(F.struct(F.col("genre").alias("name"), F.create_map("id", "language").alias("contractions"), F.array("language", "genre").alias("case_fixed"), (F.col("pos") % 20 == 0).alias("ing_to_in"), (F.col("pos") % 60 > 0).alias("capitalize_tags")))
    text = F.when(F.col("pos") % 70 == 0, F.lit('{"name": ')).when(F.col("pos") % 50 == 0, F.lit("{}")).otherwise(whole)
    writers.write_files(rows.select(F.concat("id", F.lit(".json")).alias("name"), text.alias("text")), root)
    found = readers.typed_profiles(spark, root)
    p = F.col("profile")
    return found.select(F.col("file").alias("id"), p["name"].alias("name"), F.array_join(F.map_values(p["contractions"]), ",").alias("said"), F.array_join(p["case_fixed"], ",").alias("fixed"), *[p[c].cast("string").alias(c) for c in ("ing_to_in", "capitalize_tags", "strip_punctuation")])


QUERIES = {f.__name__: f for f in (e1_debounced_edits, k1_saved_states, s9_typed_profiles, s13_polled_algorithms, s17_blocks_by_table_function)}
ORACLE_SQL = {
    "k1_saved_states": sql("SELECT pos, genre AS before, CASE WHEN pos % 5 <> 0 THEN upper(genre) END AS now, (SELECT count(*) FROM samples WHERE pos % 5 <> 0) AS num_samples FROM samples"),
    "s13_polled_algorithms": sql("""SELECT format('{:08d}.json', pos // 100) AS poll, (row_number() OVER (PARTITION BY pos // 100 ORDER BY pos) - 1)::INTEGER AS pos, id, CASE WHEN pos % 3 > 0 THEN genre ELSE id END AS name
 FROM samples QUALIFY pos % 5 > 0 AND pos % 7 > 0"""),
    "e1_debounced_edits": f"""
WITH e AS (SELECT user_id::VARCHAR AS id, event_id AS seq, ts, event_type AS text, max(ts) OVER () AS latest FROM events),
k AS (SELECT *, seq > coalesce(max(seq) OVER (PARTITION BY id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS new FROM e),
g AS (SELECT *, ts >= lag(ts) OVER (PARTITION BY id ORDER BY ts, seq) + INTERVAL {QUIET} SECOND AS rested FROM k WHERE new),
i AS (SELECT *, count(*) FILTER (rested) OVER (PARTITION BY id ORDER BY ts, seq) AS island FROM g),
r AS (SELECT id, island, arg_max(text, seq) AS text, max(seq) AS seq, count(*) AS edits, max(ts) AS last, any_value(latest) AS latest, island = max(island) OVER (PARTITION BY id) AS open FROM i GROUP BY id, island),
w AS (SELECT *, lag(text) OVER (PARTITION BY id ORDER BY island) AS written FROM r)
SELECT id, text, seq, edits FROM w WHERE (written IS NULL OR written <> text) AND (NOT open OR last + INTERVAL {QUIET} SECOND < latest - INTERVAL {LATE} SECOND)""",
    "s17_blocks_by_table_function": _LIBRARY["s17_parse_blocks"],
    "s9_typed_profiles": sql("""SELECT id, CASE WHEN bad THEN NULL WHEN bare OR genre = '' THEN id ELSE genre END AS name, CASE WHEN bad THEN NULL WHEN bare THEN '' ELSE language END AS said,
  CASE WHEN bad THEN NULL WHEN bare THEN '' ELSE array_to_string(list_sort([language, genre]), ',') END AS fixed, CASE WHEN bad THEN NULL ELSE (NOT bare AND pos % 20 = 0)::VARCHAR END AS ing_to_in,
  CASE WHEN bad THEN NULL ELSE (bare OR pos % 60 > 0)::VARCHAR END AS capitalize_tags, CASE WHEN bad THEN NULL ELSE 'true' END AS strip_punctuation
 FROM (SELECT *, pos % 70 = 0 AS bad, pos % 70 <> 0 AND pos % 50 = 0 AS bare FROM samples WHERE pos % 10 = 0)"""),
}
