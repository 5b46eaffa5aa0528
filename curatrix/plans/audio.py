"""Registered queries over tracks. The bytes of the documents' texts are their samples, so all of it grows with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import signal
from curatrix.operators import audio, layout
from curatrix.sources import store, wav

#: Tasks for each core.
TASKS = 4

def tracks(spark: SparkSession, sf_dir: str, rate: int = 1000, times: int = 1) -> DataFrame:
    """One track of 8-bit samples for each document, the bytes of its text ``times`` over, every second one in two channels; null texts have no samples.

    The texts are dealt out before they are tracks: the work on a track is long, and a file whose rows are one group would be the work of one task.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.repartition(TASKS * spark.sparkContext.defaultParallelism, F.xxhash64("doc_id", "text"))
    return docs.select("doc_id", F.repeat(F.col("text").cast("string"), F.lit(times)).cast("binary").alias("pcm"), F.lit(rate).alias("rate"), (1 + F.col("doc_id") % 2).cast("int").alias("channels"), F.lit(1).alias("width"))


def a6_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stereo, tempo, key, metre and instruments of every track in one pass."""
    found = audio.analyse(tracks(spark, sf_dir, 4000, 8))
    return found.select("doc_id", "stereo", F.round("side_mid_db", 6).alias("side_mid_db"), "bpm", "key", "timesig", F.array_join("instruments", ",").alias("instruments"), "instrumental", "error")


def a2_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats a minute of every track, of its middle."""
    made = audio.per_track(tracks(spark, sf_dir, 4000, 8), lambda sides, rate: round(signal.tempo(signal.onset_strength(audio.middle(sides, rate).mean(0), rate), rate)), "int")
    return made.select("doc_id", F.coalesce("found", F.lit(0)).alias("bpm"))


def a11_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the most even runs of every track begin, and its sections."""
    found = audio.segments(tracks(spark, sf_dir, 100))
    sections = F.transform("sections", lambda s: F.concat_ws(":", s["name"], F.round(s["start"], 3), F.round(s["end"], 3)))
    return found.select("doc_id", "duration", F.array_join(F.transform("bounds", lambda x: F.round(x, 3).cast("string")), ",").alias("bounds"), F.array_join(sections, ",").alias("sections"), "error")


def a9_lead_backing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every track's lead and backing."""
    found = audio.split_lead(tracks(spark, sf_dir))
    return found.select("doc_id", F.octet_length("lead").cast("long").alias("n_bytes"), F.sha2("lead", 256).alias("lead"), F.sha2("backing", 256).alias("backing"), "error")


def o3_zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six likeliest labels of every vector. The labels' vectors are those of the lowest ids: as many as there are labels."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    names = spark.createDataFrame(list(enumerate(audio.INSTRUMENTS)), "at int, label string")
    first = rows.orderBy("vec_id").limit(len(audio.INSTRUMENTS)).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("x")).select(F.posexplode("x").alias("at", "x"))
    labels = names.join(first, "at").orderBy("at").select("label", F.col("x.embedding").alias("vector"))
    found = audio.zero_shot(rows, labels, scale=5.0)
    return found.select("vec_id", F.posexplode("labels").alias("at", "l")).select("vec_id", (F.col("at") + 1).alias("rank"), "l.label", F.round("l.score", 6).alias("score"))


def a8_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's place in the map that keeps neighbours together."""
    found = layout.layout_2d(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.select("vec_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def s22_wav_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAV files of all tracks (the hexadecimal digits of the texts), written to the shared folder, and the middle second of each by the source."""
    rate = 500
    own = tracks(spark, sf_dir, rate).withColumn("pcm", F.hex(F.coalesce("pcm", F.lit(b""))).cast("binary"))
    folder = store.shared_folder(spark, "wav")
    store.write_binaries(own.select(F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("name"), wav.encoded(F.col("pcm"), F.col("rate"), F.col("channels"), F.col("width")).alias("content")), folder)
    found = wav.wav_windows(spark, folder, 1.0)
    return found.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "rate", "channels", "width", "n_frames", "start", F.sha2("pcm", 256).alias("sha256"), F.coalesce("error", F.lit("")).alias("error"))


QUERIES = {f.__name__: f for f in (a2_tempo, a6_analyze, a8_layout, a9_lead_backing, a11_segments, o3_zero_shot, s22_wav_windows)}
_NAMES = ", ".join(f"'{x}'" for x in audio.INSTRUMENTS)
ORACLE_SQL = {
    "o3_zero_shot": f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings),
l AS (SELECT k, v, list_extract([{_NAMES}], k::INTEGER) AS label FROM e WHERE k <= {len(audio.INSTRUMENTS)}),
z AS (SELECT e.vec_id, l.label, l.k, 5 * list_dot_product(e.v, l.v) / sqrt(list_dot_product(e.v, e.v) * list_dot_product(l.v, l.v)) AS z FROM e CROSS JOIN l),
p AS (SELECT vec_id, label, k, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY vec_id) AS p FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM z))
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k)::INTEGER AS rank, label, round(p, 6) AS score FROM p
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) <= 6""",
    "s22_wav_windows": """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, (1 + doc_id % 2)::INTEGER AS channels FROM documents),
n AS (SELECT *, (length(x) // channels)::BIGINT AS n_frames FROM t),
w AS (SELECT *, least(n_frames, 500) AS own FROM n)
SELECT doc_id || '.wav' AS name, 500::INTEGER AS rate, channels, 1::INTEGER AS width, n_frames, ((n_frames - own) // 2)::BIGINT AS start,
  sha256(substr(x, ((n_frames - own) // 2) * channels + 1, own * channels)) AS sha256, '' AS error FROM w""",
}
