"""Registered queries of sinks and of edits that a session ends with. The SQL states the formats' rules anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators import edits, merging
from curatrix.plans.view import samples, sql
from curatrix.sources import readers, writers

#: Captions with what CSV has to quote, and nulls.
_CAPTION = "case pos % 5 when 0 then null when 1 then concat('a, \"', genre, '\"') when 2 then concat(genre, chr(10), 'x') when 3 then 'plain' else coalesce(custom_tag, '') end"


def k3_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the CSV export."""
    rows = samples(spark, sf_dir).withColumn("caption", F.expr(_CAPTION)).drop("keyscale")
    return writers.csv_lines(rows).select(F.col("at").alias("pos"), "line")


def _cell(x: str) -> str:
    return f"(CASE WHEN regexp_matches(coalesce({x}, ''), '[,\"\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE coalesce({x}, '') END)"


def k2_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported document, written and read again: id and place of every sample in it."""
    from curatrix.sources import store

    folder = store.shared_folder(spark, "document")
    writers.write_json(samples(spark, sf_dir), {"name": "all"}, folder)
    metadata, rows = readers.dataset(spark, folder)
    return rows.crossJoin(F.broadcast(metadata)).select("pos", "id", F.get_json_object("metadata", "$.num_samples").cast("long").alias("num_samples"))


def s3_add_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks for all paths, appended to those of every third track."""
    rows = samples(spark, sf_dir)
    have = rows.filter("pos % 3 = 0").select("pos", "id", "audio_path", "custom_tag", "is_instrumental", "language")
    paths = rows.select("pos", F.col("audio_path").alias("path"))
    added = readers.add_paths(have, paths.unionAll(paths), " all ", True)
    return added.select("pos", "audio_path", "custom_tag", "is_instrumental", "language")


_SUFFIX = "concat(audio_path, case pos % 9 when 0 then '.WMA' when 1 then '.mp3' when 2 then '.flac' when 3 then '.ogg' when 4 then '.m4a' when 5 then '.aac' when 6 then '.txt' when 7 then '/none' else '' end)"


def t34_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("pos", T.mime_of(F.expr(_SUFFIX)).alias("mime"))


def p10_rename_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in a padded field, counted over the tracks that have a name."""
    rows = samples(spark, sf_dir).withColumn("filename", F.expr("case when pos % 4 = 1 then '' else filename end"))
    return edits.renamed(rows, "number", "T{n:05d} of {n}", start=7).select("id", "new_name")


def p12_all_tag_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for synonyms in all three fields that hold tags."""
    rows = samples(spark, sf_dir).select("id", "custom_tag", F.split("detected_instruments", ",").alias("detected_instruments"), F.struct("bpm", F.split("custom_tag", "[,;|/]").alias("instruments")).alias("tags"))
    out = edits.normalize_all_tags(rows)
    return out.select("id", "changed", "custom_tag", F.array_join("detected_instruments", "|").alias("detected"), F.array_join("tags.instruments", "|").alias("tagged"))


def u1_merge_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that keep their ending: those of two lists, each once."""
    rows = samples(spark, sf_dir)
    return merging.merge_exceptions(rows.filter("pos % 2 = 0").select(F.col("genre").alias("word")), rows.filter("pos % 3 = 0").select(F.col("language").alias("word")))


_SPLIT = "list_filter(list_transform(regexp_split_to_array(custom_tag, '[,;|/]+'), lambda t: trim(t)), lambda t: t <> '')"


def _oracles() -> dict[str, str]:
    from curatrix.plans.queries import _norm

    text = {
        "k3_csv": f"SELECT pos, id || ',' || {_cell('filename')} || ',' || {_cell('audio_path')} || ',' || {_cell('genre')} || ',' || bpm || ',' || '' || ',' || duration || ',' || CASE WHEN is_instrumental THEN 'True' ELSE 'False' END || ',' || {_cell('custom_tag')} || ',' || {_cell('cap')} AS line FROM (SELECT *, {_CAPTION} AS cap FROM samples) WHERE NOT virtual",
        "k2_json_lines": "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, id, count(*) OVER () AS num_samples FROM samples WHERE NOT virtual",
        "s3_add_paths": """
, h AS (SELECT pos, audio_path, custom_tag, is_instrumental, language FROM samples WHERE pos % 3 = 0),
n AS (SELECT min(pos) AS o, audio_path FROM samples WHERE audio_path NOT IN (SELECT audio_path FROM h) GROUP BY audio_path)
SELECT * FROM h UNION ALL SELECT (SELECT max(pos) FROM h) + row_number() OVER (ORDER BY o), audio_path, 'all', true, 'en' FROM n""",
        "t34_mime": "SELECT pos, CASE pos % 9 WHEN 0 THEN 'audio/x-ms-wma' WHEN 1 THEN 'audio/mpeg' WHEN 2 THEN 'audio/flac' WHEN 3 THEN 'audio/ogg' WHEN 4 THEN 'audio/mp4' WHEN 5 THEN 'audio/aac' WHEN 6 THEN 'audio/mpeg' WHEN 7 THEN 'audio/mpeg' ELSE 'audio/wav' END AS mime FROM samples",
        "p10_rename_padded": "SELECT id, CASE WHEN pos % 4 <> 1 THEN format('T{:05d} of {}.wav', n, n) END AS new_name FROM (SELECT id, pos, 6 + count(*) FILTER (pos % 4 <> 1) OVER (ORDER BY pos) AS n FROM samples)",
        "p12_all_tag_fields": f"""
, t AS (SELECT id, custom_tag, {_SPLIT} AS own, string_split(detected_instruments, ',') AS d, regexp_split_to_array(custom_tag, '[,;|/]') AS g FROM samples),
n AS (SELECT *, list_transform(own, lambda t: {_norm('t')}) AS own_n, list_transform(d, lambda t: {_norm('t')}) AS d_n, list_transform(g, lambda t: {_norm('t')}) AS g_n FROM t)
SELECT id, ((len(own) > 0 AND own_n <> own)::INTEGER + (d_n <> d)::INTEGER + (g_n <> g)::INTEGER)::INTEGER AS changed,
  CASE WHEN len(own) > 0 AND own_n <> own THEN array_to_string(own_n, ', ') ELSE custom_tag END AS custom_tag, array_to_string(d_n, '|') AS detected, array_to_string(g_n, '|') AS tagged FROM n""",
        "u1_merge_exceptions": "SELECT genre AS word FROM samples WHERE pos % 2 = 0 UNION SELECT language FROM samples WHERE pos % 3 = 0",
    }
    return {k: sql(v) for k, v in text.items()}


QUERIES = {f.__name__: f for f in (k2_json_lines, k3_csv, p10_rename_padded, p12_all_tag_fields, s3_add_paths, t34_mime, u1_merge_exceptions)}
ORACLE_SQL = _oracles()
