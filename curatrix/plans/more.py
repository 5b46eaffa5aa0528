"""Registered queries of smaller operators, each with SQL that states its rule anew."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators import edits, filters, matching, merging, numeric, sequences, versions
from curatrix.plans.view import samples, sql
from curatrix.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str):
    """Register a query of the samples view under its function's name."""

    def add(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(samples(spark, sf_dir))
        ORACLE_SQL[fn.__name__] = sql(oracle)
        return fn

    return add


#: Words of a caption, the first twelve, and where each begins, a second a character.
_WORDS = "w AS (SELECT *, list_filter(string_split(caption, ' ')[1:12], lambda x: x <> '') AS w FROM samples)"


def _words():
    return F.filter(F.slice(F.split("caption", " ", -1), 1, 12), lambda x: x != "")


@query(r"""
, n AS (SELECT filename, regexp_replace(' la ' || genre || chr(10), '^\s+|\s+$', '', 'g') AS t FROM samples WHERE pos % 3 = 0 AND pos % 50 <> 0 AND pos % 7 > 0)
SELECT id, coalesce(t, lyrics) AS lyrics, coalesce(t, raw_lyrics) AS raw_lyrics, coalesce(t, formatted_lyrics) AS formatted_lyrics, is_instrumental AND t IS NULL AS is_instrumental FROM samples LEFT JOIN n USING (filename)""")
def p13_import_lyrics(s):
    text = F.expr("case when pos % 7 = 0 then ' ' else concat(' la ', genre, chr(10)) end")
    given = s.filter("pos % 3 = 0 and pos % 50 <> 0").select("filename", text.alias("text"))
    return edits.import_lyrics(s, given).select("id", "lyrics", "raw_lyrics", "formatted_lyrics", "is_instrumental")


def _tidy_sql(more: str) -> str:
    return f"""
, t AS (SELECT *, CASE WHEN raw_lyrics <> '' THEN raw_lyrics WHEN formatted_lyrics <> '' THEN formatted_lyrics ELSE lyrics END AS src FROM samples),
c AS (SELECT *, src <> '' AND upper(src) <> formatted_lyrics{more} AS changed FROM t)
SELECT id, changed, CASE WHEN changed THEN upper(src) ELSE formatted_lyrics END AS formatted_lyrics, CASE WHEN changed AND raw_lyrics = '' THEN src ELSE raw_lyrics END AS raw_lyrics FROM c"""


def _tidied(s, blanks):
    return edits.tidied(s, lambda c: F.struct(F.upper(c).alias("text")), blanks).select("id", "changed", "formatted_lyrics", "raw_lyrics")


@query(_tidy_sql(""))
def p15_write_back(s):
    return _tidied(s, False)


@query(_tidy_sql(" AND formatted_lyrics = ''"))
def p16_fill_blanks(s):
    return _tidied(s, True)


@query("SELECT id, CASE WHEN pos % 2 = 0 THEN genre ELSE caption END AS caption, CASE WHEN pos % 2 = 0 THEN genre ELSE lyrics END AS lyrics FROM samples")
def p19_apply_target(s):
    return merging.apply_target(s, F.col("pos") % 2 == 0, F.col("genre"), "both").select("id", "caption", "lyrics")


@query(f", {_WORDS} SELECT id, array_to_string(list_filter(w, lambda x: length(x) % 2 = 0), ',') AS hooks, true AS locked FROM w")
def p21_hooks(s):
    segments = F.transform(_words(), lambda x: F.struct(x.alias("name"), (F.length(x) % 2 == 0).alias("hook")))
    return merging.locked(s, True).select("id", F.array_join(merging.hooks(segments), ",").alias("hooks"), "locked")


@query("""
, c AS (SELECT pos, audio_path || '/' || (pos % 40) || '_part.wav' AS path, (pos % 40) || '_part.wav' AS name FROM samples),
f AS (SELECT name, min(pos) AS pos FROM c GROUP BY name)
SELECT c.pos, path, 'caption ' || name AS caption FROM c JOIN f USING (name, pos) WHERE pos % 3 > 0""")
def j12_chunk_captions(s):
    name = F.concat((F.col("pos") % 40).cast("string"), F.lit("_part.wav"))
    chunks = s.select("pos", F.concat("audio_path", F.lit("/"), name).alias("path"))
    firsts = s.filter("pos < 40 and pos % 3 > 0").select(name.alias("name"), F.concat(F.lit("caption "), name).alias("caption"))
    return merging.chunk_captions(chunks, firsts)


@query("SELECT pos, id, detected_instruments AS name FROM samples WHERE contains(lower(detected_instruments), 'vocal') AND contains(lower(detected_instruments), 'guitar') ORDER BY pos LIMIT 1")
def j14_find_algorithm(s):
    return matching.find_algorithm(s.select("pos", "id", F.col("detected_instruments").alias("name")), ["Guitar", "VOCAL"])


@query("SELECT CASE WHEN genre = ' ' THEN 'general' ELSE 'artist' END AS scope, language AS facet, pos, custom_tag AS term FROM samples WHERE genre IN ('src1', ' ')")
def j15_terms_for_artist(s):
    words = s.select(F.when(F.col("genre") != " ", F.col("genre")).alias("artist"), F.col("language").alias("facet"), "pos", F.col("custom_tag").alias("term"))
    return merging.terms_for_artist(words, "src1")


@query("""
, s AS (SELECT genre AS name, min(id) AS id FROM samples WHERE pos % 2 = 0 AND pos < 30 GROUP BY genre), l AS (SELECT genre AS name, min(id) AS id FROM samples WHERE pos % 2 = 1 GROUP BY genre)
SELECT * FROM s UNION ALL SELECT * FROM l WHERE name NOT IN (SELECT name FROM s)""")
def j17_name_to_id(s):
    of = lambda where: s.filter(where).groupBy(F.col("genre").alias("name")).agg(F.min("id").alias("id"))
    return matching.name_to_id(of("pos % 2 = 0 and pos < 30"), of("pos % 2 = 1"))


@query("""
, f AS (SELECT pos, CASE WHEN pos % 5 = 3 THEN audio_path || '_INSTRUMENTAL.wav' ELSE audio_path END AS path, bpm AS size FROM samples)
SELECT path FROM f ORDER BY contains(lower(path), 'instrumental') DESC, CASE WHEN contains(lower(path), 'instrumental') THEN 0 ELSE size END DESC, pos LIMIT 1""")
def o8_find_instrumental(s):
    path = F.expr("case when pos % 5 = 3 then concat(audio_path, '_INSTRUMENTAL.wav') else audio_path end")
    return matching.find_instrumental(s.select("pos", path.alias("path"), F.col("bpm").alias("size")))


@query("SELECT pos, id, custom_tag FROM samples QUALIFY row_number() OVER (PARTITION BY custom_tag ORDER BY pos) = 1")
def w6_first_seen(s):
    return filters.first_seen(s, F.col("custom_tag"), "pos").select("pos", "id", "custom_tag")


@query(f", {_WORDS} SELECT id, array_to_string(list_transform(w, lambda x, i: 'Part ' || i || ' (from ' || (length(x) * (i - 1)) || 's): ' || x), chr(10)) AS parts FROM w")
def w9_part_list(s):
    parts = F.transform(_words(), lambda x, i: F.struct((F.length(x) * i).cast("double").alias("start"), x.alias("text")))
    return s.select("id", sequences.part_list(parts).alias("parts"))


@query(r"SELECT id, trim(list_extract(string_split('system assistant one assistant ' || caption, 'assistant'), -1)) AS reply, starts_with(trim(CASE WHEN pos % 3 = 0 THEN ' KGAT_' || id WHEN pos % 3 = 1 THEN 'kgat_' || id END), 'KGAT_') AS token FROM samples WHERE pos % 3 < 2")
def t29_reply_t31_token(s):
    s = s.filter("pos % 3 < 2")
    token = F.expr("case when pos % 3 = 0 then concat(' KGAT_', id) else concat('kgat_', id) end")
    return s.select("id", T.extract_reply(F.concat(F.lit("system assistant one assistant "), "caption")).alias("reply"), T.is_access_token(token).alias("token"))


@query(r"""
, t AS (SELECT pos, regexp_replace(filename, '\.wav$', '.txt') AS name, CASE WHEN regexp_replace(caption, '^\s+|\s+$', '', 'g') <> '' THEN regexp_replace(caption, '^\s+|\s+$', '', 'g') ELSE trim(custom_tag) END AS text FROM (SELECT * EXCLUDE (filename), 'track_' || (pos % 400) || '.wav' AS filename FROM samples) WHERE NOT virtual)
SELECT name, arg_max(text, pos) AS text FROM t GROUP BY name""")
def k5_sidecars(s):
    return writers.sidecars(s.withColumn("audio_path", F.concat(F.lit("/m/track_"), (F.col("pos") % 400).cast("string"), F.lit(".wav"))))


@query(f""", {_WORDS}
SELECT 'song_' || id || '.lrc' AS name, CASE WHEN len(w) > 0 THEN array_to_string(list_transform(w, lambda x, i: format('[{{:02d}}:{{:02d}}.{{:02d}}]', (37 * i) // 60, (37 * i) % 60, 25 * (i % 4)) || x), chr(10)) ELSE lyrics END AS text FROM w""")
def k7_lrc_files(s):
    segments = F.transform(_words(), lambda x, i: F.struct((F.lit(37) * (i + 1) + F.lit(0.25) * ((i + 1) % 4)).cast("double").alias("start"), x.alias("text")))
    return writers.lrc_files(s.select(F.concat(F.lit("song_"), "id", F.lit(".wav")).alias("filename"), segments.alias("segments"), "lyrics"))


@query("SELECT id, CASE WHEN pos % 6 = 0 THEN 'gone' ELSE 'stays' END AS part FROM samples")
def k11_soft_delete(s):
    ids = s.filter("pos % 6 = 0").select("id")
    stays, gone = versions.soft_delete(s, ids.unionAll(ids))
    return stays.select("id", F.lit("stays").alias("part")).unionAll(gone.select("id", F.lit("gone").alias("part")))


@query("""
, f AS (SELECT genre AS base, CASE pos % 4 WHEN 0 THEN 'vocals' WHEN 1 THEN 'drums' WHEN 2 THEN 'bass' ELSE 'piano' END AS stem, CASE pos % 3 WHEN 0 THEN 'wav' WHEN 1 THEN 'flac' ELSE 'mp3' END AS kind FROM samples WHERE genre <> ' ')
SELECT base, stem AS stem_type, '/s/' || base || '_' || stem || '.' || arg_max(kind, CASE kind WHEN 'wav' THEN 1 WHEN 'flac' THEN 2 ELSE 3 END) AS path FROM (SELECT DISTINCT base, stem, kind FROM f WHERE stem <> 'piano' AND base <> 'src2') GROUP BY base, stem""")
def s14_stem_files(s):
    own = s.filter("genre <> ' '")
    path = F.expr("concat('/s/', genre, '_', case pos % 4 when 0 then 'vocals' when 1 then 'drums' when 2 then 'bass' else 'piano' end, '.', case pos % 3 when 0 then 'wav' when 1 then 'flac' else 'mp3' end)")
    return readers.stem_files(own.select(path.alias("path")), own.filter("genre <> 'src2'").select(F.col("genre").alias("base")))


@query("SELECT min(pos) AS pos, arg_min(trim(custom_tag), pos) AS term FROM samples WHERE trim(custom_tag) <> '' AND NOT starts_with(trim(custom_tag), '#') GROUP BY lower(trim(custom_tag))")
def s7_term_lines(s):
    return readers.term_lines(s.select("pos", F.concat(F.lit(" "), "custom_tag").alias("line")))


@query("""
, a AS (SELECT lower(upper(genre)) AS k, count(*) AS n FROM samples GROUP BY 1), b AS (SELECT lower(genre) AS k, -count(*) AS n FROM samples WHERE pos % 10 = 0 GROUP BY 1)
SELECT k, coalesce(b.n, a.n) AS n FROM a LEFT JOIN b USING (k)""")
def s8_overlay(s):
    count = lambda rows, key, sign: rows.groupBy(key.alias("k")).agg((sign * F.count(F.lit(1))).alias("n"))
    return readers.overlay(count(s, F.upper("genre"), 1), count(s.filter("pos % 10 = 0"), F.col("genre"), -1), "k")


@query("""
, w AS (SELECT pos, list_transform(regexp_split_to_array(substr(caption, 1, 40), ''), lambda c: (ascii(c) % 50)::DOUBLE) AS a FROM samples WHERE caption <> ''),
t AS (SELECT pos, list_transform(a, lambda x, i: x + 2 * x + (i % 7)) AS t, list_max(a) AS peak FROM w)
SELECT pos, array_to_string(list_transform(t, lambda x: (x * least(1.0::DOUBLE, CASE WHEN list_max(t) > 0 THEN 0.9 * peak / list_max(t) ELSE 1 END))::DECIMAL(12, 4)), ',') AS mix FROM t""")
def a13_no_vocals(s):
    own = s.filter("caption <> ''").withColumn("a", F.transform(F.split(F.left("caption", F.lit(40)), ""), lambda c: (F.ascii(c) % 50).cast("double")))
    parts = F.array(F.col("a"), F.transform("a", lambda x: x * 2), F.transform("a", lambda x, i: ((i + 1) % 7).cast("double")))
    mix = numeric.no_vocals(parts, F.array_max("a"))
    # rounded by the product, as SQL does it: a cast rounds the shortest decimal, which for 0.9 * 9 / 32 * 14 lies below the half
    four = lambda x: (F.floor(x * 10000 + 0.5).cast("decimal(12,0)") * F.lit(Decimal("0.0001"))).cast("decimal(12,4)").cast("string")
    return own.select("pos", F.array_join(F.transform(mix, four), ",").alias("mix"))
