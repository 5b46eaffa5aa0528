"""The registered queries over the test tables, and the SQL that DuckDB answers them by.

Inputs that the tables lack (results, decisions, sections) are derived from ``documents`` by expressions that both engines share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators import aggregates, edits, filters, matching, merging, numeric, rules, sequences, versions
from curatrix.plans.view import samples, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query of the samples view, and its SQL over the same view."""

    def add(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(samples(spark, sf_dir))
        if oracle is not None:
            ORACLE_SQL[name] = sql(oracle)
        return fn

    return add


# --- SQL fragments

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
BODY = STRIP.format(x="coalesce(caption, '')")
N_WORDS = r"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"
TAGS = r"list_filter(list_transform(string_split(split_part(body, '.', 1), ','), lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: t <> '')"
SENTENCES = rf"len(list_filter(regexp_split_to_array(CASE WHEN strpos(body, '.') > 0 THEN substr(body, strpos(body, '.') + 1) ELSE '' END, '[.!?]+'), lambda s: {N_WORDS.format(x='s')} >= 3))"
VOCAL = "|".join(sorted(rules.VOCAL_TERMS))
#: pos, issue: the codes of every caption's issues.
ISSUES = rf"""
b AS (SELECT pos, body, regexp_extract_all(lower(body), '[A-Za-z'']+') AS w FROM (SELECT pos, {BODY} AS body FROM samples)),
m AS (SELECT pos, body, len({TAGS}) AS tags, {SENTENCES} AS sentences, {N_WORDS.format(x="body")} AS words,
  coalesce(list_max(map_values(list_histogram(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))), 0) AS gram
  FROM b),
u AS (SELECT pos, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM b),
rn AS (SELECT pos, max(n) AS run FROM (SELECT pos, count(*) AS n FROM (SELECT pos, x, i - row_number() OVER (PARTITION BY pos, x ORDER BY i) AS k FROM u) GROUP BY pos, x, k) GROUP BY pos),
lists AS (SELECT pos, CASE WHEN body = '' THEN ['empty'] ELSE list_filter([
  CASE WHEN tags < 5 THEN 'few_tags:' || tags WHEN tags > 15 THEN 'many_tags:' || tags END,
  CASE WHEN NOT regexp_matches(lower(body), '{VOCAL}') THEN 'no_vocal_term' END,
  CASE WHEN regexp_matches(body, '{rules.HEADING}') THEN 'heading' END, CASE WHEN regexp_matches(body, '{rules.MARKDOWN}') THEN 'markdown' END,
  CASE WHEN regexp_matches(body, '{rules.BPM}') THEN 'bpm' END, CASE WHEN regexp_matches(body, '{rules.TIME_SIGNATURE}') THEN 'time_signature' END,
  CASE WHEN regexp_matches(body, '{rules.KEY}') THEN 'key' END,
  CASE WHEN sentences < 2 THEN 'few_sentences:' || sentences WHEN sentences > 3 THEN 'many_sentences:' || sentences END,
  CASE WHEN words > 120 THEN 'many_words:' || words END, CASE WHEN length(body) > 900 THEN 'many_chars:' || length(body) END,
  CASE WHEN gram >= 3 THEN 'ngram_repeat:' || gram END, CASE WHEN run >= 5 THEN 'word_run:' || run END], lambda x: x IS NOT NULL) END AS list FROM m LEFT JOIN rn USING (pos)),
issues AS (SELECT pos, split_part(unnest(list), ':', 1) AS issue FROM lists)"""

# --- rules


@query("flagship_dataset_report", f", {ISSUES} SELECT issue, count(*) AS n FROM issues GROUP BY issue")
def _(s):
    return rules.caption_report(s)


@query("v1_caption_issues", f", {ISSUES} SELECT pos, array_to_string(list, ',') AS issues, len(list)::BIGINT AS n FROM lists")
def _(s):
    return s.select("pos", rules.caption_issues(F.col("caption")).alias("c")).select("pos", F.array_join("c", ",").alias("issues"), F.size("c").cast("long").alias("n"))


@query("v2_manifest_issues", f""", {ISSUES}
SELECT pos, 'caption:' || issue AS issue FROM (SELECT pos, unnest(list) AS issue FROM lists) WHERE issue <> 'empty' UNION ALL SELECT pos, 'no_caption' FROM lists WHERE list = ['empty']
UNION ALL SELECT pos, 'instrumental_with_lyrics' FROM samples WHERE is_instrumental AND (lyrics <> '' OR formatted_lyrics <> '')
UNION ALL SELECT pos, 'bpm_out_of_range:' || bpm FROM samples WHERE bpm <> 0 AND NOT bpm BETWEEN 1 AND 300 UNION ALL SELECT -1, 'metadata_missing:' || unnest(['custom_tag', 'tag_position'])""")
def _(s):
    return rules.manifest_issues(s, ["name", "num_samples"]).withColumn("pos", F.coalesce("pos", F.lit(-1)))


_GAPS = rf""", {ISSUES},
gap AS (SELECT pos, filename, list_concat(list_filter([
  CASE WHEN len(m) > 0 THEN 'missing:' || array_to_string(m, '/') END, CASE WHEN trim(language) = '' THEN 'no_language' END,
  CASE WHEN is_instrumental AND lyrics <> '' THEN 'instrumental_with_lyrics' END, CASE WHEN NOT is_instrumental AND lyrics = '' THEN 'no_lyrics' END,
  CASE WHEN lyrics <> '' AND NOT contains(lyrics, '[') THEN 'no_sections' END], lambda x: x IS NOT NULL), CASE WHEN {BODY} = '' THEN [] ELSE list_transform(list, lambda x: 'caption:' || x) END, [CASE WHEN virtual THEN 'virtual' ELSE 'audio_missing' END]) AS issues
FROM (SELECT *, list_filter([CASE WHEN trim(caption) = '' THEN 'caption' END, CASE WHEN trim(genre) = '' THEN 'genre' END, CASE WHEN bpm = 0 THEN 'bpm' END, CASE WHEN trim(keyscale) = '' THEN 'keyscale' END, CASE WHEN trim(language) = '' THEN 'language' END], lambda x: x IS NOT NULL) AS m FROM samples) JOIN lists USING (pos))"""


@query("v3_gaps", f"{_GAPS} SELECT pos, filename, array_to_string(issues, '; ') AS issues FROM gap")
def _(s):
    return rules.gaps(s).select("pos", "filename", F.array_join("issues", "; ").alias("issues"))


@query("g7_gap_totals", f"{_GAPS} SELECT count(*) AS tracks, count(*) FILTER (len(issues) = 0) AS clean, count(*) FILTER (len(issues) > 0) AS with_gaps FROM gap")
def _(s):
    return aggregates.gap_totals(rules.gaps(s))


_INSTRUMENTS = "[" + ", ".join(f"'{i}'" for i in rules.INSTRUMENTS) + "]"


@query("v4_caption_audit", f", {ISSUES} SELECT pos, filename, CASE WHEN {BODY} <> '' THEN array_to_string(list_filter({_INSTRUMENTS}, lambda i: contains(lower(caption), i)), ',') END AS instruments, CASE WHEN {BODY} <> '' THEN array_to_string(list, ',') END AS issues FROM samples JOIN lists USING (pos)")
def _(s):
    return rules.audit(s).select("pos", "filename", F.array_join("instruments", ",").alias("instruments"), F.array_join("issues", ",").alias("issues"))


@query("g6_casing_variants", rf"""
SELECT lower(t) AS instrument, string_agg(DISTINCT t, ',' ORDER BY t) AS variants FROM (SELECT unnest(regexp_extract_all(caption, '\b[A-Za-z][A-Za-z0-9'' -]{{2,}}\b')) AS t FROM samples)
WHERE list_contains({_INSTRUMENTS}, lower(t)) GROUP BY lower(t) HAVING count(DISTINCT t) > 1""")
def _(s):
    return rules.casing_variants(s).select("instrument", F.array_join("variants", ",").alias("variants"))


@query("g12_max_ngram_repeat", r"""
, w AS (SELECT pos, regexp_extract_all(lower(caption), '[A-Za-z'']+') AS w FROM samples)
SELECT pos, coalesce(list_max(map_values(list_histogram(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))), 0)::INTEGER AS n FROM w""")
def _(s):
    return s.select("pos", rules.max_ngram_repeat(F.col("caption"))["n"].alias("n"))


@query("w3_max_consecutive_repeat", r"""
, w AS (SELECT pos, regexp_extract_all(lower(caption), '[A-Za-z'']+') AS w FROM samples),
u AS (SELECT pos, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT pos, x, i - row_number() OVER (PARTITION BY pos, x ORDER BY i) AS k FROM u),
c AS (SELECT pos, count(*) AS n FROM g GROUP BY pos, x, k)
SELECT samples.pos, coalesce(max(n), 1)::INTEGER AS n FROM samples LEFT JOIN c ON c.pos = samples.pos GROUP BY samples.pos""")
def _(s):
    return s.select("pos", rules.max_consecutive_repeat(F.col("caption"))["n"].alias("n"))


_SYLLABLES = "coalesce(list_sum(list_transform(regexp_extract_all(lower({x}), '[a-z0-9'']+'), lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+'))))), 0)::INTEGER"


@query("v6_flagged_lines", f"""
, l AS (SELECT pos, string_split(concat(lyrics, chr(10), caption), chr(10)) AS l FROM samples), u AS (SELECT pos, unnest(l) AS line, (generate_subscripts(l, 1) - 1)::INTEGER AS line_no FROM l),
c AS (SELECT pos, line_no, {_SYLLABLES.format(x="line")} AS syllables FROM u WHERE trim(line) <> '' AND NOT starts_with(trim(line), '['))
SELECT pos, line_no, syllables, syllables BETWEEN 6 AND 10 AS in_range, syllables > 12 AS flagged FROM c""")
def _(s):
    s = s.withColumn("lyrics", F.expr("concat(lyrics, chr(10), caption)"))
    return rules.flag_lines(s).select("pos", "line_no", "syllables", "in_range", "flagged")


# --- filters

_FIND = "contains(lower(concat_ws(' ', filename, caption, custom_tag, genre, keyscale, lyrics, formatted_lyrics)), '{q}')"


@query("f1_search", f"SELECT id FROM samples WHERE {_FIND.format(q='drums src1')}")
def _(s):
    return s.filter(filters.matches("drums SRC1")).select("id")


@query("f2_filter", "SELECT id FROM samples WHERE is_instrumental AND caption <> '' AND contains(lower(concat_ws(' ', filename, caption, custom_tag, genre, keyscale, lyrics, formatted_lyrics)), 'song')")
def _(s):
    return s.filter(filters.shown("song", "instrumental", True)).select("id")


@query("f3_exceptions", "SELECT id FROM samples WHERE caption = ''")
def _(s):
    return s.filter(filters.is_exception()).select("id")


@query("f4_missing_captions", f"SELECT id FROM samples WHERE {BODY} = ''")
def _(s):
    return s.filter(filters.is_missing_caption()).select("id")


@query("f6_for_export", "SELECT id FROM samples WHERE NOT virtual")
def _(s):
    return filters.for_export(s).select("id")


@query("f7_vocal_scope", "SELECT id FROM samples WHERE NOT is_instrumental")
def _(s):
    return filters.lyric_scope(s, "vocal").select("id")


@query("f8_last_run", "SELECT id FROM samples WHERE pos % 10 IN (1, 3)")
def _(s):
    return filters.lyric_scope(s, "selected", s.filter("pos % 10 in (1, 3)")).select("id")


@query("f9_track_numbers", "SELECT id FROM samples WHERE pos + 1 IN (2, 3, 4, 7, 9, 11)")
def _(s):
    return s.filter((F.col("pos") + 1).isin(filters.parse_numbers("4-2, 9 7 11"))).select("id")


@query("f14_placeholder", "SELECT id, pos % 4 IN (0, 1) AS placeholder FROM samples")
def _(s):
    return s.select("id", filters.is_placeholder(F.expr("case pos % 4 when 0 then 'Local Rule Engine' when 1 then 'DeepSeek Cloud' when 2 then 'Gemini' end")).alias("placeholder"))


@query("f10_resolve_refs", """
, refs AS (SELECT unnest(['dup.wav', '3', ' 0', 'nothing', '99999999', '07-Artist - song 7.wav']) AS ref), n AS (SELECT count(*) AS n FROM samples),
nm AS (SELECT filename, min(pos) AS p FROM samples GROUP BY filename)
SELECT ref, coalesce(p, CASE WHEN regexp_matches(trim(ref), '^[0-9]+$') THEN CASE WHEN trim(ref)::BIGINT BETWEEN 1 AND n THEN trim(ref)::BIGINT - 1 WHEN trim(ref)::BIGINT = 0 THEN 0 END END) AS pos
FROM refs CROSS JOIN n LEFT JOIN nm ON trim(ref) = filename""")
def _(s):
    refs = s.sparkSession.createDataFrame([(r,) for r in ("dup.wav", "3", " 0", "nothing", "99999999", "07-Artist - song 7.wav")], "ref string")
    return filters.resolve(s, refs)


_LYRICS = "coalesce(nullif(formatted_lyrics, ''), lyrics)"


@query("f11_over_limit", f"SELECT id, greatest(0, ceil(length({_LYRICS}) / 3.7::DOUBLE)::INTEGER - 10) AS over_by FROM samples WHERE ceil(length({_LYRICS}) / 3.7::DOUBLE) > 10")
def _(s):
    return s.filter(filters.over_limit(10)).select("id", T.over_by(T.estimate_tokens(T.first_of(F.col("formatted_lyrics"), F.col("lyrics"))), 10).alias("over_by"))


#: Owners to try, by the place in the list; accounts are made of the track's own fields.
_SLUG = "case pos % 16 when 0 then 'me/my-weights' when 1 then 'You/x' when 2 then ' someone / x ' when 3 then 'Owner/x' when 4 then 'your_username/x' when 5 then 'your-name/x' when 6 then concat(genre, '/', id, '/x') when 7 then concat('/', id) when 8 then concat(genre, '/ ') when 9 then ' ' when 10 then null when 11 then genre when 12 then 'yourname/x' when 13 then 'example/a' else concat(genre, '-', language, '/', id) end"


@query("f12_slug_problems", f"""
, x AS (SELECT id, string_split(trim({_SLUG}), '/') AS p FROM samples)
SELECT id, CASE WHEN p IS NULL OR p = [''] THEN NULL WHEN len(p) <> 2 OR trim(p[1]) = '' OR trim(p[2]) = '' THEN 'must be owner/slug'
  WHEN lower(trim(p[1])) IN ('me', 'you', 'user', 'owner', 'username', 'your-username', 'yourname', 'someone', 'example') THEN 'placeholder owner' END AS problem FROM x""")
def _(s):
    return s.select("id", T.slug_problem(F.expr(_SLUG)).alias("problem"))


# --- projections


@query("p1_normalize", "SELECT id, CASE WHEN raw_lyrics <> '' OR lyrics <> '' THEN false ELSE is_instrumental END AS is_instrumental FROM samples")
def _(s):
    return edits.normalize(s).select("id", "is_instrumental")


@query("p2_export", "SELECT id, audio_path, filename, caption, genre, lyrics, raw_lyrics, formatted_lyrics, bpm, keyscale, timesignature, duration, language, is_instrumental, custom_tag, false AS labeled, CASE WHEN prompt_override IN ('caption', 'genre') THEN prompt_override END AS prompt_override FROM samples WHERE NOT virtual")
def _(s):
    return edits.to_export(filters.for_export(s))


@query("p4_instrumental_mode", "SELECT CASE WHEN count(*) > 0 AND count(*) = count(*) FILTER (NOT is_instrumental) THEN 'no_instrumentals' ELSE 'mixed' END AS instrumental_mode FROM samples")
def _(s):
    return edits.instrumental_mode(s, False)


@query("p5_language_choice", "SELECT id, CASE WHEN pos % 4 = 0 THEN '' ELSE language END AS language, pos % 4 = 0 AS is_instrumental FROM samples")
def _(s):
    return edits.choose_language(s, F.when(F.col("pos") % 4 == 0, "instrumental").otherwise(F.col("language"))).select("id", "language", "is_instrumental")


@query("p6_set_field", "SELECT id, CASE WHEN pos % 3 = 0 THEN CASE pos % 2 WHEN 0 THEN 128 ELSE 0 END ELSE bpm END::BIGINT AS bpm FROM samples")
def _(s):
    return edits.set_field(s, F.col("pos") % 3 == 0, "bpm", F.when(F.col("pos") % 2 == 0, "128.9").otherwise("fast")).select("id", "bpm")


@query("p7_parse_clock", "SELECT id, CASE pos % 5 WHEN 0 THEN 0 WHEN 1 THEN 125 WHEN 2 THEN 3725 WHEN 3 THEN 2 ELSE NULL END::INTEGER AS seconds FROM samples")
def _(s):
    x = F.expr("case pos % 5 when 0 then ' ' when 1 then '2:05' when 2 then '1:02:05' when 3 then '2.5s' else 'x:1' end")
    return s.select("id", T.parse_clock(x).alias("seconds"))


@query("p9_find_replace", "SELECT id, replace(caption, 'the', 'THE') AS caption, replace(custom_tag, 'the', 'THE') AS custom_tag, (contains(caption, 'the')::INTEGER + contains(custom_tag, 'the')::INTEGER) AS n_fields FROM samples")
def _(s):
    return edits.replace_text(s, "the", "THE").select("id", "caption", "custom_tag", "n_fields")


@query("p10_rename_song", r"""
, b AS (SELECT id, pos, regexp_replace(regexp_replace(filename, '\.[^.]*$', ''), '^\s*\d{1,3}\s*[-._]\s*', '') AS b FROM samples),
t AS (SELECT id, pos, trim(regexp_replace(string_split(b, ' - ')[-1], '\s+', '_', 'g'), '_') || '.wav' AS n FROM b)
SELECT id, CASE WHEN row_number() OVER (PARTITION BY n ORDER BY pos) = 1 THEN n END AS new_name FROM t""")
def _(s):
    return edits.renamed(s, "song").select("id", "new_name")


@query("p10_rename_replace", """
, t AS (SELECT id, pos, CASE WHEN contains(filename, 'song 1') THEN replace(filename, 'song 1', 'Song') END AS n FROM samples)
SELECT id, CASE WHEN n IS NOT NULL AND row_number() OVER (PARTITION BY n ORDER BY pos) = 1 THEN n END AS new_name FROM t""")
def _(s):
    return edits.renamed(s, "replace", "song 1", "Song").select("id", "new_name")


@query("p10_rename_number", "SELECT id, 'Take ' || (4 + row_number() OVER (ORDER BY pos)) || '.wav' AS new_name FROM samples")
def _(s):
    return edits.renamed(s, "number", "Take {n}", start=5).select("id", "new_name")


_SPLIT = "list_filter(list_transform(regexp_split_to_array(custom_tag, '[,;|/]'), lambda t: trim(t)), lambda t: t <> '')"


@query("p11_add_remove_tag", f"""
SELECT id, array_to_string(CASE WHEN list_contains(list_transform({_SPLIT}, lambda t: lower(t)), 'guitar') THEN {_SPLIT} ELSE list_append({_SPLIT}, 'Guitar') END, ', ') AS added,
  array_to_string(list_filter({_SPLIT}, lambda t: lower(t) <> 'bass'), ', ') AS removed FROM samples""")
def _(s):
    return s.select("id", edits.add_tag(F.col("custom_tag"), " Guitar").alias("added"), edits.remove_tag(F.col("custom_tag"), "Bass").alias("removed"))


_ALIAS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.ALIASES.items()) + "}"
_CANON = "[" + ", ".join(f"'{c}'" for c in T.CANONICAL) + "]"
_LOW = "lower(trim(@))"


def _norm(t: str) -> str:
    """SQL of normalize_instrument."""
    out = f"coalesce({_ALIAS}[{_LOW}], CASE WHEN {_LOW} LIKE '%s' THEN coalesce({_ALIAS}[{_LOW}[:-2]], CASE WHEN list_contains({_CANON}, {_LOW}[:-2]) THEN {_LOW}[:-2] END) END, {_LOW})"
    return out.replace("@", t)




@query("p12_normalize_tags", f"SELECT id, array_to_string(list_transform({_SPLIT}, lambda t: {_norm('t')}), ', ') AS tags FROM samples")
def _(s):
    return s.select("id", edits.normalize_tags(F.col("custom_tag")).alias("tags"))


@query("p15_tidy")
def _(s):
    from curatrix.functions.lyrics import normalize_lyrics

    return edits.tidied(s, normalize_lyrics).select("id", "changed", "formatted_lyrics", "raw_lyrics", *[F.col(f"_tidy.{c}").alias(c) for c in ("contractions", "tags", "quotes", "tags_trimmed", "tags_dropped", "lines_changed")])


@query("g8_tidy_totals")
def _(s):
    from curatrix.functions.lyrics import normalize_lyrics

    return aggregates.tidy_totals(edits.tidied(s, normalize_lyrics))


_DECIDED = "case pos % 4 when 0 then 'keep' when 1 then 'use' when 2 then 'edit' end"


@query("p17_decisions", f"""
, d AS (SELECT *, {_DECIDED} AS d, CASE WHEN {_DECIDED} = 'edit' THEN 'edited by hand' WHEN {_DECIDED} = 'use' THEN trim(caption_ai_raw) ELSE '' END AS t, {BODY} AS was FROM samples)
SELECT id, md5(CASE WHEN {STRIP.format(x="t")} <> '' AND NOT upper(t) LIKE 'ERROR:%' THEN {STRIP.format(x="t")} ELSE caption END) AS caption_md5,
  md5(CASE WHEN {STRIP.format(x="t")} <> '' AND NOT upper(t) LIKE 'ERROR:%' AND was <> '' AND was <> {STRIP.format(x="t")} THEN was END) AS before_md5 FROM d""")
def _(s):
    decisions = s.select("id", F.col("caption_ai_raw").alias("proposed"), F.expr(_DECIDED).alias("decision"), F.lit("edited by hand").alias("edited"))
    out = edits.apply_decisions(s, decisions)
    return out.select("id", F.md5(F.col("caption").cast("binary")).alias("caption_md5"), F.md5(F.col("caption_before").cast("binary")).alias("before_md5"))


@query("p18_merge_analysis", "SELECT id, CASE WHEN pos % 2 = 0 THEN 77 ELSE bpm END AS bpm, CASE WHEN pos % 3 = 0 THEN 'D minor' ELSE keyscale END AS keyscale FROM samples")
def _(s):
    found = s.select("id", F.expr("cast(case when pos % 2 = 0 then 77 else 0 end as bigint)").alias("bpm"), F.expr("case when pos % 3 = 0 then 'D minor' else '' end").alias("keyscale"))
    return edits.merge_analysis(s, found).select("id", "bpm", "keyscale")


_KINDS = "case pos % 4 when 0 then 'instruments' when 1 then 'Concise Tags' when 2 then 'Deep Structural Breakdown' else 'Balanced' end"


@query("p24_rule_captions", """
SELECT id, CASE WHEN trim(custom_tag) <> '' THEN trim(custom_tag) || ', ' ELSE '' END || CASE pos % 4 WHEN 0 THEN 'acoustic guitar, electric bass, drums, keyboard, vocals'
  WHEN 1 THEN 'dynamic acoustic profile, defined instrumentation, expressive performance'
  WHEN 2 THEN 'A comprehensive full-song arrangement. Opens with an iconic melodic motif, building texture through the verses with dynamic rhythm shifts. Bridges introduce emotional climax and solo leads before resolving in a tight, resonant outro.'
  ELSE 'balanced musical arrangement, organic dynamic response, defined lead instruments' END AS caption FROM samples""")
def _(s):
    return s.select("id", edits.rule_caption(F.expr(_KINDS), F.col("custom_tag")).alias("caption"))


@query("p26_context", r"""
, x AS (SELECT *, array_to_string(list_filter(list_transform(string_split(detected_instruments, ','), lambda t: trim(t)), lambda t: t <> ''), ', ') AS ins, regexp_replace(coalesce(nullif(lyrics, ''), formatted_lyrics), '^\s+|\s+$', '', 'g') AS ly FROM samples)
SELECT id, concat_ws(chr(10), 'Track: ' || filename, 'Genre: ' || nullif(genre, ''), CASE WHEN bpm <> 0 THEN 'BPM: ' || bpm END, 'Key: ' || nullif(keyscale, ''), 'Instruments: ' || nullif(ins, ''),
  'Existing caption: ' || nullif(left(caption, 300), ''), CASE WHEN pos % 3 = 0 THEN 'Sections: Verse 0.0-9.5s, Chorus 9.5-20.0s' END, CASE WHEN pos % 5 = 0 THEN 'Hooks/riffs to emphasize: Chorus, Outro' END,
  CASE WHEN pos % 7 = 0 THEN 'Riff note: slow' END, 'LYRICS:' || chr(10) || nullif(left(ly, 2000), '')) AS context FROM x""")
def _(s):
    segments = F.expr("if(pos % 3 = 0, array(named_struct('name', 'Verse', 'start', 0.0D, 'end', 9.5D), named_struct('name', 'Chorus', 'start', 9.5D, 'end', 20.0D)), null)")
    own = s.withColumns({"structural_segments": segments, "hooks": F.expr("if(pos % 5 = 0, array('Chorus', 'Outro'), array())"), "riff_note": F.expr("if(pos % 7 = 0, 'slow', '')")})
    return own.select("id", edits.context(own).alias("context"))


@query("p27_list_tracks", "SELECT pos, filename, left(caption, 80) AS preview FROM samples")
def _(s):
    return s.select("pos", "filename", F.left("caption", F.lit(80)).alias("preview"))


@query("p27_summary", "(SELECT pos, filename FROM samples ORDER BY pos LIMIT 12) UNION ALL (SELECT NULL, '… ' || (count(*) - 12) || ' more' FROM samples HAVING count(*) > 12)")
def _(s):
    from curatrix.plans import tools

    return tools.summary_rows(s)


# --- joins

_RESULT = "SELECT pos, case pos % 4 when 0 then concat('/out/', filename) when 1 then concat(regexp_replace(filename, '\\.wav$', ''), '.mp3') else regexp_replace(filename, '\\.wav$', '') end AS file, case pos % 5 when 0 then 'ERROR: x' when 1 then '' when 2 then caption else 'fresh caption' end AS caption FROM samples WHERE pos % 3 <> 0"
_LAST = f"res AS ({_RESULT}), last AS (SELECT string_split(file, '/')[-1] AS name, arg_max(caption, pos) AS caption FROM res GROUP BY 1)"
_STEM = r"regexp_replace(filename, '\.[^.]*$', '')"
_KEYS = f"keys AS (SELECT pos, filename AS name, 0 AS p FROM samples UNION ALL SELECT pos, {_STEM} || '.mp3', 1 FROM samples UNION ALL SELECT pos, {_STEM}, 2 FROM samples)"


def _results(s: DataFrame) -> DataFrame:
    file = F.expr(r"case pos % 4 when 0 then concat('/out/', filename) when 1 then concat(regexp_replace(filename, r'\.wav$', ''), '.mp3') else regexp_replace(filename, r'\.wav$', '') end")
    caption = F.expr("case pos % 5 when 0 then 'ERROR: x' when 1 then '' when 2 then caption else 'fresh caption' end")
    return matching.last_results(s.filter("pos % 3 <> 0").select("pos", file.alias("file"), caption.alias("caption")))


_DIFF = f""", {_LAST}, {_KEYS}, best AS (SELECT keys.pos, arg_min(caption, p) AS proposed FROM keys JOIN last USING (name) GROUP BY keys.pos),
diff AS (SELECT id, {BODY} AS existing, {STRIP.format(x="coalesce(proposed, '')")} AS proposed FROM samples LEFT JOIN best USING (pos)),
st AS (SELECT id, proposed, CASE WHEN upper(proposed) LIKE 'ERROR:%' THEN 'error' WHEN proposed = '' THEN 'missing' WHEN existing = '' THEN 'new' WHEN existing = proposed THEN 'same' ELSE 'changed' END AS status FROM diff)"""


@query("j1_diff_captions", f"{_DIFF} SELECT id, md5(proposed) AS proposed_md5, status FROM st")
def _(s):
    return matching.diff_captions(s, _results(s)).select("id", F.md5(F.col("proposed").cast("binary")).alias("proposed_md5"), "status")


@query("g4_count_by_status", f"{_DIFF} SELECT status, count(*) AS n FROM st GROUP BY status")
def _(s):
    return aggregates.by_status(matching.diff_captions(s, _results(s)))


@query("f5_bad_captions", f"{_DIFF} SELECT samples.id FROM samples JOIN st USING (id) WHERE {BODY} = '' OR upper(ltrim(caption_ai_raw)) LIKE 'ERROR:%' OR status IN ('missing', 'error')")
def _(s):
    return filters.bad_captions(s, matching.diff_captions(s, _results(s))).select("id")


@query("j2_unmatched_results", f", {_LAST}, {_KEYS} SELECT name FROM last WHERE name NOT IN (SELECT name FROM keys JOIN samples USING (pos) WHERE pos % 2 = 0)")
def _(s):
    return matching.unmatched_results(s.filter("pos % 2 = 0"), _results(s))


@query("j3_own_proposals", f", x AS (SELECT id, {BODY} AS existing, {STRIP.format(x='caption_ai_raw')} AS p FROM samples) SELECT id, CASE WHEN upper(p) LIKE 'ERROR:%' THEN 'error' WHEN p = '' THEN 'missing' WHEN existing = '' THEN 'new' WHEN existing = p THEN 'same' ELSE 'changed' END AS status FROM x")
def _(s):
    own = s.withColumn("filename", F.concat("id", F.lit(".wav")))
    return matching.diff_captions(own, own.select(F.col("filename").alias("name"), F.col("caption_ai_raw").alias("caption"))).select("id", "status")


@query("j4_write_back", ", blk AS (SELECT filename, 'new ' || min(id) AS t FROM samples WHERE pos % 2 = 0 GROUP BY filename) SELECT id, coalesce(t, lyrics) AS lyrics, CASE WHEN t IS NOT NULL AND raw_lyrics = '' THEN lyrics ELSE raw_lyrics END AS raw_lyrics FROM samples LEFT JOIN blk USING (filename)")
def _(s):
    blocks = s.filter("pos % 2 = 0").groupBy("filename").agg(F.concat(F.lit("new "), F.min("id")).alias("text"))
    return matching.write_back(s, blocks).select("id", "lyrics", "raw_lyrics")


@query("j5_import_rows", ", ids AS (SELECT DISTINCT trim(x) AS song_id FROM (SELECT 'ONG ' || pos AS x FROM samples WHERE pos % 5 = 0 UNION ALL SELECT unnest([' ', 'dup', 'none', 'g 1', ' 7.wav']))) SELECT song_id, min(pos) AS pos FROM ids JOIN samples ON song_id <> '' AND contains(lower(filename), lower(song_id)) GROUP BY song_id")
def _(s):
    fixed = s.sparkSession.createDataFrame([(x,) for x in (" ", "dup", "none", "g 1", " 7.wav")], "song_id string")
    return matching.import_rows(s, s.filter("pos % 5 = 0").select(F.concat(F.lit("ONG "), "pos").alias("song_id")).unionAll(fixed))


_SONG_NAME = "replace(lower(concat(split_part(filename, ' - ', 2), CASE pos % 6 WHEN 0 THEN ' T.N.T.' WHEN 1 THEN ' Iron_Man live' WHEN 2 THEN ' the WIZARD of paranoid' WHEN 3 THEN ' voodoo child' ELSE '' END)), '_', ' ')"
_SONG_ROWS = ", ".join(f"({k}, '{name}', '{','.join(found)}')" for k, (name, found) in enumerate(matching.SONG_INSTRUMENTS.items()))


@query("j6_lookup_instruments", f", t(p, name, found) AS (VALUES {_SONG_ROWS}) SELECT id, coalesce(arg_min(found, p), '') AS instruments FROM samples LEFT JOIN t ON contains({_SONG_NAME}, name) GROUP BY id")
def _(s):
    name = F.concat(F.coalesce(F.get(F.split("filename", " - "), F.lit(1)), F.lit("")), F.expr("case pos % 6 when 0 then ' T.N.T.' when 1 then ' Iron_Man live' when 2 then ' the WIZARD of paranoid' when 3 then ' voodoo child' else '' end"))
    return s.select("id", F.array_join(matching.lookup_instruments(name, F.lit(""), matching.SONG_INSTRUMENTS), ",").alias("instruments"))


_MODEL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in matching.MODELS.items()) + "}"


@query("j7_recommend_models", f"""
, i AS (SELECT id, unnest(string_split(detected_instruments, ',')) AS t, unnest(range(1, len(string_split(detected_instruments, ',')) + 1)) AS p FROM samples),
m AS (SELECT id, p, coalesce({_MODEL}[k], CASE WHEN k LIKE '%s' THEN {_MODEL}[k[:-2]] END) AS model FROM (SELECT id, p, {_norm("t")} AS k FROM i)),
f AS (SELECT id, model, min(p) AS p FROM m WHERE model IS NOT NULL GROUP BY id, model)
SELECT samples.id, coalesce(string_agg(model, ',' ORDER BY p), '') AS models FROM samples LEFT JOIN f ON f.id = samples.id GROUP BY samples.id""")
def _(s):
    return s.select("id", F.array_join(matching.recommend(F.split("detected_instruments", ",")), ",").alias("models"))


@query("j8_models_in_caption", f"SELECT id, array_to_string(list_sort(list_distinct(map_values(map_from_entries(list_filter(map_entries({_MODEL}), lambda e: contains(lower(caption), e.key)))))), ',') AS models FROM samples")
def _(s):
    return s.select("id", F.array_join(matching.models_in_caption(F.col("caption")), ",").alias("models"))


_ARTISTS = ("The Doors", "Black Sabbath", "Hank Williams Sr.", "AC/DC", "Black Harbor", "The Quiet Ones")
_ASKED = "case pos % 8 when 0 then 'Doorsdata' when 1 then 'hank_sr' when 2 then 'sabbath' when 3 then 'acdc' when 4 then 'Nirvana' when 5 then 'the black doors' when 6 then genre else ' ' end"


@query("j9_resolve_artist", f"""
, a(p, artist) AS (VALUES {", ".join(f"({k}, '{a}')" for k, a in enumerate(_ARTISTS))}), q AS (SELECT DISTINCT {_ASKED} AS asked FROM samples), k AS (SELECT asked, regexp_replace(lower(asked), '[^a-z0-9]', '', 'g') AS k FROM q),
e AS (SELECT asked, arg_min(artist, p) AS x FROM k JOIN a ON k <> '' AND k = regexp_replace(lower(artist), '[^a-z0-9]', '', 'g') GROUP BY asked),
w AS (SELECT p, artist, unnest(regexp_extract_all(lower(artist), '[a-z0-9]+')) AS w FROM a), n AS (SELECT asked, arg_min(artist, p) AS y FROM k JOIN w ON len(w) >= 4 AND contains(k, w) GROUP BY asked)
SELECT asked, coalesce(x, y) AS artist FROM k LEFT JOIN e USING (asked) LEFT JOIN n USING (asked)""")
def _(s):
    artists = s.sparkSession.createDataFrame(list(enumerate(_ARTISTS)), "pos int, artist string")
    return matching.resolve_artist(artists, s.select(F.expr(_ASKED).alias("asked")).distinct())


@query("j16_stem_sections", "SELECT pos, k AS stem_type, 'part ' || (p % 3 + 1) AS section FROM samples, (SELECT unnest(['drums', 'vocals']) AS k), (SELECT unnest(range(3)) AS p)")
def _(s):
    rows = s.select("pos", F.expr("map('drums', 'd.wav', 'vocals', 'v.wav')").alias("stems"), F.expr("array('part 1', 'part 2', 'part 3')").alias("sections"))
    return matching.stem_sections(rows).select("pos", "stem_type", "section")


# --- aggregates


@query("g1_summary", f"""
, r AS (SELECT is_instrumental AS i, nullif(bpm, 0) AS b, nullif(duration, 0) AS d, CASE WHEN body <> '' THEN {N_WORDS.format(x="body")} END AS w FROM (SELECT *, {BODY} AS body FROM samples))
SELECT count(*) AS tracks, count(*) FILTER (NOT i) AS vocal, count(*) FILTER (i) AS instrumental, count(w) AS captioned, min(b) AS bpm_min, max(b) AS bpm_max, floor(avg(b))::BIGINT AS bpm_mean,
  min(d) AS duration_min, max(d) AS duration_max, round_even(avg(d), 0) AS duration_mean, min(w)::BIGINT AS words_min, max(w)::BIGINT AS words_max, round_even(avg(w), 0) AS words_mean FROM r""")
def _(s):
    return aggregates.summary(s)


_TOP = "(SELECT '{k}' AS kind, v AS value, count(*) AS n FROM ({q}) GROUP BY v ORDER BY n DESC, min(pos) LIMIT {m})"
_GENRE = "SELECT pos, trim(genre) AS v FROM samples WHERE trim(genre) <> ''"
_KEY = "SELECT pos, keyscale AS v FROM samples WHERE keyscale <> ''"
_INST = "SELECT pos, trim(t) AS v FROM (SELECT pos, unnest(string_split(detected_instruments, ',')) AS t FROM samples) WHERE trim(t) <> ''"


@query("g1_report", "\nUNION ALL ".join(_TOP.format(k=k, q=q, m=m) for k, q, m in (("genre", _GENRE, 8), ("key", _KEY, 6), ("instrument", _INST, 8))))
def _(s):
    return aggregates.report(s)


_COUNTS = """
SELECT 'count' AS kind, unnest(['tracks', 'vocal', 'instrumental', 'captioned', 'bpm_min', 'bpm_max']) AS value, unnest([tracks, vocal, instrumental, captioned, low, high])::BIGINT AS n FROM
 (SELECT count(*) AS tracks, count(*) FILTER (NOT is_instrumental) AS vocal, count(*) FILTER (is_instrumental) AS instrumental, count(*) FILTER (regexp_matches(caption, '\\S')) AS captioned, min(bpm) FILTER (bpm <> 0) AS low, max(bpm) FILTER (bpm <> 0) AS high FROM samples)
UNION ALL """


@query("g2_sound_profile", _COUNTS + "\nUNION ALL ".join(_TOP.format(k=k, q=q, m=m) for k, q, m in (("genre", _GENRE, 6), ("key", _KEY, 5), ("instrument", _INST, 8))))
def _(s):
    return aggregates.sound_profile(s)


_ALL_TAGS = "t AS (SELECT pos, filename, lower(trim(x)) AS tag FROM (SELECT pos, filename, unnest(list_concat(string_split(detected_instruments, ','), regexp_split_to_array(custom_tag, '[,;|/]'), regexp_split_to_array(genre, '[,;|/]'))) AS x FROM samples) WHERE trim(x) <> '')"


@query("g3_tag_stats", f""", {_ALL_TAGS}, c AS (SELECT tag, count(*) AS n, count(DISTINCT pos) AS m FROM t GROUP BY tag), d AS (SELECT DISTINCT tag, pos, filename FROM t),
f AS (SELECT tag, string_agg(filename, ', ' ORDER BY pos) AS names FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY pos) AS r FROM d) WHERE r <= 6 GROUP BY tag)
SELECT tag, n, names || CASE WHEN m > 6 THEN '…' ELSE '' END AS tracks FROM c JOIN f USING (tag)""")
def _(s):
    return aggregates.tag_stats(s)


@query("g5_duplicate_names", "SELECT filename, count(*) AS n FROM samples GROUP BY filename HAVING count(*) > 1")
def _(s):
    return rules.duplicate_names(s)


@query("g9_counters", "SELECT count(*) FILTER (caption = '') AS no_caption, count(*) FILTER (lyrics <> '') AS with_lyrics, bool_or(NOT is_instrumental) AS any_vocal, bool_and(is_instrumental) AS all_instrumental FROM samples")
def _(s):
    return aggregates.counters(s)


@query("g10_prevalence", f", {_ALL_TAGS}, c AS (SELECT tag, count(DISTINCT pos) AS n_tracks FROM t GROUP BY tag), n AS (SELECT count(*)::DOUBLE AS n FROM samples) SELECT tag, n_tracks, CASE WHEN n_tracks / n >= 0.995 THEN 'constant' WHEN n_tracks / n >= 0.9 THEN 'nearly constant' WHEN n_tracks / n >= 0.1 THEN 'variable' ELSE 'not learnable' END AS band FROM c, n")
def _(s):
    return aggregates.prevalence(s)


# --- sequences


@query("w2_drop_stray_tags", r"""
, l AS (SELECT pos, unnest(string_split(lyrics, chr(10))) AS x, unnest(range(len(string_split(lyrics, chr(10))))) AS i FROM samples),
g AS (SELECT *, trim(x) <> '' AND trim(regexp_replace(x, '\[[^\]]*\]', '', 'g')) = '' AS tag FROM l), k AS (SELECT *, lag(tag) OVER (PARTITION BY pos ORDER BY i) AS before FROM g)
SELECT pos, string_agg(x, chr(10) ORDER BY i) AS lyrics FROM k WHERE NOT (tag AND coalesce(before, false)) GROUP BY pos""")
def _(s):
    return s.select("pos", sequences.drop_stray_tags(F.col("lyrics")).alias("lyrics"))


_SECTIONS = "SELECT pos, i AS seq, case i % 3 when 0 then 'verse' when 1 then 'chorus' else 'bridge' end AS label, cast(i * 10 as double) AS start, cast(i * 10 + case when (pos + i) % 5 = 0 then 0 else 8 end as double) AS e FROM samples, (SELECT unnest(range(7)) AS i)"


def _sections(s: DataFrame) -> DataFrame:
    rows = s.select("pos", F.explode(F.expr("sequence(0L, 6L)")).alias("at"))
    return rows.select("pos", "at", F.expr("case at % 3 when 0 then 'verse' when 1 then 'chorus' else 'bridge' end").alias("label"), (F.col("at") * 10).cast("double").alias("start"), F.expr("cast(at * 10 + case when (pos + at) % 5 = 0 then 0 else 8 end as double)").alias("end"))


@query("w1_section_names", f", x AS ({_SECTIONS}), n AS (SELECT *, row_number() OVER (PARTITION BY pos, label ORDER BY seq) AS r FROM x) SELECT pos, seq, label || '_' || lpad(r::VARCHAR, 2, '0') AS name FROM n WHERE e > start")
def _(s):
    return sequences.name_sections(_sections(s)).select("pos", F.col("at").alias("seq"), "name")


#: Places between the first words of a caption, half a second a character.
_ENDS = "n AS (SELECT pos, duration, list_transform(string_split(caption, ' ')[1:40], lambda w: length(w)) AS n FROM samples), c AS (SELECT pos, duration, n, list_transform(range(1, len(n) + 1), lambda i: (list_sum(n[1:i]) * 0.5)::DOUBLE) AS ends FROM n)"


def _ends(s: DataFrame) -> DataFrame:
    sizes = F.transform(F.slice(F.split("caption", " ", -1), 1, 40), lambda w: F.length(w))
    return s.withColumn("n", sizes).withColumn("ends", F.transform("n", lambda x, i: F.aggregate(F.slice(F.col("n"), F.lit(1), i + 1), F.lit(0), lambda a, y: a + y) * F.lit(0.5)))


@query("w4_boundaries", f"""
, {_ENDS}, k AS (SELECT pos, duration, list_reduce(list_transform(ends, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 8 THEN list_concat(a, x) ELSE a END) AS kept FROM c)
SELECT pos, array_to_string(list_concat(kept[1:len(kept) - 1], [duration]), ',') AS kept FROM k""")
def _(s):
    return _ends(s).select("pos", F.array_join(F.transform(sequences.keep_apart(F.col("ends"), F.lit(8.0), F.col("duration")), lambda x: x.cast("string")), ",").alias("kept"))


@query("w5_merge_short", f"""
, {_ENDS}, g AS (SELECT pos, list_transform(range(1, len(n) + 1), lambda i: [{{'s': ends[i] - n[i] * 0.5, 'e': ends[i], 'l': CASE n[i] % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END}}]) AS x FROM c),
m AS (SELECT pos, list_reduce(x, lambda a, y: CASE WHEN a[-1].e - a[-1].s < 2.5 AND y[1].e - y[1].s < 2.5 THEN list_concat(a[1:len(a) - 1], [{{'s': a[-1].s, 'e': y[1].e, 'l': a[-1].l}}]) ELSE list_concat(a, y) END) AS x FROM g)
SELECT pos, array_to_string(list_transform(x, lambda y: y.s::DOUBLE || '-' || y.e::DOUBLE || ':' || y.l), ',') AS segments FROM m""")
def _(s):
    label = lambda n: F.when(n % 3 == 0, "a").when(n % 3 == 1, "b").otherwise("c")
    found = F.zip_with("n", "ends", lambda n, e: F.struct((e - n * F.lit(0.5)).alias("start"), e.alias("end"), label(n).alias("label")))
    merged = F.transform(sequences.merge_short(found, 2.5), lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit(":"), x["label"]))
    return _ends(s).select("pos", F.array_join(merged, ",").alias("segments"))


@query("w7_split", """
, r AS (SELECT id, coalesce(nullif(trim(genre), ''), '?') AS g, md5('42:' || id) AS h FROM samples)
SELECT id, CASE WHEN row_number() OVER (PARTITION BY g ORDER BY h, id) <= round_even(count(*) OVER (PARTITION BY g) * 0.2::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM r""")
def _(s):
    return sequences.split_dataset(s).select("id", "split")


@query("w8_tiles", "SELECT pos, greatest(1, ceil((duration - 0.5) / 30))::INTEGER AS n, least(greatest(1, ceil((duration - 0.5) / 30)) * 30, duration)::DOUBLE AS last_end FROM samples")
def _(s):
    x = sequences.tiles(F.col("duration"), 30.0)
    return s.select("pos", x.alias("x")).select("pos", F.size("x").alias("n"), F.element_at("x", -1)["end"].alias("last_end"))


@query("w10_adaptive_k", "SELECT pos, least(20, CASE WHEN duration < 60 THEN greatest(2, floor(duration / 15)) ELSE greatest(4, floor(duration / 30)) END)::INTEGER AS k FROM samples")
def _(s):
    return s.select("pos", sequences.adaptive_k(F.col("duration")).alias("k"))


#: Lyrics with blanks at their end, and tracks without a name.
_SUNG = {"raw_lyrics": "case when pos % 3 = 0 then concat(raw_lyrics, ' ', chr(10), chr(9), chr(10)) else raw_lyrics end", "filename": "case when pos % 9 = 4 then null else filename end"}


@query("k8_blocks", f"""
, t AS (SELECT pos, {_SUNG['filename']} AS name, {_SUNG['raw_lyrics']} AS raw, formatted_lyrics, lyrics FROM samples)
SELECT pos, '---- ' || coalesce(name, '?') || ' ----' || chr(10) || regexp_replace(CASE WHEN raw <> '' THEN raw WHEN formatted_lyrics <> '' THEN formatted_lyrics ELSE lyrics END, '\\s+$', '') || chr(10) AS block FROM t""")
def _(s):
    s = s.withColumns({c: F.expr(e) for c, e in _SUNG.items()})
    return s.select("pos", sequences.build_block(s).alias("block"))


#: Blocks edited by hand: odd markers between the lines, some with hyphens or nothing for a name.
_EDITED = "concat(case pos % 7 when 0 then '  ---- ' when 1 then '----' else '---- ' end, case pos % 11 when 0 then '' when 1 then 'a - b --' else filename end, case pos % 5 when 0 then '----  ' else ' ----' end, chr(10), lyrics, chr(10), case when pos % 4 = 0 then '-----' else '' end, chr(10), chr(10))"


@query("s17_parse_blocks", rf"""
, b AS (SELECT pos // 20 AS doc, string_agg({_EDITED}, '' ORDER BY pos) AS t FROM samples GROUP BY 1),
l AS (SELECT doc, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM b),
m AS (SELECT *, CASE WHEN starts_with(trim(line), '----') AND suffix(trim(line), '----') THEN trim(substr(trim(line), 5, greatest(0, length(trim(line)) - 8))) END AS name FROM l),
n AS (SELECT *, count(name) OVER (PARTITION BY doc ORDER BY k) AS block FROM m),
g AS (SELECT doc, block, max(name) AS filename, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (name IS NULL), '') AS text FROM n WHERE block > 0 GROUP BY doc, block)
SELECT doc, filename, arg_max(regexp_replace(text, '^\n+|\n+$', '', 'g'), block) AS text FROM g GROUP BY doc, filename""")
def _(s):
    own = s.select(F.expr("pos div 20").alias("doc"), "pos", F.expr(_EDITED).alias("b"))
    docs = own.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "").alias("text"))
    return sequences.parse_blocks(docs)


# --- scalar text functions


@query("t_scalars", r"""
SELECT id, regexp_replace(lyrics, '[“”„‟«»"]', '', 'g') AS no_quotes,
  list_sum(list_transform(regexp_extract_all(lower(lyrics), '[a-z0-9'']+'), lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')))))::INTEGER AS syllables,
  ceil(length(lyrics) / 3.7::DOUBLE)::INTEGER AS tokens, regexp_replace(string_split(filename, '/')[-1], '\.[^.]*$', '') || '.mp3' AS staged, string_split(audio_path, '/')[-1] AS base,
  CASE WHEN length(caption) > 50 THEN '…' || right(caption, 50) ELSE caption END AS tail, string_split(caption, 'the')[-1] AS reply,
  regexp_replace(regexp_replace(trim(keyscale), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM samples""")
def _(s):
    return s.select(
        "id", T.strip_quotes(F.col("lyrics")).alias("no_quotes"), F.when(T.count_syllables(F.col("lyrics")) > 0, T.count_syllables(F.col("lyrics"))).alias("syllables"), T.estimate_tokens(F.col("lyrics")).alias("tokens"),
        T.staged_name(F.col("filename")).alias("staged"), T.basename(F.col("audio_path")).alias("base"), T.log_tail(F.col("caption"), 50).alias("tail"), F.substring_index("caption", "the", -1).alias("reply"), T.slug(F.col("keyscale")).alias("slug"),
    )


@query("t16_instruments", f"SELECT DISTINCT trim(t) AS given, {_norm('t')} AS name FROM (SELECT unnest(string_split(detected_instruments, ',')) AS t FROM samples)")
def _(s):
    return s.select(F.explode(F.split("detected_instruments", ",")).alias("t")).select(F.trim("t").alias("given"), T.normalize_instrument(F.col("t")).alias("name")).distinct()


@query("t21_tag_prefix", f"SELECT id, array_to_string({TAGS}, '|') AS tags, {SENTENCES}::INTEGER AS sentences FROM (SELECT id, {BODY} AS body FROM samples)")
def _(s):
    return s.select("id", F.array_join(T.tag_prefix(F.col("caption")), "|").alias("tags"), T.count_sentences(T.strip(F.col("caption"))).alias("sentences"))


@query("t17_format_tags", "SELECT id, array_to_string(list_filter([CASE WHEN bpm > 0 THEN bpm::VARCHAR || ' BPM' END, nullif(keyscale, ''), timesignature, 'Instruments: drums, bass', CASE WHEN is_instrumental THEN 'Instrumental' END], lambda x: x IS NOT NULL), '; ') AS tags FROM samples")
def _(s):
    return s.select("id", T.format_tags(F.col("bpm"), F.col("keyscale"), F.col("timesignature"), F.expr("array('drums', 'bass')"), F.col("is_instrumental"), F.lit(None).cast("boolean")).alias("tags"))


@query("t18_compose_caption", "SELECT id, CASE WHEN pos % 3 = 0 THEN caption WHEN pos % 3 = 1 THEN coalesce(nullif(custom_tag, ''), caption) WHEN custom_tag <> '' AND caption <> '' THEN custom_tag || chr(10) || chr(10) || caption ELSE coalesce(nullif(custom_tag, ''), caption) END AS caption FROM samples")
def _(s):
    return s.select("id", T.compose_caption(F.col("custom_tag"), F.col("caption"), F.expr("case pos % 3 when 0 then -5 when 1 then 100 else 50 end")).alias("caption"))


@query("t11_normalize_lyrics")
def _(s):
    from curatrix.functions.lyrics import normalize_lyrics

    x = s.withColumn("r", normalize_lyrics(F.col("lyrics"), ing_to_in=True))
    return x.select("id", "r.text", *[f"r.{c}" for c in ("contractions", "ing", "tags", "lines_changed", "apostrophes", "capitalized", "quotes", "tags_trimmed", "tags_dropped")])


#: Lyrics with the first lines of a text behind them.
_LONG = "concat(lyrics, chr(10), ' ', replace(substr(caption, 1, 900), chr(13), ' '), ' x')"
_WORDS = r"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


@query("t14_split_lines", rf"""
, l AS (SELECT id, string_split({_LONG}, chr(10)) AS l FROM samples), u AS (SELECT id, generate_subscripts(l, 1) AS k, {STRIP.format(x="unnest(l)")} AS line FROM l),
w AS (SELECT id, k, line, {_SYLLABLES.format(x="line")} AS n, list_transform({_WORDS.format(x="line")}, lambda w: [{{'t': w, 'n': {_SYLLABLES.format(x="w").replace("lambda w:", "lambda v:").replace("(1, len(regexp_extract_all(w,", "(1, len(regexp_extract_all(v,")}}}]) AS w FROM u),
p AS (SELECT id, k, line, n, list_reduce(w, lambda a, x: CASE WHEN a[-1].n > 10 OR a[-1].n + x[1].n <= 10 THEN list_concat(a[1:len(a) - 1], [{{'t': a[-1].t || ' ' || x[1].t, 'n': (a[-1].n + x[1].n)::INTEGER}}]) ELSE list_concat(a, x) END) AS pieces
      FROM w WHERE n > 10 AND NOT starts_with(line, '['))
SELECT id, string_agg(coalesce(array_to_string(list_transform(pieces, lambda x: x.t), chr(10)), line), chr(10) ORDER BY k) AS lyrics FROM w LEFT JOIN p USING (id, k, line, n) GROUP BY id""")
def _(s):
    from curatrix.functions import lyrics

    return s.withColumn("lyrics", F.expr(_LONG)).select("id", lyrics.mapped(lyrics.split_lines)("lyrics").alias("lyrics"))


@query("t23_trim_caption", rf"""
, b AS (SELECT id, {BODY} AS body FROM samples),
t AS (SELECT id, body, list_filter(list_transform(string_split(split_part(body, '.', 1), ','), lambda t: {STRIP.format(x="t")}), lambda t: t <> '') AS tags, CASE WHEN contains(body, '.') THEN substr(body, strpos(body, '.') + 1) ELSE '' END AS tail FROM b),
h AS (SELECT *, array_to_string(tags[1:12], ', ') AS lead, list_filter(list_transform(string_split(regexp_replace({STRIP.format(x="tail")}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_WORDS.format(x="s")}), lambda w: len(w) > 0) AS sentences FROM t),
r AS (SELECT *, 120 - len({_WORDS.format(x="lead")}) AS room, list_transform(range(0, len(sentences) + 1), lambda i: coalesce(list_sum(list_transform(sentences[1:i], lambda w: len(w))), 0)::BIGINT) AS ends FROM h),
c AS (SELECT *, greatest(0, len(list_filter(ends, lambda e: e <= room)) - 1) AS whole FROM r),
p AS (SELECT *, list_concat(CASE WHEN lead <> '' THEN [lead || '.'] ELSE [] END,
  list_transform(sentences[1:whole], lambda w: array_to_string(w, ' ') || CASE WHEN right(w[-1], 1) IN ('.', '!', '?') THEN '' ELSE '.' END),
  CASE WHEN whole < len(sentences) AND room > ends[whole + 1] THEN [regexp_replace(array_to_string(sentences[whole + 1][1:room - ends[whole + 1]], ' '), '[,;:]+$', '') || '.'] ELSE [] END) AS parts FROM c)
SELECT id, CASE WHEN len(tags) <= 12 AND len({_WORDS.format(x="body")}) <= 120 THEN body ELSE array_to_string(parts, ' ') END AS caption FROM p""")
def _(s):
    from curatrix.functions import lyrics

    return s.select("id", lyrics.mapped(lyrics.trim_caption)("caption").alias("caption"))


@query("t30_diff", r"""
SELECT id, CASE pos % 4 WHEN 0 THEN '' WHEN 1 THEN '-she''ll run' || chr(10) || '+sheel run' WHEN 2 THEN '-b' || id ELSE '+[Outro]' || chr(10) || '+end ' || id END AS diff,
  CASE pos % 4 WHEN 0 THEN '' WHEN 1 THEN 'she''ll run>sheel run' WHEN 2 THEN 'b' || id || '>' ELSE '>[Outro];>end ' || id END AS pairs FROM samples""")
def _(s):
    from curatrix.functions import lyrics

    before = F.expr("case pos % 4 when 0 then 'same' when 1 then concat('[Verse]', chr(10), \"she'll run\") when 2 then concat('a', chr(10), 'b', id, chr(10), 'c') else 'x' end")
    after = F.expr("case pos % 4 when 0 then 'same' when 1 then concat('[Verse]', chr(10), 'sheel run') when 2 then concat('a', chr(10), 'c') else concat('x', chr(10), '[Outro]', chr(10), 'end ', id) end")
    own = s.select("id", before.alias("a"), after.alias("b"))
    pairs = lyrics.mapped(lambda a, b: ";".join(f"{x or ''}>{y or ''}" for x, y in lyrics.line_pairs(a, b)))
    return own.select("id", lyrics.mapped(lyrics.line_diff)("a", "b").alias("diff"), pairs("a", "b").alias("pairs"))


# --- merges

@query("u1_merge_rules", "SELECT genre AS word, 'profile' AS said FROM samples WHERE pos % 2 = 0 GROUP BY genre UNION ALL SELECT DISTINCT genre, 'master' FROM samples WHERE genre NOT IN (SELECT genre FROM samples WHERE pos % 2 = 0)")
def _(s):
    words = lambda rows, said: rows.select(F.col("genre").alias("word"), F.lit(said).alias("said")).distinct()
    return merging.merge_rules(words(s, "master"), words(s.filter("pos % 2 = 0"), "profile"))


@query("u2_merge_words", "SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(string_split(detected_instruments, ','), string_split(custom_tag, ',')), lambda w: lower(trim(w))), lambda w: w <> ''))), ',') AS words FROM samples")
def _(s):
    return s.select("id", F.array_join(merging.merge_words(F.split("detected_instruments", ","), F.split("custom_tag", ",")), ",").alias("words"))


@query("u5_merge_instruments", """
, t AS (SELECT id, list_filter(list_transform(regexp_split_to_array(detected_instruments, '[,;|/]'), lambda t: trim(t)), lambda t: t <> '') AS f, list_filter(list_transform(regexp_split_to_array(custom_tag, '[,;|/]'), lambda t: trim(t)), lambda t: t <> '') AS n FROM samples)
SELECT id, array_to_string(list_reduce(list_concat([f], list_transform(n, lambda x: [x])), lambda a, x: CASE WHEN len(list_filter(a, lambda m: contains(lower(m), lower(x[1])) OR contains(lower(x[1]), lower(m)))) > 0 THEN a ELSE list_concat(a, x) END), ',') AS instruments FROM t""")
def _(s):
    split = lambda c: F.filter(F.transform(F.split(c, "[,;|/]"), lambda t: F.trim(t)), lambda t: t != "")
    return s.select("id", F.array_join(merging.merge_instruments(split("detected_instruments"), split("custom_tag")), ",").alias("instruments"))


@query("u6_separate", "SELECT id, CASE WHEN pos % 2 = 0 THEN 'b' ELSE 'a' END AS vocals, 'a' AS drums FROM samples")
def _(s):
    stages = F.expr("array(map('vocals', 'a', 'drums', 'a'), if(pos % 2 = 0, map('vocals', 'b'), map('other', 'c')))")
    return s.select("id", merging.separate(stages).alias("m")).select("id", F.col("m")["vocals"].alias("vocals"), F.col("m")["drums"].alias("drums"))


@query("j10_update_by_id", "SELECT id, CASE WHEN pos % 5 = 0 THEN 'x' || id ELSE filename END AS filename FROM samples")
def _(s):
    new = s.filter("pos % 5 = 0").select("id", F.concat(F.lit("x"), "id").alias("filename"))
    return merging.update_by_id(s, new, ["filename"]).select("id", "filename")


@query("j13_ids_by_stem", r"""
, k AS (SELECT lower(regexp_replace(filename, '\.[^.]*$', '')) AS k, arg_min(id, pos) AS id FROM samples GROUP BY 1)
SELECT DISTINCT upper(regexp_replace(filename, '\.[^.]*$', '')) || '.MP3' AS name, k.id FROM samples JOIN k ON k.k = lower(regexp_replace(filename, '\.[^.]*$', ''))""")
def _(s):
    return merging.ids_by_stem(s, s.select(F.concat(F.upper(T.stem(F.col("filename"))), F.lit(".MP3")).alias("name")).distinct())


@query("p8_bulk_edit", "SELECT id, 'rock' AS genre, 100::BIGINT AS bpm, replace(audio_path, '/music/', '/m/') AS audio_path FROM samples")
def _(s):
    return merging.bulk_edit(s, {"genre": "rock", "bpm": "100.7"}, "/music/", "/m/").select("id", "genre", "bpm", "audio_path")


@query("p29_compared_caption", "SELECT id, caption_ai_raw AS caption FROM samples")
def _(s):
    return s.select("id", merging.compared_caption(s).alias("caption"))


@query("t27_stem_type", "SELECT id, CASE pos % 4 WHEN 0 THEN 'bass' WHEN 1 THEN 'target' WHEN 2 THEN 'synth_pad' ELSE 'other' END AS stem FROM samples")
def _(s):
    kind = F.expr("case pos % 4 when 0 then 'Electric Bass' when 1 then 'Vocals x' when 2 then 'Synth Pad' else 'rest' end")
    return s.select("id", merging.stem_type(kind, F.expr("case pos % 4 when 0 then 63 when 1 then 7 when 2 then 20 else 7 end")).alias("stem"))


@query("a5_band_instruments", "SELECT id, CASE pos % 3 WHEN 0 THEN 'bass' WHEN 1 THEN 'drums,rhythm instrument' ELSE 'vocals or bright lead' END AS instruments FROM samples")
def _(s):
    x = lambda a, b, c: F.expr(f"cast(case pos % 3 when 0 then {a} when 1 then {b} else {c} end as double)")
    return s.select("id", F.array_join(merging.band_instruments(x(1, 1, 9), x(0, 9, 1), x(5, 1, 1), x(1, 5, 1), x(1, 1, 8)), ",").alias("instruments"))


@query("a12_loudness_plan", r"""
SELECT id, '/work/originals_backup/' || filename AS backup, 'ffmpeg|-y|-i|' || audio_path || '|-af|loudnorm=I=-14.0:TP=-1.0:LRA=11|-ar|44100|-ac|2|/work/normalized_audio/norm_' || regexp_replace(filename, '\.[^.]*$', '') || '.wav' AS command,
  'ffmpeg|-y|-i|' || audio_path || '|-vn|-ar|44100|-ac|2|-b:a|192k|/tmp/x.mp3' AS staging FROM samples""")
def _(s):
    plan = merging.loudness_plan(s, "/work").select("id", "backup", F.array_join("command", "|").alias("command"))
    return plan.join(s.select("id", F.array_join(merging.mp3_command(F.col("audio_path"), F.lit("/tmp/x.mp3")), "|").alias("staging")), "id")


@query("p10_rename_prefix", "SELECT id, CASE WHEN row_number() OVER (PARTITION BY filename ORDER BY pos) = 1 THEN 'x_' || filename END AS new_name FROM samples")
def _(s):
    return edits.renamed(s, "prefix", "x_").select("id", "new_name")


@query("f15_tag_search", "SELECT DISTINCT lower(trim(t)) AS tag FROM (SELECT unnest(regexp_split_to_array(custom_tag, '[,;|/]')) AS t FROM samples) WHERE contains(lower(trim(t)), 'dr')")
def _(s):
    return s.select(F.explode(T.split_tags(F.col("custom_tag"))).alias("t")).select(F.lower("t").alias("tag")).filter(F.contains("tag", F.lit("dr"))).distinct()


# --- versions and numbers


@query("x1_diff_rows", "SELECT id, CASE WHEN pos % 10 = 1 THEN 'removed' ELSE 'changed' END AS change, CASE WHEN pos % 10 = 2 THEN 'bpm' WHEN pos % 10 = 3 THEN 'genre' END AS columns FROM samples WHERE pos % 10 IN (1, 2, 3)")
def _(s):
    own = s.select("id", "pos", "bpm", "genre")
    new = own.filter("pos % 10 <> 1").withColumns({"bpm": F.when(F.col("pos") % 10 == 2, F.col("bpm") + 1).otherwise(F.col("bpm")), "genre": F.when(F.col("pos") % 10 == 3, F.lit(None)).otherwise(F.col("genre"))})
    return versions.diff_rows(own, new).select("id", "change", F.array_join("columns", ",").alias("columns"))


def _a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of the vectors of length 1, six places each."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = numeric.l2_normalize(F.col("embedding"))
    return rows.select("vec_id", F.array_join(F.transform(v, lambda x: x.cast("decimal(9,6)").cast("string")), ",").alias("vector"))


ORACLE_SQL["a7_l2_normalize"] = """SELECT vec_id, array_to_string(list_transform(v, lambda x: (x / n)::DECIMAL(9, 6)), ',') AS vector
FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"""
QUERIES["a7_l2_normalize"] = _a7


def _a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return numeric.project_2d(rows).select(rows.columns[0], F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


QUERIES["a8_project_2d"] = _a8


#: Code points of the first characters of a caption, as samples; the second channel strays from the first by the track's number.
_CODES = "list_transform(regexp_split_to_array(substr(caption, 1, 200), ''), lambda c: ascii(c))"


@query("a1_stereo", f"""
, l AS (SELECT pos, list_transform({_CODES}, lambda c: c - 100) AS l FROM samples WHERE caption <> ''),
c AS (SELECT pos, l, CASE WHEN pos % 11 > 0 THEN list_transform(l, lambda x, i: x + ((x * i) % 3) * (pos % 4) * 0.05::DOUBLE) END AS r FROM l),
e AS (SELECT pos, r, list_sum(list_transform(list_zip(l, r), lambda x: ((x[1] + x[2]) / 2.0::DOUBLE) ** 2)) AS m, list_sum(list_transform(list_zip(l, r), lambda x: ((x[1] - x[2]) / 2.0::DOUBLE) ** 2)) AS s FROM c)
SELECT pos, CASE WHEN r IS NULL OR m <= 0 AND s <= 0 THEN 'mono' WHEN m <= 0 THEN 'stereo' WHEN s <= 0 THEN 'mono' WHEN 10 * log10(s / m) < -30 THEN 'mono' ELSE 'stereo' END AS label FROM e""")
def _(s):
    own = s.filter("caption <> ''").withColumn("l", F.transform(_codes(), lambda c: (c - 100).cast("double")))
    strays = F.transform("l", lambda x, i: x + ((x.cast("long") * (i + 1)) % 3) * (F.col("pos") % 4) * F.lit(0.05))
    return own.select("pos", numeric.stereo(F.col("l"), F.when(F.col("pos") % 11 > 0, strays))["label"].alias("label"))


def _codes():
    return F.transform(F.split(F.left("caption", F.lit(200)), ""), lambda c: F.ascii(c))


#: Rows (order, name, pitch class, weight) of the keys' profiles.
_PROFILES = ", ".join(f"({2 * k + m}, '{numeric.KEYS[k]} {mode}', {i}, {profile[(i - k) % 12]})" for k in range(12) for m, (mode, profile) in enumerate((("major", numeric.MAJOR), ("minor", numeric.MINOR))) for i in range(12))


@query("a3_key", f"""
, p(o, name, i, weight) AS (VALUES {_PROFILES}),
x AS (SELECT pos, i, len(list_filter({_CODES}, lambda c: c % 12 = i))::DOUBLE AS x FROM samples, range(12) r(i) WHERE caption <> ''),
f AS (SELECT pos, o, name, corr(x, weight) AS r, stddev_pop(x) AS sd FROM x JOIN p USING (i) GROUP BY pos, o, name)
SELECT pos, CASE WHEN max(sd) > 0 THEN arg_max(name, r * 1000000 - o * 0.0000001) ELSE '' END AS key FROM f GROUP BY pos""")
def _(s):
    own = s.filter("caption <> ''").withColumn("codes", _codes())
    of_class = lambda k: F.size(F.filter("codes", lambda c: c % 12 == k)).cast("double")
    chroma = F.array(*[of_class(k) for k in range(12)])
    return own.select("pos", numeric.key_of(chroma).alias("key"))


@query("a4_time_signature", "SELECT pos, CASE WHEN pos % 2 = 0 THEN '3/4' ELSE '4/4' END AS signature FROM samples")
def _(s):
    return s.select("pos", numeric.time_signature(F.expr("transform(sequence(0, 47), i -> if(i % if(pos % 2 = 0, 3, 4) = 0, 2.0D, 1.0D))")).alias("signature"))


# --- the assistant's conversation


def _s21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.ranked(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id"], [F.desc("turn")], 40).select("conv_id", "turn", "role", "text")


QUERIES["s21_last_messages"] = _s21
ORACLE_SQL["s21_last_messages"] = "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 40"
