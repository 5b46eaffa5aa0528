"""Projections and updates of the track table. Each returns a new DataFrame; nothing is changed in place."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import text as T

#: Canonical fields: type and default (an SQL literal).
FIELDS = {
    "id": ("string", "''"), "audio_path": ("string", "''"), "filename": ("string", "''"), "caption": ("string", "''"), "genre": ("string", "''"), "lyrics": ("string", "''"),
    "raw_lyrics": ("string", "''"), "formatted_lyrics": ("string", "''"), "bpm": ("bigint", "0"), "keyscale": ("string", "''"), "timesignature": ("string", "''"), "duration": ("double", "0"),
    "language": ("string", "'en'"), "is_instrumental": ("boolean", "false"), "custom_tag": ("string", "''"), "labeled": ("boolean", "false"), "prompt_override": ("string", "'false'"),
    "virtual": ("boolean", "false"),
}
#: The fields of an exported track, in their order.
EXPORTED = tuple(FIELDS)[:17]
WRITABLE = ("caption", "genre", "custom_tag", "language", "keyscale", "timesignature", "bpm", "duration", "is_instrumental", "lyrics", "formatted_lyrics")


def normalize(samples: DataFrame) -> DataFrame:
    """Absent fields with their defaults (present nulls stay); a track with lyrics, raw or shown, is not instrumental."""
    for name, (kind, default) in FIELDS.items():
        if name not in samples.columns:
            samples = samples.withColumn(name, F.expr(f"cast({default} as {kind})"))
    sung = (T.text_of(F.col("raw_lyrics")) != "") | (T.text_of(F.col("lyrics")) != "")
    return samples.withColumn("is_instrumental", F.when(sung, F.lit(False)).otherwise(F.col("is_instrumental")))


def new_sample(rows: DataFrame) -> DataFrame:
    """Rows with every canonical field; nulls take the defaults too."""
    return normalize(rows).withColumns({n: F.coalesce(F.col(n) if n in rows.columns else F.lit(None), F.expr(f"cast({d} as {k})")) for n, (k, d) in FIELDS.items()})


def to_export(samples: DataFrame, *more: Column) -> DataFrame:
    """The exported fields in their order, and more columns of the tracks: bare file name, path or name, duration and flags always there, override one of two texts or null."""
    name = T.basename(F.trim(T.first_of(F.trim(T.text_of(F.col("filename"))), T.text_of(F.col("audio_path")))))
    more_names = [f"_more{k}" for k in range(len(more))]
    out = samples.withColumns(dict(zip(more_names, more, strict=True)) | {n: F.expr(f"cast({d} as {k})") for n, (k, d) in FIELDS.items() if n not in samples.columns})
    out = out.withColumns(
        {
            "filename": name,
            "audio_path": F.when(F.trim(T.text_of(F.col("audio_path"))) == "", name).otherwise(F.col("audio_path")),
            "duration": F.coalesce(F.col("duration"), F.lit(0.0)),
            "is_instrumental": F.coalesce(F.col("is_instrumental"), F.lit(False)),
            "prompt_override": F.when(F.col("prompt_override").isin("caption", "genre"), F.col("prompt_override")),
        }
    )
    named = [F.col(n).alias(samples.select(c).columns[0]) for n, c in zip(more_names, more, strict=True)]
    return out.select(*EXPORTED, *named)


def instrumental_mode(samples: DataFrame, all_instrumental: bool) -> DataFrame:
    """One row: all_instrumental, no_instrumentals (every flag is false, not null, and there are tracks) or mixed."""
    none = F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_instrumental") == F.lit(False)).alias("f")
    mode = F.when(F.lit(all_instrumental), "all_instrumental").when((F.col("n") > 0) & (F.col("n") == F.col("f")), "no_instrumentals").otherwise("mixed")
    return samples.agg(*none).select(mode.alias("instrumental_mode"))


def choose_language(samples: DataFrame, choice: Column) -> DataFrame:
    """'instrumental' clears the language and raises the flag; any other choice is the language and lowers it."""
    bare = F.trim(T.text_of(choice))
    return samples.withColumns({"language": F.when(bare == "instrumental", "").otherwise(bare), "is_instrumental": bare == "instrumental"})


def shown_language(language: Column, instrumental: Column) -> Column:
    return F.when(instrumental, "instrumental").otherwise(T.text_of(language))


def parsed(field: str, value: Column) -> Column:
    """A value as a field stores it: flags from yes-words, bpm and duration cut to whole numbers (0 if unreadable)."""
    if field == "is_instrumental":
        return F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y", "instrumental")
    if field in ("bpm", "duration"):
        return F.coalesce(value.cast("string").try_cast("double").cast("long"), F.lit(0).cast("long"))
    return T.text_of(value.cast("string"))


def set_field(samples: DataFrame, where: Column, field: str, value: Column) -> DataFrame:
    """One writable field of some tracks."""
    if field not in WRITABLE:
        raise ValueError(f"{field} can't be written")
    return samples.withColumn(field, F.when(where, parsed(field, value).cast(samples.schema[field].dataType)).otherwise(F.col(field)))


def replace_text(samples: DataFrame, find: str, put: str, fields: tuple[str, ...] = ("caption", "custom_tag")) -> DataFrame:
    """Literal replacement; n_fields counts the fields of the row that changed."""
    new = {c: F.replace(T.text_of(F.col(c)), F.lit(find), F.lit(put)) for c in fields}
    changed = sum((F.contains(T.text_of(F.col(c)), F.lit(find)).cast("int") for c in fields), F.lit(0))
    return samples.withColumn("n_fields", changed).withColumns(new)


def _numbered(pattern: str, number: Column) -> Column:
    """A pattern with the number for its fields {n}, {n:03d}, {n:3} or {n:x}; one with other fields or loose braces has it for {n} only."""
    out = []
    try:
        for text, field, spec, conversion in string.Formatter().parse(pattern):
            out.append(F.lit(text))
            if field is None:
                continue
            own = re.fullmatch(r"(0?)(\d*)([dxXo]?)", spec)
            if field != "n" or conversion or not own:
                raise ValueError(field)
            zero, width, kind = own.groups()
            out.append(F.format_string(f"%{zero if width else ''}{width}{kind or 'd'}", number))
    except ValueError:
        return F.replace(F.lit(pattern), F.lit("{n}"), number.cast("string"))
    return F.concat(*out, F.lit(""))


RENAME_MODES = ("replace", "prefix", "suffix", "number", "song")


def renamed(samples: DataFrame, mode: str, a: str = "", b: str = "", start: int = 1) -> DataFrame:
    """new_name of every track, the suffix kept; of equal targets the first keeps it, the others are null (skipped).

    Modes: replace (a by b; names without a are skipped), prefix and suffix (a), number (the pattern a with {n} or {n:03d}, counted
    from start over the tracks that have a name), song.  The first of a target is found by an aggregate, so a name that
    very many tracks share is combined before the shuffle.
    """
    bare, suffix = T.splitext(T.text_of(F.col("filename")))
    if mode == "number":
        samples = numbered(samples, start)
    new = {
        "replace": lambda: F.when(F.contains(bare, F.lit(a)) if a else F.lit(False), F.concat(F.replace(bare, F.lit(a), F.lit(b)), suffix)),
        "prefix": lambda: F.concat(F.lit(a), F.col("filename")),
        "suffix": lambda: F.concat(bare, F.lit(a), suffix),
        "number": lambda: F.concat(_numbered(a, F.col("number")), suffix),
        "song": lambda: F.concat(T.song_name(F.col("filename")), suffix),
    }[mode]()
    target = samples.withColumn("new_name", F.nullif(F.when(T.text_of(F.col("filename")) != "", new), F.lit("")))
    first = target.groupBy("new_name").agg(F.min("pos").alias("first_pos"))
    out = target.join(first, "new_name", "left").withColumn("new_name", F.when(F.col("pos") == F.col("first_pos"), F.col("new_name")))
    return out.drop("first_pos", "number")


def numbered(samples: DataFrame, start: int = 1) -> DataFrame:
    """number: the count of named tracks up to each, from start on. Ranges of positions are counted first, so no task sees all rows."""
    named = (T.text_of(F.col("filename")) != "").cast("long")
    ranged = samples.withColumn("part", F.expr("pos div 100000"))
    counts = ranged.groupBy("part").agg(F.sum(named).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum(named).over(Window.partitionBy("part").orderBy("pos"))
    return ranged.join(before, "part").withColumn("number", own + F.col("before") + start - 1).drop("part", "before")


def add_tag(tags: Column, tag: str) -> Column:
    """The tag behind the others, unless it is there in any case."""
    own = T.split_tags(tags)
    return F.array_join(F.when(F.exists(own, lambda t: F.lower(t) == tag.strip().lower()), own).otherwise(F.concat(own, F.array(F.lit(tag.strip())))), ", ")


def remove_tag(tags: Column, tag: str) -> Column:
    return F.array_join(F.filter(T.split_tags(tags), lambda t: F.lower(t) != tag.strip().lower()), ", ")


def normalize_tags(tags: Column) -> Column:
    """Every tag by its instrument name; equal ones stay."""
    return F.array_join(F.transform(T.split_tags(tags), T.normalize_instrument), ", ")


def normalize_all_tags(samples: DataFrame) -> DataFrame:
    """The tracks with instrument names for synonyms in custom_tag, in the list detected_instruments and in the list tags.instruments; ``changed``: how many of the three differ.

    Lists that are absent or texts instead of lists stay as they are; a custom tag whose names stay keeps its spelling.
    """
    own = T.split_tags(F.col("custom_tag"))
    named = F.transform(own, T.normalize_instrument)
    put = {"custom_tag": F.when((F.size(own) > 0) & (named != own), F.array_join(named, ", ")).otherwise(F.col("custom_tag"))}
    differ = [(F.size(own) > 0) & (named != own)]
    listed = lambda x: F.transform(x, T.normalize_instrument)
    kinds = dict(samples.dtypes)
    if kinds.get("detected_instruments") == "array<string>":
        x = F.col("detected_instruments")
        put["detected_instruments"] = listed(x)
        differ.append(listed(x) != x)
    if "instruments:array<string>" in kinds.get("tags", ""):
        x = F.col("tags.instruments")
        put["tags"] = F.when(F.col("tags").isNotNull(), F.col("tags").withField("instruments", listed(x)))
        differ.append(listed(x) != x)
    changed = sum((F.coalesce(d, F.lit(False)).cast("int") for d in differ), F.lit(0))
    return samples.withColumn("changed", changed).withColumns(put)


def import_lyrics(samples: DataFrame, lyrics: DataFrame) -> DataFrame:
    """Lyrics by filename, stripped, into all three fields; blank ones are refused; the track is not instrumental then."""
    new = lyrics.select("filename", T.strip(F.col("text")).alias("_new")).filter("_new <> ''")
    out = samples.join(new, "filename", "left")
    put = {c: F.coalesce("_new", c) for c in ("lyrics", "raw_lyrics", "formatted_lyrics")}
    return out.withColumns(put | {"is_instrumental": F.col("is_instrumental") & F.col("_new").isNull()}).drop("_new")


def virtual_tracks(specs: DataFrame, first: int = 1) -> DataFrame:
    """Planned tracks from specs (pos, title and writable fields), with generated file names."""
    name = F.format_string("virtual_%02d_%s.wav", (F.col("pos") + first).cast("int"), F.lower(T.slug(F.col("title"))))
    keep = [c for c in specs.columns if c in WRITABLE]
    return new_sample(specs.select(name.alias("filename"), F.lit(True).alias("virtual"), *keep))


def tidied(samples: DataFrame, tidy, fill_blanks: bool = False) -> DataFrame:
    """Tidied lyrics into formatted_lyrics; the first text before tidying is kept and taken again. tidy: Column to a struct with text."""
    source = T.first_of(F.col("raw_lyrics"), F.col("formatted_lyrics"), F.col("lyrics"))
    out = samples.withColumn("_source", source).withColumn("_tidy", tidy(F.col("_source")))
    change = (F.col("_source") != "") & (F.col("_tidy.text") != T.text_of(F.col("formatted_lyrics")))
    if fill_blanks:
        change &= T.text_of(F.col("formatted_lyrics")) == ""
    raw = F.when(change, T.first_of(F.col("raw_lyrics"), F.col("_source"))).otherwise(F.col("raw_lyrics"))
    return out.withColumns({"raw_lyrics": raw, "formatted_lyrics": F.when(change, F.col("_tidy.text")).otherwise(F.col("formatted_lyrics")), "changed": change}).drop("_source")


def apply_decisions(samples: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: id, proposed, decision (keep, use, edit), edited. Blank and failed texts are never written; the former caption is kept beside."""
    own = decisions.select(F.col("id"), T.strip(F.col("proposed")).alias("_p"), F.col("decision").alias("_d"), T.strip(F.col("edited")).alias("_e"))
    out = samples.join(own, "id", "left").withColumn("_text", F.when(F.col("_d") == "edit", F.col("_e")).when(F.col("_d") == "use", F.col("_p")).otherwise(""))
    good = (F.col("_text") != "") & ~F.upper("_text").startswith("ERROR:")
    was = T.strip(F.col("caption"))
    before = F.col("caption_before") if "caption_before" in samples.columns else F.lit(None).cast("string")
    return out.withColumns(
        {
            "caption_before": F.when(good & (was != "") & (was != F.col("_text")), was).otherwise(before),
            "caption": F.when(good, F.col("_text")).otherwise(F.col("caption")),
            "caption_ai_raw": F.when(good | ((F.col("_d") == "keep") & (F.col("_p") != "")), F.col("_p")).otherwise(F.col("caption_ai_raw")),
        }
    ).drop("_p", "_d", "_e", "_text")


def merge_analysis(samples: DataFrame, found: DataFrame) -> DataFrame:
    """bpm and key of an analysis (id, bpm, keyscale), where it found any."""
    new = found.select("id", F.nullif("bpm", F.lit(0)).alias("_b"), F.nullif("keyscale", F.lit("")).alias("_k"))
    return samples.join(new, "id", "left").withColumns({"bpm": F.coalesce("_b", "bpm"), "keyscale": F.coalesce("_k", "keyscale")}).drop("_b", "_k")


def push_history(history: DataFrame, samples: DataFrame, stamp: Column, most: int = 25) -> DataFrame:
    """history (id, caption, at) with the present captions, unless equal to the last of the track; the newest ``most`` stay."""
    w = Window.partitionBy("id").orderBy(F.desc("at"))
    last = history.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("id", F.col("caption").alias("_last"))
    now = samples.filter(T.text_of(F.col("caption")) != "").join(last, "id", "left").filter(F.col("_last").isNull() | (F.col("_last") != F.col("caption"))).select("id", "caption", stamp.alias("at"))
    return history.unionByName(now).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


# The texts of the rule engine, by the kind of caption asked for.
RULE_CAPTIONS = {
    "instruments": "acoustic guitar, electric bass, drums, keyboard, vocals",
    "Concise Tags": "dynamic acoustic profile, defined instrumentation, expressive performance",
    "Deep Structural Breakdown": "A comprehensive full-song arrangement. Opens with an iconic melodic motif, building texture through the verses with dynamic rhythm shifts. Bridges introduce emotional climax and solo leads before resolving in a tight, resonant outro.",
    "": "balanced musical arrangement, organic dynamic response, defined lead instruments",
}


def rule_caption(kind: Column, tag: Column) -> Column:
    """The rule engine's caption of a kind (any other: the last), behind the tag where there is one."""
    body = F.lit(RULE_CAPTIONS[""])
    for name, text in RULE_CAPTIONS.items():
        body = F.when(kind == name, text).otherwise(body) if name else body
    return F.concat_ws(", ", F.nullif(T.strip(tag), F.lit("")), body)


def context(samples: DataFrame) -> Column:
    """What is known of a track, a line each; caption up to 300 and lyrics up to 2000 characters.

    Optional columns: instruments (array; detected_instruments, parted by commas, else), structural_segments (array of name,
    start, end), hooks (array) and riff_note.
    """
    has = lambda c: c in samples.columns
    some = lambda x: F.nullif(T.text_of(x), F.lit(""))
    line = lambda label, x: F.concat(F.lit(label), x)
    listed = lambda x: F.when(F.size(x) > 0, F.array_join(x, ", "))
    instruments = listed(F.filter(F.transform(F.split(T.text_of(F.col("detected_instruments")), ","), T.strip), lambda i: i != ""))
    if has("instruments"):
        instruments = F.coalesce(listed(F.col("instruments")), instruments)
    parts = [
        line("Track: ", F.coalesce("filename", F.lit("?"))), line("Genre: ", some(F.col("genre"))), line("BPM: ", F.when(F.col("bpm") != 0, F.col("bpm").cast("string"))), line("Key: ", some(F.col("keyscale"))),
        line("Instruments: ", instruments), line("Existing caption: ", F.left(some(F.col("caption")), F.lit(300))),
    ]
    if has("structural_segments"):
        segment = lambda s: F.concat(F.coalesce(s["name"], F.lit("?")), F.lit(" "), F.coalesce(s["start"], F.lit(0)).cast("string"), F.lit("-"), F.coalesce(s["end"], F.lit(0)).cast("string"), F.lit("s"))
        parts.append(line("Sections: ", listed(F.transform("structural_segments", segment))))
    if has("hooks"):
        parts.append(line("Hooks/riffs to emphasize: ", listed(F.col("hooks"))))
    if has("riff_note"):
        parts.append(line("Riff note: ", some(F.col("riff_note"))))
    parts.append(line("LYRICS:\n", F.left(some(T.strip(T.first_of(F.col("lyrics"), F.col("formatted_lyrics")))), F.lit(2000))))
    return F.concat_ws("\n", *parts)
