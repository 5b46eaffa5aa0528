"""Unions with priorities, small merges of maps and lists, and updates by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators.edits import set_field


def merge_rules(master: DataFrame, profile: DataFrame) -> DataFrame:
    """word and said: the profile's rules win, the master's others stay; of equal words within one, the last by ``pos`` if there is one."""
    own, others = _last_of_word(profile), _last_of_word(master)
    return own.unionByName(others.join(own.select("word"), "word", "left_anti"))


def _last_of_word(rules: DataFrame) -> DataFrame:
    order = "pos" if "pos" in rules.columns else "said"
    return rules.groupBy("word").agg(F.max_by("said", order).alias("said"))


def merge_exceptions(master: DataFrame, profile: DataFrame) -> DataFrame:
    """word: the words of both that keep their -ing, each once."""
    return master.select("word").union(profile.select("word")).filter("word IS NOT NULL").distinct()


def merge_words(a: Column, b: Column) -> Column:
    """Both lists, trimmed, in small letters, each word once, sorted."""
    clean = lambda xs: F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda w: F.lower(F.trim(w))), lambda w: w != "")
    return F.array_sort(F.array_union(clean(a), clean(b)))


def merge_instruments(found: Column, named: Column) -> Column:
    """Names behind those found, but for names that hold, or are held by, one already there (case apart)."""
    covers = lambda m, n: F.contains(F.lower(m), F.lower(n)) | F.contains(F.lower(n), F.lower(m))
    return F.aggregate(named, found, lambda a, n: F.when(F.exists(a, lambda m: covers(m, n)), a).otherwise(F.array_append(a, n)))


def separate(stages: Column) -> Column:
    """One map of an array of stem maps: later stages win."""
    keys = F.array_distinct(F.flatten(F.transform(stages, lambda m: F.map_keys(m))))
    last = lambda k: F.element_at(F.array_compact(F.transform(stages, lambda m: m[k])), -1)
    return F.map_from_arrays(keys, F.transform(keys, last))


def apply_target(samples: DataFrame, where: Column, text: Column, target: str) -> DataFrame:
    """A text into the caption, the lyrics or both."""
    for field in {"caption": ("caption",), "lyrics": ("lyrics",), "both": ("caption", "lyrics")}[target]:
        samples = set_field(samples, where, field, text)
    return samples


def locked(samples: DataFrame, state: bool) -> DataFrame:
    return samples.withColumn("locked", F.lit(state))


def hooks(segments: Column) -> Column:
    """Names of the segments that are marked as hooks."""
    return F.transform(F.filter(segments, lambda s: s["hook"]), lambda s: s["name"])


def update_by_id(samples: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """New values of some columns, where the updates have the id."""
    new = updates.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = samples.join(new, "id", "left").withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns})
    return out.drop("_hit", *[f"_{c}" for c in columns])


def bulk_edit(samples: DataFrame, values: dict[str, object], path_find: str = "", path_put: str = "") -> DataFrame:
    """One value for each of some fields on all rows, and a literal replacement in the paths."""
    for field, value in values.items():
        samples = set_field(samples, F.lit(True), field, F.lit(value))
    if path_find:
        samples = samples.withColumn("audio_path", F.replace("audio_path", F.lit(path_find), F.lit(path_put)))
    return samples


def compared_caption(samples: DataFrame) -> Column:
    """The caption to compare with: the last proposal, else the tags' caption."""
    return T.first_of(F.col("caption_ai_raw"), F.col("tags_caption") if "tags_caption" in samples.columns else F.lit(""))


def chunk_captions(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks (pos, path) with the caption of the result of their base name; a name that several chunks have goes to the first."""
    name = T.basename(F.col("path"))
    first = chunks.groupBy(name.alias("name")).agg(F.min_by(F.struct("pos", "path"), F.struct("pos", "path")).alias("c"))
    return first.join(results, "name").select("c.pos", "c.path", "caption")


def ids_by_stem(samples: DataFrame, names: DataFrame) -> DataFrame:
    """name and id: exact file name first, else the stem, case apart."""
    exact = samples.groupBy(F.col("filename").alias("name")).agg(F.min_by("id", "pos").alias("a"))
    near = samples.groupBy(F.lower(T.stem(F.col("filename"))).alias("k")).agg(F.min_by("id", "pos").alias("b"))
    out = names.select("name", F.lower(T.stem(F.col("name"))).alias("k")).join(exact, "name", "left").join(near, "k", "left")
    return out.select("name", F.coalesce("a", "b").alias("id"))


def terms_for_artist(vocabulary: DataFrame, artist: str) -> DataFrame:
    """scope (artist or general), facet and term, in order."""
    scope = F.when(F.col("artist") == artist, "artist").when(F.col("artist").isNull(), "general")
    return vocabulary.withColumn("scope", scope).filter("scope is not null").select("scope", "facet", "pos", "term")


def stem_type(kind: Column, model: Column) -> Column:
    """The stem of a separated file. Models 63 and 20 (fixed values) give several stems, others a target and the rest."""
    low = F.lower(T.text_of(kind))
    several = F.replace(low, F.lit(" "), F.lit("_"))
    for name in reversed(("vocals", "bass", "drums", "guitar", "piano", "other")):
        several = F.when(F.contains(low, F.lit(name)), name).otherwise(several)
    return F.when(model.isin(63, 20), several).otherwise(F.when(low.rlike("vocals|target"), "target").otherwise("other"))


def band_instruments(harmonic: Column, percussive: Column, bass: Column, mid: Column, high: Column) -> Column:
    """Instruments that the shares of the energies suggest. The thresholds are fixed values."""
    bands, both = F.greatest(F.lit(1e-9), bass + mid + high), F.greatest(F.lit(1e-9), harmonic + percussive)
    return F.array_compact(
        F.array(
            F.when(bass / bands > 0.35, "bass"), F.when(percussive / both > 0.45, "drums"), F.when(mid / bands > 0.3, "rhythm instrument"),
            F.when((high / bands > 0.22) & (harmonic / both > 0.6), "vocals or bright lead"),
        )
    )


def loudness_plan(samples: DataFrame, folder: str, lufs: float = -14.0, rate: int = 44100) -> DataFrame:
    """id, the file that each track is backed up as, and the command that would normalise its loudness; null for tracks without a path."""
    path, there = F.col("audio_path"), T.text_of(F.col("audio_path")) != ""
    name = T.first_of(F.col("filename"), T.basename(path))
    command = F.array(*[F.lit(x) for x in ("ffmpeg", "-y", "-i")], path, *[F.lit(x) for x in ("-af", f"loudnorm=I={lufs}:TP=-1.0:LRA=11", "-ar", str(rate), "-ac", "2")], F.concat(F.lit(f"{folder}/normalized_audio/norm_"), T.stem(name), F.lit(".wav")))
    return samples.select("id", F.when(there, F.concat(F.lit(f"{folder}/originals_backup/"), name)).alias("backup"), F.when(there, command).alias("command"))


def mp3_command(source: Column, target: Column, bitrate: str = "192k") -> Column:
    """The command that would make a small audio-only copy for staging."""
    return F.array(*[F.lit(x) for x in ("ffmpeg", "-y", "-i")], source, *[F.lit(x) for x in ("-vn", "-ar", "44100", "-ac", "2", "-b:a", bitrate)], target)
