"""Dataset reports. Ties of counted values go to the one seen first, so every group carries its least position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import text as T


def instruments_of(samples: DataFrame) -> DataFrame:
    """pos and instrument: a row for each listed instrument, blanks left out."""
    own = F.filter(F.transform(F.split(T.text_of(F.col("detected_instruments")), ","), lambda t: F.trim(t)), lambda i: i != "")
    return samples.select("pos", F.explode(own).alias("value"))


def top(values: DataFrame, most: int) -> DataFrame:
    """value and n of the most frequent values; equal counts in the order of their first position. values: pos, value."""
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("_first")).orderBy(F.desc("n"), "_first").limit(most).drop("_first")


def _known(samples: DataFrame, column: str) -> DataFrame:
    return samples.select("pos", F.trim(T.text_of(F.col(column))).alias("value")).filter("value <> ''")


def summary(samples: DataFrame) -> DataFrame:
    """One row of counts and ranges; zeros and blanks count as unknown."""
    bpm, dur = F.nullif("bpm", F.lit(0)), F.nullif("duration", F.lit(0.0))
    body = T.strip(F.col("caption"))
    rows = samples.select(F.coalesce("is_instrumental", F.lit(False)).alias("i"), bpm.alias("b"), dur.alias("d"), F.when(body != "", T.n_words(body)).alias("w"))
    return rows.agg(
        F.count(F.lit(1)).alias("tracks"), F.count_if(~F.col("i")).alias("vocal"), F.count_if("i").alias("instrumental"), F.count("w").alias("captioned"),
        F.min("b").alias("bpm_min"), F.max("b").alias("bpm_max"), F.floor(F.avg("b")).alias("bpm_mean"),
        F.min("d").alias("duration_min"), F.max("d").alias("duration_max"), F.bround(F.avg("d")).alias("duration_mean"),
        F.min("w").cast("long").alias("words_min"), F.max("w").cast("long").alias("words_max"), F.bround(F.avg("w")).alias("words_mean"),
    )


def report(samples: DataFrame, genres: int = 8, keys: int = 6, instruments: int = 8) -> DataFrame:
    """kind, value and n: the most frequent genres, keys and instruments."""
    parts = (("genre", _known(samples, "genre"), genres), ("key", _known(samples, "keyscale"), keys), ("instrument", instruments_of(samples), instruments))
    out = None
    for kind, values, most in parts:
        rows = top(values, most).select(F.lit(kind).alias("kind"), "value", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def sound_profile(samples: DataFrame) -> DataFrame:
    """The shorter report: kind, value and n. Counts of tracks, of vocal, instrumental and captioned ones and the range of known tempi are rows as well."""
    bpm, vocal = F.nullif("bpm", F.lit(0)), ~F.coalesce("is_instrumental", F.lit(False))
    counts = samples.agg(F.count(F.lit(1)).alias("tracks"), F.count_if(vocal).alias("vocal"), F.count_if(~vocal).alias("instrumental"), F.count_if(T.strip(F.col("caption")) != "").alias("captioned"), F.min(bpm).cast("long").alias("bpm_min"), F.max(bpm).cast("long").alias("bpm_max"))
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit("count").alias("kind"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in counts.columns]))).filter("n IS NOT NULL")
    return rows.unionByName(report(samples, 6, 5, 8))


def tags_of(samples: DataFrame) -> DataFrame:
    """pos, filename and tag: every occurrence."""
    return samples.select("pos", "filename", F.explode(T.extract_tags(F.col("detected_instruments"), F.col("custom_tag"), F.col("genre"))).alias("tag"))


def tag_stats(samples: DataFrame, shown: int = 6) -> DataFrame:
    """tag, occurrences, and the first file names, the most frequent tags first.

    The first tracks of a tag come from ranks that are limited before the shuffle, so a tag's size does not matter.
    """
    tags = tags_of(samples)
    counts = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("n_tracks"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy("pos"))
    once = samples.select("pos", "filename", F.explode(F.array_distinct(T.extract_tags(F.col("detected_instruments"), F.col("custom_tag"), F.col("genre")))).alias("tag"))
    first = once.withColumn("r", rank).filter(F.col("r") <= shown).groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("r", "filename"))).alias("s"))
    names = F.concat(F.array_join(F.transform("s", lambda x: x["filename"]), ", "), F.when(F.col("n_tracks") > shown, "…").otherwise(""))
    return counts.join(first, "tag").select("tag", "n", names.alias("tracks")).orderBy(F.desc("n"), "tag")


def gap_totals(gaps: DataFrame) -> DataFrame:
    """One row: tracks, those without and those with gaps."""
    clean = F.count_if(F.size("issues") == 0)
    return gaps.agg(F.count(F.lit(1)).alias("tracks"), clean.alias("clean"), (F.count(F.lit(1)) - clean).alias("with_gaps"))


def tidy_totals(tidied: DataFrame) -> DataFrame:
    """One row: tracks changed, and sums over these of what the tidying changed. tidied: changed and _tidy, the report."""
    sums = [F.coalesce(F.sum(F.when(F.col("changed"), F.col(f"_tidy.{c}"))), F.lit(0)).alias(c) for c in ("quotes", "tags_trimmed", "tags_dropped", "tags", "lines_changed")]
    return tidied.agg(F.count_if("changed").alias("changed"), *sums)


def by_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def prevalence(samples: DataFrame) -> DataFrame:
    """An extension: the share of tracks that have a tag, and its band."""
    n = samples.count()
    share = F.col("n_tracks") / F.lit(float(max(1, n)))
    band = F.when(share >= 0.995, "constant").when(share >= 0.9, "nearly constant").when(share >= 0.1, "variable").otherwise("not learnable")
    return tags_of(samples).groupBy("tag").agg(F.count_distinct("pos").alias("n_tracks")).withColumn("band", band)


def counters(samples: DataFrame) -> DataFrame:
    """One row: captions missing, lyrics there, any vocal, all instrumental."""
    return samples.agg(
        F.count_if(T.text_of(F.col("caption")) == "").alias("no_caption"), F.count_if(T.text_of(F.col("lyrics")) != "").alias("with_lyrics"),
        F.bool_or(~F.col("is_instrumental")).alias("any_vocal"), F.bool_and("is_instrumental").alias("all_instrumental"),
    )
