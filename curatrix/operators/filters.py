"""Row predicates of the track table, as Columns or semi joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import text as T

SEARCHED = ("filename", "caption", "custom_tag", "genre", "keyscale", "lyrics", "formatted_lyrics")


def matches(query: str) -> Column:
    """The query, case apart, in the searched fields joined by blanks; it may span two of them."""
    return F.contains(F.lower(F.concat_ws(" ", *[T.text_of(F.col(c)) for c in SEARCHED])), F.lit(query.lower()))


def shown(query: str = "", kind: str = "all", captioned: bool = False) -> Column:
    """The table's filter: text, 'instrumental' or 'vocal', and with a caption."""
    keep = matches(query) if query else F.lit(True)
    if kind != "all":
        keep &= F.coalesce(F.col("is_instrumental"), F.lit(False)) == (kind == "instrumental")
    return keep & (T.text_of(F.col("caption")) != "") if captioned else keep


def is_exception() -> Column:
    """No caption at all; one of blanks is none of these."""
    return T.text_of(F.col("caption")) == ""


def is_missing_caption() -> Column:
    """No caption but blanks."""
    return T.strip(F.col("caption")) == ""


def bad_captions(samples: DataFrame, diff: DataFrame | None = None) -> DataFrame:
    """Tracks without caption, whose last proposal failed, or that the review marks as missing or failed."""
    failed = F.upper(F.ltrim(T.text_of(F.col("caption_ai_raw")))).startswith("ERROR:")
    if diff is None:
        return samples.filter(is_missing_caption() | failed)
    bad = diff.filter(F.col("status").isin("missing", "error")).select(F.col("id").alias("_id"), F.lit(True).alias("_bad")).distinct()
    marked = samples.join(bad, F.col("id") == F.col("_id"), "left")
    return marked.filter(is_missing_caption() | failed | F.col("_bad").isNotNull()).drop("_id", "_bad")


def for_export(samples: DataFrame) -> DataFrame:
    """Without planned tracks that have no audio."""
    return samples.filter(~F.coalesce(F.col("virtual"), F.lit(False)))


def lyric_scope(samples: DataFrame, scope: str = "all", selected: DataFrame | None = None) -> DataFrame:
    """All tracks, those with vocals, or the selected ids."""
    if scope == "selected":
        return samples.join(selected.select("id").distinct(), "id", "left_semi")
    return samples.filter(~F.coalesce(F.col("is_instrumental"), F.lit(False))) if scope == "vocal" else samples


def parse_numbers(text: str) -> list[int] | None:
    """'1-3,5' or '1 3 5' to sorted numbers, parted by commas or blanks; reversed ranges are turned; None if a part can't be read."""
    found = [re.fullmatch(r"(\d+)(?:-(\d+))?|([+]\d+)", part) for part in re.split(r"[,\s]+", text.strip(", \t\n"))] if text.strip(", \t\n") else []
    if not all(found):
        return None
    ends = [sorted((int(m[1] or m[3]), int(m[2] or m[1] or m[3]))) for m in found]
    return sorted({n for a, b in ends for n in range(a, b + 1)})


def resolve(samples: DataFrame, refs: DataFrame) -> DataFrame:
    """ref and pos (null: unresolved) for each ref: an exact file name first, then a 1-based position, then 0 itself.

    The number of samples is counted once; a name that several tracks have is the first of them.
    """
    n = samples.count()
    names = samples.groupBy("filename").agg(F.min("pos").alias("by_name"))
    number = F.when(F.trim("ref").rlike("^[0-9]+$"), F.trim("ref").try_cast("long"))
    at = F.when(number.between(1, n), number - 1).when((number == 0) & F.lit(n > 0), number)
    found = refs.join(names, F.trim("ref") == F.col("filename"), "left")
    return found.select("ref", F.coalesce("by_name", at).alias("pos"))


def first_seen(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key, in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_r = 1").drop("_r")


# The backends that never hear the audio.
PLACEHOLDER_BACKENDS = ("Local Rule Engine", "DeepSeek Cloud")


def is_placeholder(backend: Column) -> Column:
    """Whether a caption came from a backend that does not hear the audio."""
    return T.text_of(backend).isin(*PLACEHOLDER_BACKENDS)


def over_limit(cap: int = 512) -> Column:
    """Lyrics, formatted ones first, above the cap of tokens."""
    return T.estimate_tokens(T.first_of(F.col("formatted_lyrics"), F.col("lyrics"))) > cap
