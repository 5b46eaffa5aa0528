"""Ordered operators: blocks, sections, folds over arrays, splits and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import text as T


def parse_blocks(texts: DataFrame) -> DataFrame:
    """doc, filename and text of the blocks under marker lines; lines before the first are dropped, of equal names the last wins.

    A marker line, blanks at its ends apart, begins and ends with four hyphens; the name is what lies between the first and the last four, stripped: it may be
    empty and may have hyphens of its own.  The order of a text's lines is a window over its own rows: a text is one block file.
    """
    lines = F.split(T.text_of(F.col("text")), r"\r\n|[\n\r\u000b\f\u001c\u001d\u001e\u0085  ]")
    bare = T.strip(F.col("line"))
    name = F.when(bare.startswith("----") & bare.endswith("----"), T.strip(F.substring(bare, F.lit(5), F.greatest(F.lit(0), F.length(bare) - 8))))
    rows = texts.select("doc", F.posexplode(lines).alias("at", "line")).withColumn("name", name)
    own = Window.partitionBy("doc").orderBy("at")
    numbered = rows.withColumn("block", F.sum(F.col("name").isNotNull().cast("int")).over(own)).filter("block > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    blocks = numbered.groupBy("doc", "block").agg(F.max("name").alias("filename"), F.regexp_replace(body, "^\n+|\n+$", "").alias("text"))
    return blocks.groupBy("doc", "filename").agg(F.max_by("text", "block").alias("text"))


def build_block(samples: DataFrame) -> Column:
    """The block of a track: marker line ('?' where the track has no name), lyrics (raw, formatted or shown) without blanks at the end, blank line."""
    text = T.first_of(F.col("raw_lyrics"), F.col("formatted_lyrics"), F.col("lyrics"))
    return F.concat(F.lit("---- "), F.coalesce("filename", F.lit("?")), F.lit(" ----\n"), F.rtrim(text, F.lit(T.BLANKS)), F.lit("\n"))


def name_sections(sections: DataFrame) -> DataFrame:
    """Sections (pos, at, label, start, end) with names Label_NN, numbered by label before empty ones go."""
    number = F.row_number().over(Window.partitionBy("pos", "label").orderBy("at"))
    return sections.withColumn("name", F.format_string("%s_%02d", F.col("label"), number)).filter(F.col("end") > F.col("start"))


def keep_apart(times: Column, least: Column, duration: Column) -> Column:
    """Boundaries at least ``least`` behind the one kept before; the last is the duration."""
    kept = F.aggregate(times, F.array().cast("array<double>"), lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(a, -1) >= least), F.array_append(a, t)).otherwise(a))
    return F.when(F.size(kept) == 0, F.array(duration)).otherwise(F.concat(F.slice(kept, F.lit(1), F.greatest(F.lit(0), F.size(kept) - 1)), F.array(duration)))


def merge_short(segments: Column, least: float) -> Column:
    """Segments (start, end, label) joined to the one before when both are short."""
    short = lambda s: s["end"] - s["start"] < least

    def step(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), s["end"].alias("end"), last["label"].alias("label"))))
        return F.when(F.size(a) == 0, F.array(s)).when(short(last) & short(s), joined).otherwise(F.array_append(a, s))

    return F.aggregate(segments, F.array().cast("array<struct<start: double, end: double, label: string>>"), step)


def drop_stray_tags(text: Column) -> Column:
    """Without tag-only lines right below another."""
    tag = lambda x: (F.trim(x) != "") & (F.trim(F.regexp_replace(x, r"\[[^\]]*\]", "")) == "")
    lines = F.split(T.text_of(text), "\n", -1)
    return F.get(F.transform(F.array(lines), lambda ls: F.array_join(F.filter(ls, lambda x, i: ~(tag(x) & (i > 0) & F.coalesce(tag(F.get(ls, i - 1)), F.lit(False)))), "\n")), F.lit(0))


def adaptive_k(duration: Column) -> Column:
    """How many sections to look for."""
    return F.least(F.lit(20), F.when(duration < 60, F.greatest(F.lit(2), F.floor(duration / 15))).otherwise(F.greatest(F.lit(4), F.floor(duration / 30)))).cast("int")


def tiles(length: Column, width: float) -> Column:
    """Windows (start, end) of a track; none begins within the last half second, the last ends with it."""
    n = F.greatest(F.lit(1), F.ceil((length - 0.5) / width).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * width).alias("start"), F.least((i + 1) * width, length).alias("end")))


def part_list(parts: Column) -> Column:
    """'Part i (from Ns): text' lines of an array of (start, text)."""
    return F.array_join(F.transform(parts, lambda p, i: F.format_string("Part %d (from %ds): %s", i + 1, p["start"].cast("long"), p["text"])), "\n")


def split_dataset(samples: DataFrame, ratio: float = 0.2, seed: int = 42, stratify: bool = True) -> DataFrame:
    """split ('train' or 'val'), stratified by genre ('?' if blank) or over all tracks: bround(n * ratio) of each, the first in a seeded hash order.

    The cut is by hash rank; a genre with most of the rows is ranked in hash buckets whose counts give their offsets.
    """
    if ratio <= 0:
        return samples.withColumn("split", F.lit("train"))
    genre = T.first_of(F.trim(T.text_of(F.col("genre"))), F.lit("?")) if stratify else F.lit("?")
    rows = samples.withColumns({"_g": genre, "_h": F.md5(F.concat(F.lit(f"{seed}:"), F.col("id")).cast("binary"))})
    rows = rows.withColumn("_b", F.substring("_h", 1, 2))
    counts = rows.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    of = Window.partitionBy("_g")
    upto = F.sum("_n").over(of.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    heads = counts.select("_g", "_b", upto.alias("_before"), F.sum("_n").over(of).alias("_of"))
    rank = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_h", "id")) + F.col("_before")
    cut = F.bround(F.col("_of") * F.lit(ratio))
    return rows.join(heads, ["_g", "_b"]).withColumn("split", F.when(rank <= cut, "val").otherwise("train")).drop("_g", "_h", "_b", "_before", "_of")


def lrc(segments: Column, lyrics: Column) -> Column:
    """[mm:ss.cc]text lines of segments (start, text), else the lyrics."""
    lines = F.array_join(F.transform(segments, lambda s: F.concat(T.lrc_time(s["start"]), F.trim(s["text"]))), "\n")
    return F.when(F.coalesce(F.size(segments), F.lit(0)) > 0, lines).otherwise(T.text_of(lyrics))
