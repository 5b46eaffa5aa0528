"""Caption and dataset rules. A caption's issues are an array of 'code' or 'code:value', in the order of the rules."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from itertools import groupby
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.packing import ship

# The bounds of a caption and of a lyric line.
TAG_MIN, TAG_MAX, TAG_HARD_MAX = 5, 12, 15
MAX_WORDS, MAX_CHARS = 120, 900
MIN_SENTENCES, MAX_SENTENCES = 2, 3
NGRAM, NGRAM_REPEATS, RUN_REPEATS = 3, 3, 5
LINE_SYLLABLES, LINE_FLAG = (6, 10), 12

# Terms that declare vocals, and the patterns of what belongs elsewhere.
VOCAL_TERMS = (
    "male vocal", "female vocal", "male baritone", "baritone", "tenor", "raspy vocal", "raspy vocals", "powerful belting", "clean vocal", "clean vocals", "screamed vocal", "screamed vocals",
    "whispered vocal", "whispered vocals", "breathy", "falsetto", "choir", "instrumental", "no vocals", "lead vocal", "male voice", "female voice", "spoken word",
)
HEADING = r"(?m)^\s*(?:\*\*)?[A-Z][A-Za-z /&]{2,30}(?:\*\*)?\s*:"
MARKDOWN = r"(?m)\*\*|^#{1,6}\s|^\s*[-*]\s"
BPM = r"\b\d{2,3}\s*(?:BPM|bpm)\b|\b(?:BPM|bpm)\b"
TIME_SIGNATURE = r"(?i)\b\d\s*/\s*(?:4|8)\b|\btime\s*signature\b"
KEY = r"\b(?:in\s+)?[A-G](?:#|b)?\s*(?:major|minor)\b"
#: Texts of which each pattern's matches hold one: a search for them spares most captions the pattern. Letters that other letters fold to are left out.
HOLDS = {HEADING: (":",), MARKDOWN: ("*", "#", "-"), BPM: ("BPM", "bpm"), TIME_SIGNATURE: ("/", "gnature"), KEY: ("major", "minor")}
#: The vocal terms that hold no other one.
VOCAL = tuple(t for t in sorted(VOCAL_TERMS) if not any(u != t and u in t for u in VOCAL_TERMS))

# Instruments that the audit looks for.
INSTRUMENTS = (
    "vocals", "lead vocal", "backing vocals", "drums", "drum kit", "bass", "electric guitar", "lead guitar", "rhythm guitar", "acoustic guitar", "organ", "piano", "keys", "keyboard",
    "rhodes", "synth", "hammond", "fiddle", "steel guitar", "harmonica", "saxophone", "trumpet", "trombone", "percussion", "congas", "tambourine", "cello", "violin", "harp", "mandolin",
    "banjo", "flute", "clarinet",
)
REQUIRED_METADATA = ("name", "custom_tag", "tag_position", "num_samples")
REQUIRED_SAMPLE = ("id", "audio_path", "filename", "caption", "genre", "lyrics", "formatted_lyrics", "bpm", "keyscale", "timesignature", "duration", "language", "is_instrumental", "custom_tag")
REQUIRED_FOR_TRAINING = ("caption", "genre", "bpm", "keyscale", "language")


_WORD = re.compile("[A-Za-z']+")
REPEATS = "n int, phrase string, run int, word string"


def repeats_of(text: str | None, n: int = NGRAM) -> tuple[int, str, int, str]:
    """The most repeated word n-gram and its count, the longest run of one word and the word; the first of several. 0 and '' without n-grams, 1 and '' without words."""
    words = _WORD.findall((text or "").lower())
    grams = Counter(zip(*(words[k:] for k in range(n)), strict=False))
    gram, count = max(grams.items(), key=lambda x: x[1], default=((), 0))
    runs = [(sum(1 for _ in group), word) for word, group in groupby(words)]
    run, word = max(runs, key=lambda x: x[0], default=(1, ""))
    return count, " ".join(gram), run, word


def repeats(text: Column, n: int = NGRAM) -> Column:
    """repeats_of as a struct: counting needs a hash table for each row, which no Column function has, so this is one Arrow pass."""
    ship()

    @F.pandas_udf(REPEATS)
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repeats_of(t, n) for t in texts], columns=["n", "phrase", "run", "word"])

    return counted(text)


def max_ngram_repeat(text: Column, n: int = NGRAM) -> Column:
    """n and phrase of the most repeated word n-gram."""
    return T.bound(repeats(text, n), lambda r: F.struct(r["n"].alias("n"), r["phrase"].alias("phrase")))


def max_consecutive_repeat(text: Column) -> Column:
    """n and word of the longest run of one word."""
    return T.bound(repeats(text), lambda r: F.struct(r["run"].alias("n"), r["word"].alias("word")))


def caption_issues(caption: Column) -> Column:
    """The rules that a caption breaks; an empty one breaks only that."""
    given = F.struct(T.strip(caption).alias("body"), repeats(T.strip(caption)).alias("repeats"))
    return T.bound(given, lambda g: F.when(g["body"] == "", F.array(F.lit("empty"))).otherwise(_broken(g["body"], g["repeats"])))


def _broken(body: Column, repeated: Column) -> Column:
    """The rules that a stripped caption breaks. Each measure is bound to a variable, so it is made once."""
    low = F.lower(body)

    def matches(pattern: str) -> Column:
        return _any(low if "(?i)" in pattern else body, HOLDS[pattern]) & body.rlike("(?U)" + pattern)

    measures = F.struct(F.size(T.tag_prefix(body)).alias("tags"), T.count_sentences(body).alias("sentences"), T.n_words(body).alias("words"), repeated["n"].alias("gram"), repeated["run"].alias("run"))

    def issues(m: Column) -> Column:
        code = lambda name, value: F.concat(F.lit(name + ":"), value.cast("string"))
        return F.array_compact(
            F.array(
                F.when(m["tags"] < TAG_MIN, code("few_tags", m["tags"])).when(m["tags"] > TAG_HARD_MAX, code("many_tags", m["tags"])),
                F.when(~T.bound(low, lambda x: _any(x, VOCAL)), "no_vocal_term"),
                F.when(matches(HEADING), "heading"),
                F.when(matches(MARKDOWN), "markdown"),
                F.when(matches(BPM), "bpm"),
                F.when(matches(TIME_SIGNATURE), "time_signature"),
                F.when(matches(KEY), "key"),
                F.when(m["sentences"] < MIN_SENTENCES, code("few_sentences", m["sentences"])).when(m["sentences"] > MAX_SENTENCES, code("many_sentences", m["sentences"])),
                F.when(m["words"] > MAX_WORDS, code("many_words", m["words"])),
                F.when(F.char_length(body) > MAX_CHARS, code("many_chars", F.char_length(body))),
                F.when(m["gram"] >= NGRAM_REPEATS, code("ngram_repeat", m["gram"])),
                F.when(m["run"] >= RUN_REPEATS, code("word_run", m["run"])),
            )
        )

    return T.bound(measures, issues)


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text holds one of the parts."""
    return reduce(or_, [F.contains(text, F.lit(p)) for p in parts])


def is_conforming(caption: Column) -> Column:
    return F.size(caption_issues(caption)) == 0


def rule_of(issue: Column) -> Column:
    """The code of an issue."""
    return F.substring_index(issue, ":", 1)


def caption_report(samples: DataFrame) -> DataFrame:
    """issue and n: how many captions break each rule."""
    return samples.select(F.explode(caption_issues(F.col("caption"))).alias("i")).groupBy(rule_of(F.col("i")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


def manifest_issues(samples: DataFrame, metadata_keys: list[str], sample_keys: Column | None = None) -> DataFrame:
    """pos and issue: of the whole (pos null) and of each track. sample_keys: the keys that a row's JSON holds, where known."""
    spark = samples.sparkSession
    given = sample_keys if sample_keys is not None else F.array(*[F.lit(c) for c in samples.columns])
    missing = F.transform(F.array_except(F.array(*[F.lit(c) for c in REQUIRED_SAMPLE]), given), lambda k: F.concat(F.lit("missing_key:"), k))
    own = F.concat(
        missing,
        F.array_compact(F.array(F.when(F.col("is_instrumental") & ((T.text_of(F.col("lyrics")) != "") | (T.text_of(F.col("formatted_lyrics")) != "")), "instrumental_with_lyrics"))),
        F.when(T.strip(F.col("caption")) == "", F.array(F.lit("no_caption"))).otherwise(F.transform(caption_issues(F.col("caption")), lambda i: F.concat(F.lit("caption:"), i))),
        F.array_compact(F.array(F.when((F.col("bpm") != 0) & ~F.col("bpm").between(1, 300), F.concat(F.lit("bpm_out_of_range:"), F.col("bpm").cast("string"))))),
    )
    rows = samples.select("pos", F.explode(own).alias("issue"))
    whole = [(f"metadata_missing:{k}",) for k in REQUIRED_METADATA if k not in metadata_keys]
    if samples.isEmpty():
        whole.append(("no_samples",))
    return rows.unionByName(spark.createDataFrame(whole, "issue string").select(F.lit(None).cast("long").alias("pos"), "issue"))


def gaps(samples: DataFrame, existing_paths: DataFrame | None = None) -> DataFrame:
    """pos, filename and issues of each track. A blank language counts twice: as missing, and by its own issue."""
    blank = lambda c: T.strip(F.col(c).cast("string")) == ""
    lacks = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(0)) == 0 if c == "bpm" else blank(c), c) for c in REQUIRED_FOR_TRAINING]))
    lyrics = T.strip(F.col("lyrics"))
    if existing_paths is not None:
        samples = samples.join(existing_paths.select(F.col("path").alias("audio_path"), F.lit(True).alias("_there")).distinct(), "audio_path", "left")
    else:
        samples = samples.withColumn("_there", F.lit(None).cast("boolean"))
    issues = F.array_compact(
        F.array(
            F.when(F.size(lacks) > 0, F.concat(F.lit("missing:"), F.array_join(lacks, "/"))),
            F.when(blank("language"), "no_language"),
            F.when(F.col("is_instrumental") & (lyrics != ""), "instrumental_with_lyrics"),
            F.when(~F.col("is_instrumental") & (lyrics == ""), "no_lyrics"),
            F.when((lyrics != "") & ~F.contains(lyrics, F.lit("[")), "no_sections"),
        )
    )
    caption = F.when(T.strip(F.col("caption")) == "", F.array().cast("array<string>")).otherwise(F.transform(caption_issues(F.col("caption")), lambda i: F.concat(F.lit("caption:"), i)))
    audio = F.array_compact(F.array(F.when(F.col("virtual"), "virtual").when(F.col("_there").isNull(), "audio_missing")))
    name = T.first_of(F.col("filename"), F.concat(F.lit("track "), (F.col("pos") + 1).cast("string")))
    return samples.select("pos", name.alias("filename"), F.concat(issues, caption, audio).alias("issues"))


def duplicate_names(samples: DataFrame) -> DataFrame:
    """File names that several tracks have, and how many."""
    return samples.groupBy("filename").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def audit(samples: DataFrame) -> DataFrame:
    """pos, filename, instruments found in the caption (null without one) and its issues."""
    body = T.strip(F.col("caption"))
    found = T.bound(F.lower(body), lambda low: F.filter(F.array(*[F.lit(i) for i in INSTRUMENTS]), lambda i: F.contains(low, i)))
    return samples.select("pos", "filename", F.when(body != "", found).alias("instruments"), F.when(body != "", caption_issues(F.col("caption"))).alias("issues"))


def casing_variants(samples: DataFrame) -> DataFrame:
    """Instrument names written in several ways. A phrase counts only if it is a name as a whole, as the pattern is greedy."""
    tokens = samples.select(F.explode(F.regexp_extract_all("caption", F.lit(r"(?U)\b[A-Za-z][A-Za-z0-9' -]{2,}\b"), F.lit(0))).alias("token"))
    known = tokens.filter(F.lower("token").isin(list(INSTRUMENTS)))
    return known.groupBy(F.lower("token").alias("instrument")).agg(F.array_sort(F.collect_set("token")).alias("variants")).filter(F.size("variants") > 1)


def flag_lines(lyrics: DataFrame, text: str = "lyrics") -> DataFrame:
    """An extension: each lyric line with its syllables, whether they are in the singable range and whether it is flagged."""
    lines = lyrics.select("pos", F.posexplode(F.split(T.text_of(F.col(text)), "\n")).alias("line_no", "line")).filter(~F.trim("line").startswith("[") & (F.trim("line") != ""))
    n = T.count_syllables(F.col("line"))
    return lines.withColumn("syllables", n).withColumn("in_range", n.between(*LINE_SYLLABLES)).withColumn("flagged", n > LINE_FLAG)


def newest(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The last ``most`` rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("_r") <= most).drop("_r")
