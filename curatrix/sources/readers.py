"""Sources: manifests, results, listings and small configuration files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.sources import store

# Audio suffixes of the folder scan.
SCANNED = (
    "wav", "flac", "aiff", "aif", "aifc", "alac", "ape", "wv", "tta", "au",
    "mp3", "m4a", "aac", "ogg", "oga", "opus", "wma", "ac3", "amr", "mp2",
    "webm", "mkv", "mp4", "caf", "rf64", "bwf",
)
# The markers offered where no file lists any.
SECTION_MARKERS = ("[Intro]", "[Verse]", "[Chorus]", "[Bridge]", "[Outro]")
SAMPLE_JSON = (
    "id string, audio_path string, filename string, caption string, genre string, lyrics string, raw_lyrics string, formatted_lyrics string, bpm double, keyscale string, timesignature string, "
    "duration double, language string, is_instrumental boolean, custom_tag string, labeled boolean, prompt_override string, virtual boolean, detected_instruments string, caption_ai_raw string"
)


#: The first and the last line of a document whose samples stand one on a line, as ``writers.write_json`` writes it.
HEAD_LINE, TAIL_LINE = r'^\{"metadata": (\{.*\}), "samples": \[$', "]}"


def dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """metadata (one row, raw) and samples (pos, keys, typed fields) of a manifest in one JSON document.

    keys holds the names that a row's JSON really has, so absent and null can be told apart.  A document with a sample on each line is read in
    splits, so no task holds it; one of any other layout is one value, which a task has to hold.
    """
    found = _dataset_by_lines(spark, path)
    if found is None:
        doc = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.metadata").alias("metadata"), F.from_json(F.get_json_object("value", "$.samples"), "array<string>").alias("samples"))
        found = doc.select("metadata"), doc.select(F.posexplode("samples").alias("pos", "raw"))
    metadata, rows = found
    rows = rows.select(F.col("pos").cast("long").alias("pos"), F.json_object_keys("raw").alias("keys"), F.from_json("raw", SAMPLE_JSON).alias("s"))
    return metadata, rows.select("pos", "keys", "s.*")


def _dataset_by_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """metadata, and pos and raw of the samples, if every line but the first and the last is one sample; else None.

    A line's place is its number within its split, and the lines of the splits before; both readings cut the file into the same splits.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    body = F.concat(F.lit("["), F.regexp_replace("value", "^,", ""), F.lit("]"))
    lines = lines.withColumns({"head": F.col("value").rlike(HEAD_LINE), "tail": F.col("value") == TAIL_LINE, "own": F.from_json(body, "array<string>")})
    sample = (F.size("own") == 1) & F.get("own", F.lit(0)).startswith("{") & F.json_object_keys(F.get("own", F.lit(0))).isNotNull()
    number = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    splits = lines.groupBy("file", "split").agg(
        F.count(F.lit(1)).alias("lines"), F.min("n").alias("first"), F.max("n").alias("last"), number(F.col("head")).alias("heads"), number(F.col("tail")).alias("tails"), number(sample).alias("samples"),
        number(sample & ~F.col("value").startswith(",")).alias("bare"), F.min_by(F.col("head"), "n").alias("begins"), F.max_by(F.col("tail"), "n").alias("ends"), F.max(F.when(F.col("head"), F.col("value"))).alias("text"),
    ).collect()  # as many rows as the file has splits
    splits.sort(key=lambda r: r.split)
    if len({r.file for r in splits}) != 1 or not splits[0].begins or not splits[-1].ends:
        return None
    total = {c: sum(r[c] for r in splits) for c in ("lines", "heads", "tails", "samples", "bare")}
    if total["heads"] != 1 or total["tails"] != 1 or total["samples"] != total["lines"] - 2 or total["bare"] != min(1, total["samples"]) or any(r.last - r.first + 1 != r.lines for r in splits):
        return None
    before, starts = -1, []  # the head takes a place
    for r in splits:
        starts.append((r.split, before - r.first))
        before += r.lines
    own = lines.filter(~F.col("head") & ~F.col("tail")).join(F.broadcast(spark.createDataFrame(starts, "split long, shift long")), "split")
    metadata = spark.createDataFrame([(splits[0].text,)], "value string").select(F.get_json_object(F.concat("value", F.lit("]}")), "$.metadata").alias("metadata"))
    return metadata, own.select((F.col("n") + F.col("shift")).alias("pos"), F.get("own", F.lit(0)).alias("raw"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modificationTime of all files below a folder but empty ones; contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def small_listing(spark: SparkSession, path: str) -> DataFrame:
    """path and length of the files in one folder, empty ones too; listed by the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return spark.createDataFrame([(str(f.getPath()), f.getLen()) for f in found if f.isFile()], "path string, length long")


def audio_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SCANNED) -> DataFrame:
    """Audio files of a folder, by suffix, case apart, in the order of their paths."""
    return listing(spark, path).filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)).orderBy("path")


def nearest_audio(spark: SparkSession, path: str, whole: str, suffixes: tuple[str, ...] = T.AUDIO) -> DataFrame:
    """Audio files of a folder; those of the whole tree where it has none."""
    found = audio_files(spark, path, suffixes)
    return audio_files(spark, whole, suffixes) if found.isEmpty() else found


def add_paths(samples: DataFrame, paths: DataFrame, tag: str = "", instrumental: bool = False) -> DataFrame:
    """Tracks for paths that are not there yet, behind the others in the order of (pos, path), or of the paths where they have no pos.

    They inherit the dataset's tag and instrumental flag, and are blank otherwise; ids are eight hexadecimal digits of the path's hash.  Positions are
    given by ranges, whose counts come first, so that no task orders all paths.
    """
    order = "pos" if "pos" in paths.columns else "path"
    own = paths.groupBy(F.col("path").alias("audio_path")).agg(F.min(order).alias("_order")).join(samples.select("audio_path").distinct(), "audio_path", "left_anti")
    new = own.withColumns({"id": F.substring(F.md5(F.col("audio_path").cast("binary")), 1, 8), "filename": T.basename(F.col("audio_path")), "language": F.lit("en"), "is_instrumental": F.lit(instrumental), "custom_tag": F.lit(tag.strip())})
    if "pos" in samples.columns:
        new = _behind(new, (samples.agg(F.max("pos")).first()[0] or 0) + 1 if not samples.isEmpty() else 0)
    blank = {c: F.lit("") for c, kind in samples.dtypes if kind == "string" and c not in new.columns}
    return samples.unionByName(new.withColumns(blank).drop("_order", "_part", "_n", "_before"), allowMissingColumns=True)


def _behind(rows: DataFrame, first: int) -> DataFrame:
    """pos from ``first`` on, in the order of _order. Ranges are written before they are counted, for a range of another run would be another one."""
    spark, folder = rows.sparkSession, store.shared_folder(rows.sparkSession, "ranges")
    rows.repartitionByRange("_order", "audio_path").withColumn("_part", F.spark_partition_id()).write.parquet(folder)
    sorted_rows = spark.read.parquet(folder)
    starts = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = starts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_order", "audio_path"))
    return sorted_rows.join(before, "_part").withColumn("pos", (F.lit(first - 1) + F.col("_before") + rank).cast("long"))


def import_csv(spark: SparkSession, path: str) -> DataFrame:
    """song_id, time_signature, tempo_bpm, caption, lyrics."""
    return spark.read.schema("song_id string, time_signature string, tempo_bpm double, caption string, lyrics string").csv(path, header=True, multiLine=True, escape='"')


def results(spark: SparkSession, path: str) -> DataFrame:
    """pos, file and caption of a results document; anything else than an object with a list of results raises on reading."""
    rows = spark.read.text(path, wholetext=True)
    own = F.from_json(F.get_json_object("value", "$.results"), "array<struct<file: string, caption: string>>")
    return rows.select(F.posexplode(F.coalesce(own, F.raise_error(F.lit("no list of results")).cast("array<struct<file: string, caption: string>>"))).alias("pos", "r")).select("pos", "r.file", "r.caption")


def staging_report(files: DataFrame) -> DataFrame:
    """name and reason (null: usable) of the files of a staging folder; the first reason that holds. files: path, length."""
    name, suffix = T.basename(F.col("path")), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = F.when(suffix == "part", "interrupted transcode").when(name == "dataset-metadata.json", "metadata, not audio").when(~suffix.isin(list(T.AUDIO)), "unsupported format").when(F.col("length") == 0, "empty or unreadable")
    return files.select(name.alias("name"), reason.alias("reason"))


def term_lines(lines: DataFrame) -> DataFrame:
    """Terms of (pos, line): blanks and # lines left out, of terms equal but for case the first spelling."""
    own = lines.withColumn("term", T.strip(F.col("line"))).filter((F.col("term") != "") & ~F.col("term").startswith("#"))
    return own.groupBy(F.lower("term").alias("_k")).agg(F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos")).select("pos", "term")


def section_markers(lines: DataFrame | None) -> DataFrame:
    """pos and marker of (pos, line): blanks and # lines left out; the built-in markers where no lines are given."""
    if lines is None:
        return SparkSession.active().createDataFrame(list(enumerate(SECTION_MARKERS)), "pos int, marker string")
    return lines.filter((T.strip(F.col("line")) != "") & ~F.col("line").startswith("#")).select("pos", T.strip(F.col("line")).alias("marker"))


def structure(spark: SparkSession, path: str, file: str) -> DataFrame:
    """seq and the fields of the segments found for one file; no rows where the document does not name it."""
    rows = spark.read.text(path, wholetext=True)
    kind = "array<struct<file: string, segments: array<struct<name: string, start: double, end: double>>>>"
    own = rows.select(F.explode(F.from_json(F.get_json_object("value", "$.results"), kind)).alias("r")).filter(T.basename(F.col("r.file")) == F.lit(file.rsplit("/", 1)[-1]))
    return own.select(F.posexplode("r.segments").alias("seq", "s")).select("seq", "s.*")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """artist (null: general), facet, pos and term of a vocabulary document; names with a leading underscore are notes."""
    doc = spark.read.text(path, wholetext=True)
    artists = doc.select(F.explode(F.from_json(F.get_json_object("value", "$.artists"), "map<string, map<string, array<string>>>")).alias("artist", "facets"))
    general = doc.select(F.lit(None).cast("string").alias("artist"), F.from_json(F.get_json_object("value", "$.general"), "map<string, array<string>>").alias("facets"))
    rows = artists.unionByName(general.filter("facets is not null"))
    return rows.select("artist", F.explode(F.map_filter("facets", lambda k, v: ~k.startswith("_"))).alias("facet", "terms")).select("artist", "facet", F.posexplode("terms").alias("pos", "term"))


def overlay(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both, by key in small letters; the second's win."""
    low = lambda df, n: df.withColumns({key: F.lower(key), "_o": F.lit(n)})
    both = low(first, 0).unionByName(low(second, 1))
    others = [c for c in first.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*others), "_o").alias("v")).select(key, *[F.col(f"v.{c}") for c in others])


def stem_files(files: DataFrame, bases: DataFrame) -> DataFrame:
    """base, stem_type and path of imported stems <base>_<stem>.<suffix>; of several suffixes the last of wav, flac, mp3."""
    own = F.regexp_extract(T.basename(F.col("path")), r"^(.*)_(vocals|drums|bass|other)\.(wav|flac|mp3)$", 0)
    part = lambda i: F.regexp_extract(own, r"^(.*)_(vocals|drums|bass|other)\.(wav|flac|mp3)$", i)
    rows = files.select("path", part(1).alias("base"), part(2).alias("stem_type"), F.array_position(F.array(*map(F.lit, ("wav", "flac", "mp3"))), part(3)).alias("rank")).filter("rank > 0")
    return rows.join(bases.select("base").distinct(), "base", "left_semi").groupBy("base", "stem_type").agg(F.max_by("path", "rank").alias("path"))


def stem_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """track, stem, path and flat name of a manifest map track -> stem -> path; entries without a file are left out."""
    rows = manifest.select(F.explode("manifest").alias("track", "stems")).select("track", F.explode("stems").alias("stem", "path"))
    return rows.join(files.select("path").distinct(), "path", "left_semi").withColumn("flat", F.concat("track", F.lit("__"), "stem"))


def marked_json(text, begin: str, end: str, schema: str):
    """The JSON between the first pair of markers, null if there is none or it can't be read."""
    tail = F.when(F.contains(text, F.lit(begin)), F.substring(text, F.instr(text, begin) + len(begin), F.length(text)))
    return F.from_json(F.when(F.contains(tail, F.lit(end)), F.substring_index(tail, end, 1)), schema)


def log_stdout(text):
    """The stdout events of a JSON log, joined in order; other texts as they are."""
    events = F.from_json(text, "array<struct<stream_name: string, time: double, data: string>>")
    return F.coalesce(F.array_join(F.transform(F.filter(events, lambda e: e["stream_name"] == "stdout"), lambda e: e["data"]), ""), text)


def split_output(text, first: str = "CAPTION:", second: str = "LYRICS:"):
    """Caption and lyrics around their markers."""
    caption = F.trim(F.substring_index(T.text_of(F.when(F.contains(text, F.lit(first)), F.substring(text, F.instr(text, first) + len(first), F.length(text))).otherwise(text)), second, 1))
    lyrics = F.when(F.contains(text, F.lit(second)), F.trim(F.substring(text, F.instr(text, second) + len(second), F.length(text)))).otherwise("")
    return F.struct(caption.alias("caption"), lyrics.alias("lyrics"))


# --- typed documents: a VARIANT of each file, and Columns that give every field its type


def documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, value and doc (VARIANT; null for a file that is no JSON object)."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.withColumn("doc", F.when(F.ltrim("value").startswith("{"), F.try_parse_json("value")))


def truth(doc: Column, field: str, absent: bool) -> Column:
    """Whether a field holds something: not false, null, 0, an empty text, list or object; ``absent`` where it is not there."""
    own = F.to_json(F.try_variant_get(doc, f"$.{field}", "variant"))
    return F.when(own.isNull(), F.lit(absent)).otherwise(~own.isin("false", "null", "0", "0.0", "-0.0", '""', "[]", "{}"))


def typed_profiles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, profile (null for a corrupt file): name, contractions, ing_exceptions, case_fixed (sorted), three flags and notes, each with its default where the file lacks it or has something empty."""
    docs = documents(spark, paths).withColumn("file", F.regexp_replace(T.basename(F.col("path")), r"(?i)\.json$", ""))
    get = lambda field, kind: F.try_variant_get("doc", f"$.{field}", kind)
    words = lambda field: F.coalesce(get(field, "array<string>"), F.array().cast("array<string>"))
    profile = F.struct(
        F.coalesce(F.nullif(get("name", "string"), F.lit("")), "file").alias("name"),
        F.coalesce(get("contractions", "map<string, string>"), F.create_map().cast("map<string, string>")).alias("contractions"),
        words("ing_exceptions").alias("ing_exceptions"), F.array_sort(words("case_fixed")).alias("case_fixed"),
        truth(F.col("doc"), "ing_to_in", False).alias("ing_to_in"), truth(F.col("doc"), "capitalize_tags", True).alias("capitalize_tags"), truth(F.col("doc"), "strip_punctuation", True).alias("strip_punctuation"),
        F.coalesce(get("notes", "string"), F.lit("")).alias("notes"),
    )
    return docs.select("file", F.when(F.col("doc").isNotNull(), profile).alias("profile"))


def models(spark: SparkSession, path: str) -> DataFrame:
    """pos and the typed fields of the models of a catalog document; texts that are absent are empty, flags false."""
    own = F.try_variant_get("doc", "$.models", "array<variant>")
    rows = documents(spark, path).select(F.posexplode(own).alias("pos", "m"))
    field = lambda name: F.coalesce(F.try_variant_get("m", f"$.{name}", "string"), F.lit("")).alias(name)
    return rows.select("pos", *[field(n) for n in ("id", "name", "role", "preferred_backend", "hf_repo", "github_url", "note")], truth(F.col("m"), "default", False).alias("default"))


def find_model(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first model of each id asked for; no row for an unknown one. wanted: id."""
    first = catalog.groupBy("id").agg(F.min_by(F.struct(*[c for c in catalog.columns if c != "id"]), "pos").alias("m"))
    return wanted.select("id").distinct().join(first, "id").select("id", "m.*")


def leaderboards(spark: SparkSession, path: str) -> DataFrame:
    """pos, name and url of a catalog's leaderboards."""
    rows = documents(spark, path).select(F.posexplode(F.try_variant_get("doc", "$.leaderboards", "array<variant>")).alias("pos", "b"))
    return rows.select("pos", *[F.coalesce(F.try_variant_get("b", f"$.{n}", "string"), F.lit("")).alias(n) for n in ("name", "url")])


def downloaded(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """id and downloaded: whether a folder named after the model holds any file. files: path."""
    folders = files.select(F.explode(F.split("path", "/")).alias("id")).distinct()
    return catalog.select("id").join(folders.withColumn("_there", F.lit(True)), "id", "left").select("id", F.col("_there").isNotNull().alias("downloaded"))


def profiles(spark: SparkSession, paths: list[str], defaults: dict[str, str]) -> DataFrame:
    """Small JSON settings with defaults for what they lack, as texts. defaults: name to an SQL literal."""
    raw = spark.read.text(paths, wholetext=True)
    return raw.select(*[F.coalesce(F.get_json_object("value", f"$.{k}"), F.expr(v).cast("string")).alias(k) for k, v in defaults.items()])
