"""Sinks: manifests, tables, sidecar files, folders. Tables go through Spark's commit protocol, files under temporary names that are moved into place."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators.edits import to_export
from curatrix.operators.filters import for_export
from curatrix.operators.sequences import build_block, lrc, split_dataset
from curatrix.sources import store

# The columns of the CSV export.
CSV_COLUMNS = ("id", "filename", "audio_path", "genre", "bpm", "keyscale", "duration", "is_instrumental", "custom_tag", "caption")
#: The formats of ``export``.
FORMATS = ("json", "csv", "jsonl", "sidecar", "folders")


def write_lines(head: list[str], rows: DataFrame, tail: list[str], path: str, end: str = "\n") -> None:
    """One text file in a folder of its own: the head, ``line`` of the rows in the order of their ``at``, the tail.

    Rows are sorted by ranges, and one task then passes them on one by one, so no task holds the document.
    """
    kind = rows.schema["at"].dataType.simpleString()
    every = rows.select(F.lit(1).alias("part"), "at", F.lit(0).alias("k"), "line")
    for part, lines in ((0, head), (2, tail)):
        if lines:
            every = every.unionByName(rows.sparkSession.createDataFrame([(part, None, k, x) for k, x in enumerate(lines)], f"part int, at {kind}, k int, line string"))
    every.orderBy("part", "at", "k", "line").select("line").coalesce(1).write.mode("overwrite").option("lineSep", end).text(path)


def _listed(rows: DataFrame) -> DataFrame:
    """at and line of (at, json): the elements of a JSON list, a comma before all but the first."""
    first = rows.agg(F.min(F.struct("at", "json")).alias("f")).first().f
    is_first = (F.col("at").eqNullSafe(F.lit(first.at)) & (F.col("json") == F.lit(first.json))) if first else F.lit(True)
    return rows.select("at", F.when(is_first, F.col("json")).otherwise(F.concat(F.lit(","), "json")).alias("line"))


def write_json(samples: DataFrame, metadata: dict, path: str) -> None:
    """One document {metadata, samples}, a sample a line, in the order of the dataset (of the ids where it has no pos)."""
    own = for_export(samples)
    rows = to_export(own, F.col("pos" if "pos" in own.columns else "id").alias("at"))
    rows = rows.select("at", F.to_json(F.struct(*[c for c in rows.columns if c != "at"]), {"ignoreNullFields": "false"}).alias("json"))
    head = {k: v for k, v in metadata.items() if k != "instrumental_mode"} | {"num_samples": own.count()}
    write_lines([f'{{"metadata": {json.dumps(head, ensure_ascii=False)}, "samples": ['], _listed(rows), ["]}"], path)


def write_jsonl(samples: DataFrame, path: str) -> None:
    to_export(for_export(samples)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def csv_cell(x: Column, kind: str) -> Column:
    """A value as a CSV cell: nulls empty, booleans True or False, quoted only where it holds a comma, a quote or a line's end."""
    text = F.when(x, "True").otherwise("False") if kind == "boolean" else x.cast("string")
    text = F.coalesce(F.when(x.isNotNull(), text), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(samples: DataFrame) -> DataFrame:
    """at and line: the ten columns of every exported track; absent ones are empty."""
    own, kinds = for_export(samples), dict(samples.dtypes)
    cells = [csv_cell(F.col(c), kinds[c]) if c in kinds else F.lit("") for c in CSV_COLUMNS]
    return own.select(F.col("pos" if "pos" in kinds else "id").alias("at"), F.concat_ws(",", *cells).alias("line"))


def write_csv(samples: DataFrame, path: str) -> None:
    """A header and a line for each track, ended by carriage return and line feed."""
    write_lines([",".join(CSV_COLUMNS)], csv_lines(samples), [], path, "\r\n")


def caption_or_tag():
    """The text of a caption file."""
    return T.first_of(T.strip(F.col("caption")), T.strip(F.col("custom_tag")))


def sidecars(samples: DataFrame) -> DataFrame:
    """name and text of the caption files: caption, else tag; tracks without path are left out, of equal names the last wins."""
    own = for_export(samples).filter(F.trim(T.text_of(F.col("audio_path"))) != "")
    text = caption_or_tag()
    return own.groupBy(F.concat(T.stem(F.col("audio_path")), F.lit(".txt")).alias("name")).agg(F.max_by(text, "pos").alias("text"))


def write_files(files: DataFrame, folder: str) -> None:
    """Each row (name, text) as a file of its own, written by the tasks through a temporary name, in any store that all of them reach."""
    store.write_binaries(files.select("name", T.text_of(F.col("text")).cast("binary").alias("content")), folder)


def write_folders(samples: DataFrame, path: str, ratio: float = 0.2) -> DataFrame:
    """Exported rows partitioned by split; returns the sizes of the splits."""
    own = split_dataset(for_export(samples), ratio)
    own.write.mode("overwrite").partitionBy("split").parquet(path)
    return own.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def folder_files(samples: DataFrame, ratio: float = 0.2, stratify: bool = True) -> DataFrame:
    """split, name and text of the caption files of a train and validation export, and the fields of its manifest; tracks without path are left out."""
    own = split_dataset(for_export(samples), ratio, stratify=stratify).filter(T.strip(F.col("audio_path")) != "")
    return own.select("pos", "split", F.concat(T.stem(F.col("audio_path")), F.lit(".txt")).alias("name"), caption_or_tag().alias("text"), "audio_path", T.basename(F.col("audio_path")).alias("filename"), "genre", "bpm", "keyscale", "duration")


def folder_manifest(files: DataFrame) -> DataFrame:
    """at and json: the tracks of the export's manifest, train before val, in the order of the dataset."""
    return files.select((F.col("pos") + F.when(F.col("split") == "val", 1 << 60).otherwise(0)).alias("at"), F.to_json(F.struct("split", "filename", "genre", "bpm", "keyscale", "duration", F.col("text").alias("caption")), {"ignoreNullFields": "false"}).alias("json"))


def export_folders(samples: DataFrame, path: str, ratio: float = 0.2, stratify: bool = True) -> dict[str, int]:
    """Copies the audio of both splits to ``train`` and ``val``, with caption files beside it and a manifest; returns the sizes of the splits.

    Tracks whose audio is not there keep their place in the split but have no files and are not in the manifest.  Audio is copied by the tasks; a rerun copies only what is missing.
    Of tracks with one base name in a split, the last one's caption stays.
    """
    spark, own = samples.sparkSession, split_dataset(for_export(samples), ratio, stratify=stratify)
    sizes = {r.split: r.n for r in own.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    files = folder_files(samples, ratio, stratify)
    pairs = files.select("pos", F.col("audio_path").alias("source"), F.concat(F.lit(f"{path}/"), "split", F.lit("/"), "filename").alias("target"))
    # the last of a target's tracks is copied
    last = pairs.groupBy("target").agg(F.max_by("source", "pos").alias("source"))
    states = store.shared_folder(spark, "copies")
    store.copy_files(last.select("source", "target")).write.parquet(states)
    there = spark.read.parquet(states).filter("state <> 'missing'").select("source").distinct()
    kept = files.join(there.withColumnRenamed("source", "audio_path"), "audio_path", "left_semi")
    for split in ("train", "val"):
        captions = kept.filter(F.col("split") == split).groupBy("name").agg(F.max_by("text", "pos").alias("text"))
        write_files(captions, f"{path}/{split}")
    head = f'{{"val_ratio": {json.dumps(ratio)}, "stratify": {json.dumps(stratify)}, "tracks": ['
    write_lines([head], _listed(folder_manifest(kept)), ["]}"], f"{path}/manifest.json")
    return {split: sizes.get(split, 0) for split in ("train", "val")}


def export(samples: DataFrame, metadata: dict, path: str, formats: set[str], ratio: float = 0.2) -> list[str]:
    """Write the formats asked for, planned tracks left out of all; returns those written."""
    if unknown := formats - set(FORMATS):
        raise ValueError(f"unknown formats {sorted(unknown)}")
    own = for_export(samples)
    sinks = {
        "json": lambda: write_json(own, metadata, f"{path}/dataset.json"),
        "csv": lambda: write_csv(own, f"{path}/dataset.csv"),
        "jsonl": lambda: write_jsonl(own, f"{path}/dataset.jsonl"),
        "sidecar": lambda: write_files(sidecars(own), f"{path}/captions"),
        "folders": lambda: export_folders(own, path, ratio),
    }
    done = [f for f in FORMATS if f in formats]
    for f in done:
        sinks[f]()
    return done


def blocks(samples: DataFrame) -> DataFrame:
    """All lyrics as blocks, in order."""
    return samples.select("pos", build_block(samples).alias("block")).orderBy("pos")


def lrc_files(samples: DataFrame) -> DataFrame:
    """name and text of timed lyrics. samples: filename, segments (start, text), lyrics."""
    return samples.select(F.concat(T.stem(F.col("filename")), F.lit(".lrc")).alias("name"), lrc(F.col("segments"), F.col("lyrics")).alias("text"))
