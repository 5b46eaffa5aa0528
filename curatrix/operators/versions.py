"""Snapshots of a dataset and row-level differences. A version is a Parquet folder and a line of the manifest beside it."""

from __future__ import annotations

import itertools
import json
import uuid

from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.sources import store


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def save_version(samples: DataFrame, root: str, stamp: str, label: str = "") -> str:
    """Write a version; its manifest appears last, so a version without one was never completed."""
    name = f"v_{stamp}" + (f"_{label[:30]}" if label else "")
    samples.write.parquet(f"{root}/{name}/data")
    n = samples.sparkSession.read.parquet(f"{root}/{name}/data").count()
    line = json.dumps({"name": name, "stamp": stamp, "label": label[:30], "tracks": n})
    samples.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{root}/{name}/manifest")
    return name


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    """name, stamp, label, tracks: newest first; versions without a readable manifest are left out."""
    fs, where = _fs(spark, root)
    paths = [str(s.getPath()) for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/manifest"))] if fs.exists(where) else []
    kind = "name string, stamp string, label string, tracks long"
    if not paths:
        return spark.createDataFrame([], kind)
    rows = spark.read.text(paths).select(F.from_json("value", kind).alias("m")).select("m.*")
    return rows.filter("name is not null").orderBy(F.desc("stamp"))


def load_version(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/data")


def diff_rows(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """key, change (added, removed, changed) and the names of the columns that differ, nulls compared as values."""
    columns = [c for c in a.columns if c != key and c in b.columns]
    left = a.select(F.col(key), F.struct(*columns).alias("_a"))
    right = b.select(F.col(key), F.struct(*columns).alias("_b"))
    both = left.join(right, key, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in columns]))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(differ) > 0, "changed")
    return both.select(key, change.alias("change"), F.when(change == "changed", differ).alias("columns")).filter("change is not null")


# --- the current state of a dataset: versions of their own, and a pointer that is moved in one step


def _contents(spark: SparkSession, path: str) -> str | None:
    fs, where = _fs(spark, path)
    return spark.read.text(path, wholetext=True).first()[0].strip() if fs.exists(where) else None


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that is not there yet."""
    fs, where = _fs(spark, path)
    out = fs.create(where, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Rename in one step, over a file that is there."""
    jvm, hadoop = spark._jvm, spark._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    where = hadoop.Path(target)
    hadoop.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else jvm.java.net.URI("file:///"), spark.sparkContext._jsc.hadoopConfiguration()).rename(hadoop.Path(source), where, options)


def save_current(samples: DataFrame, metadata: dict, root: str, stamp: str) -> str:
    """Save a dataset so that readers see the whole old state or the whole new one; returns the version's name.

    The version is written to a folder of its own and read back; the pointer that is there is copied to ``CURRENT.bak-<stamp>`` (with a number where
    that name is taken), and nothing is moved if that fails; at last a new pointer is renamed over ``CURRENT``.  A writer that
    dies before the last step leaves the old state current, and a version that no pointer names.
    """
    spark, name = samples.sparkSession, f"{stamp}-{uuid.uuid4().hex[:12]}"
    samples.write.parquet(f"{root}/versions/{name}/data")
    n = spark.read.parquet(f"{root}/versions/{name}/data").count()
    _put(spark, f"{root}/versions/{name}/metadata.json", json.dumps(metadata | {"num_samples": n}, ensure_ascii=False))
    if (old := _contents(spark, f"{root}/CURRENT")) is not None:
        _put(spark, _free(spark, f"{root}/CURRENT.bak-{stamp}"), old)
    _put(spark, f"{root}/CURRENT.{name}", name)
    _move(spark, f"{root}/CURRENT.{name}", f"{root}/CURRENT")
    return name


def _free(spark: SparkSession, path: str) -> str:
    """The path, or the first of path-1, path-2 ... that is not there."""
    names = itertools.chain([path], (f"{path}-{k}" for k in itertools.count(1)))
    return next(p for p in names if not _fs(spark, p)[0].exists(_fs(spark, p)[1]))


def load_current(spark: SparkSession, root: str) -> tuple[dict, DataFrame]:
    """metadata and samples of the version that the pointer names."""
    name = _contents(spark, f"{root}/CURRENT")
    if name is None:
        raise FileNotFoundError(f"{root}/CURRENT")
    return json.loads(_contents(spark, f"{root}/versions/{name}/metadata.json")), spark.read.parquet(f"{root}/versions/{name}/data")


def restore_backup(spark: SparkSession, root: str, backup: str) -> str:
    """Make the version of a backup current again; the pointer that is there is kept beside it, as when a dataset is saved."""
    name = _contents(spark, f"{root}/{backup}")
    stamp = backup.removeprefix("CURRENT.bak-")
    _put(spark, _free(spark, f"{root}/CURRENT.bak-{stamp}"), _contents(spark, f"{root}/CURRENT") or "")
    part = f"{root}/CURRENT.{uuid.uuid4().hex}"
    _put(spark, part, name)
    _move(spark, part, f"{root}/CURRENT")
    return name


def backups(spark: SparkSession, root: str) -> list[str]:
    """The names of the pointers that were replaced, oldest first."""
    fs, _ = _fs(spark, root)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT.bak-*")) or []
    return sorted(f.getPath().getName() for f in found)


def prune(spark: SparkSession, root: str) -> list[str]:
    """Remove the versions that neither the pointer nor a backup names (writers that died leave such); returns their names. Not to run beside a writer."""
    named = {_contents(spark, f"{root}/{b}") for b in ["CURRENT", *backups(spark, root)]}
    fs, _ = _fs(spark, root)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/*")) or []
    gone = [f.getPath() for f in found if f.getPath().getName() not in named]
    for path in gone:
        fs.delete(path, True)
    return sorted(p.getName() for p in gone)


class History:
    """Undo and redo as moves of a pointer along saved versions; at most ``most`` are reachable."""

    def __init__(self, most: int = 50):
        self.names: list[str] = []
        self.at, self.most = -1, most

    def push(self, name: str) -> None:
        self.names = [*self.names[: self.at + 1], name][-self.most :]
        self.at = len(self.names) - 1

    def undo(self) -> str | None:
        if self.at <= 0:
            return None
        self.at -= 1
        return self.names[self.at]

    def redo(self) -> str | None:
        if self.at + 1 >= len(self.names):
            return None
        self.at += 1
        return self.names[self.at]


def soft_delete(samples: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays and what goes to the table of deleted rows."""
    return samples.join(ids.select("id").distinct(), "id", "left_anti"), samples.join(ids.select("id").distinct(), "id", "left_semi")


def delete_with_backup(samples: DataFrame, ids: DataFrame, folder: str, stamp: str) -> DataFrame:
    """What stays, once the audio and the rows of what goes are kept in ``folder``.

    A track's audio keeps its base name; a name that is taken, there or by another track that goes, gets the stamp and the track's id.  Rows are appended as Parquet
    under the stamp.  Tracks whose audio is not there are kept as rows only.
    """
    spark, (stays, goes) = samples.sparkSession, soft_delete(samples, ids)
    own, root = store.opened(folder)
    own.create_dir(root, recursive=True)
    taken = spark.createDataFrame([(f.base_name,) for f in own.get_file_info(FileSelector(root))], "name string").distinct()
    named = goes.filter(T.strip(F.col("audio_path")) != "").select("id", F.col("audio_path").alias("source"), T.basename(F.col("audio_path")).alias("name"))
    firsts = named.groupBy("name").agg(F.min("id").alias("first")).join(taken.withColumn("there", F.lit(True)), "name", "left")
    bare, suffix = T.splitext(F.col("name"))
    target = F.when((F.col("id") == F.col("first")) & F.col("there").isNull(), F.col("name")).otherwise(F.concat(bare, F.lit(f"_{stamp}-"), F.col("id"), suffix))
    copies = named.join(firsts, "name").select("id", "source", F.concat(F.lit(f"{folder}/"), target).alias("target"))
    goes.write.mode("append").parquet(f"{folder}/rows/stamp={stamp}")
    store.copy_files(copies.select("source", "target")).write.mode("append").parquet(f"{folder}/copies/stamp={stamp}")
    return stays
