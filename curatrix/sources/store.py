"""Files in any store that pyarrow can open (a shared folder, HDFS, an object store), read and written by tasks."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.packing import ship

#: Bytes copied at once.
PIECE = 4 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or address, and the path in it."""
    if uri.startswith("file:/"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def put(store: fs.FileSystem, path: str, pieces: Iterator[bytes]) -> int:
    """Write a file under a temporary name beside it and move it into place; bytes written.

    A task that dies leaves no part of a file under its name, and tasks that write one file at once don't mix.
    """
    folder, name = posixpath.split(path)
    store.create_dir(folder, recursive=True)
    part, size = f"{folder}/.{name}.{uuid.uuid4().hex}", 0
    try:
        with store.open_output_stream(part) as f:
            for piece in pieces:
                size += f.write(piece)
        store.move(part, path)
    except BaseException:
        if store.get_file_info(part).type != fs.FileType.NotFound:
            store.delete_file(part)
        raise
    return size


def write_binaries(files: DataFrame, folder: str) -> None:
    """Each row (name, content) as a file of its own; of equal names any one stays."""
    ship(files.sparkSession)

    def write(rows) -> None:
        store, root = opened(folder)
        for r in rows:
            put(store, f"{root}/{r.name}", iter([bytes(r.content or b"")]))

    files.select("name", "content").foreachPartition(write)


def copy_files(files: DataFrame) -> DataFrame:
    """(source, target) rows with ``state``: copied, there (a file of that size is at the target already) or missing (no source).

    Files are copied as the result is read, by the tasks, PIECE bytes at a time and each under a temporary name, so that a task that is run again copies only what is not there.
    Targets are to differ.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [_copied(a.as_py(), b.as_py()) for a, b in zip(batch.column("source"), batch.column("target"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.string())], [*batch.schema.names, "state"])

    return files.mapInArrow(run, files.limit(0).withColumn("state", F.lit("")).schema)


def _copied(source: str | None, target: str) -> str:
    if not source:
        return "missing"
    (store, path), (other, to) = opened(source), opened(target)
    own = store.get_file_info(path)
    if own.type != fs.FileType.File:
        return "missing"
    if (there := other.get_file_info(to)).type == fs.FileType.File and there.size == own.size:
        return "there"
    with store.open_input_stream(path) as f:
        put(other, to, iter(lambda: f.read(PIECE), b""))
    return "copied"


def shared_folder(spark, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or a local one where Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="curatrix-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
