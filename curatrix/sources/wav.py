"""A source of WAV files: headers and the samples of a window in the middle, read by seeking.

    spark.dataSource.register(WavWindows)
    spark.read.format("wav_windows").option("path", folder).option("seconds", 90).load()

Files are listed once on the driver and dealt to partitions by the bytes that are read of them.  A file that can't be read is a row with its
``error`` and null samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from curatrix.packing import ship
from curatrix.sources.store import opened

SCHEMA = "path string, rate int, channels int, width int, n_frames long, start long, pcm binary, error string"
#: Bytes that a partition reads, about; bytes of a second that a file is taken to have before its header is read.
SPLIT, SECOND = 64 << 20, 192_000


@dataclass
class Files(InputPartition):
    paths: list[str]


class WavWindows(DataSource):
    """Options: path (a file or a folder, read with all below it), seconds (of the middle; all if 0), suffix."""

    @classmethod
    def name(cls) -> str:
        return "wav_windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WavReader(self.options)


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.seconds, self.suffix = options["path"], float(options.get("seconds", 90)), options.get("suffix", ".wav").lower()

    def partitions(self) -> list[Files]:
        store, root = opened(self.path)
        found = store.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        out, size = [], SPLIT
        for f in sorted((f for f in files if f.type == fs.FileType.File and f.path.lower().endswith(self.suffix)), key=lambda f: f.path):
            if size >= SPLIT:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += min(f.size, int(self.seconds * SECOND)) if self.seconds else f.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for path in partition.paths:
            try:
                row = [*window(store, path, self.seconds), None]
            except (OSError, ValueError, struct.error) as e:
                row = [None] * 6 + [str(e) or type(e).__name__]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([path, *row], kinds, strict=True)], names)


def header(f) -> tuple[int, int, int, int, int]:
    """rate, channels, width, place and bytes of the samples of an open file of whole-number samples."""
    size = f.size()
    kind, _, form = struct.unpack("<4sI4s", f.read(12))
    if kind != b"RIFF" or form != b"WAVE":
        raise ValueError("not a WAV file")
    found = None
    while f.tell() + 8 <= size:
        name, length = struct.unpack("<4sI", f.read(8))
        place = f.tell()
        if name == b"fmt ":
            own = f.read(min(length, 40))
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", own[:16])
            if tag == 0xFFFE and len(own) >= 26:
                tag = struct.unpack("<H", own[24:26])[0]
            if tag != 1 or bits not in (8, 16, 24, 32) or not channels or not rate:
                raise ValueError(f"format {tag} with {bits} bits, {channels} channels, rate {rate}")
            found = rate, channels, bits // 8
        elif name == b"data":
            if not found:
                raise ValueError("samples before their format")
            return *found, place, min(length, size - place)
        f.seek(place + length + length % 2)
    raise ValueError("no samples")


def window(store: fs.FileSystem, path: str, seconds: float) -> tuple[int, int, int, int, int, bytes]:
    """rate, channels, width, frames of the file, first frame of the window, and its samples."""
    with store.open_input_file(path) as f:
        rate, channels, width, place, length = header(f)
        n = length // (width * channels)
        own = min(n, int(rate * seconds)) if seconds else n
        start = (n - own) // 2
        f.seek(place + start * width * channels)
        return rate, channels, width, n, start, f.read(own * width * channels)


def wav_windows(spark: SparkSession, path: str, seconds: float = 90.0) -> DataFrame:
    """The windows of the files below a path."""
    ship(spark)
    spark.dataSource.register(WavWindows)
    return spark.read.format("wav_windows").option("path", path).option("seconds", seconds).load()


def _little(x: Column, size: int) -> Column:
    """A whole number as ``size`` bytes, the lowest first."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(255)), 2, "0")) for k in range(size)])


def encoded(pcm: Column, rate: Column, channels: Column, width: Column) -> Column:
    """A WAV file of these samples; they are padded to an even number of bytes."""
    pcm, frame = F.coalesce(pcm, F.lit(b"")), channels * width
    odd, size = F.octet_length(pcm) % 2, F.octet_length(pcm)
    head = F.concat(_little(F.lit(16), 4), _little(F.lit(1), 2), _little(channels, 2), _little(rate, 4), _little(rate * frame, 4), _little(frame, 2), _little(8 * width, 2))
    return F.concat(F.lit(b"RIFF"), _little(36 + size + odd, 4), F.lit(b"WAVEfmt "), head, F.lit(b"data"), _little(size, 4), pcm, F.when(odd == 1, F.lit(b"\0")).otherwise(F.lit(b"")))
