"""Media columns: texts stored as 8-bit WAV, read by the wave module, and fingerprinted by spectral-peak pairs.

``media_column`` stores payloads and their time-coded fingerprints; ``op1_media`` derives the digests.

Defined results: a null text counts as empty; an empty one stores 192 spaces; equal texts give equal values
whatever rows surround them (every text is transformed on its own, in fixed blocks of frames); repeated rows
and null doc_ids are answered one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from curatrix.llm._run import map_batches, sql_text, table

#: Payload unit, and window of the transform, in samples.
UNIT = 192
#: Step between windows.
HOP = 96
#: Frames transformed at once: bounds memory for long texts.
BLOCK = 4096
#: Peaks kept in a frame, partners of a peak, and frames between partners at most: the method's landmark density.
PEAKS, FAN, REACH = 2, 3, 63
RATE = 8000
_HANN = np.hanning(UNIT).astype(np.float32)


def payload_of(data: bytes) -> bytes:
    """data and spaces up to a positive multiple of UNIT."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def write_wav(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectrum(samples: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Magnitudes, times 16 and rounded, of frames start to stop (short-time Fourier transform, Hann window)."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, UNIT)[start * HOP : (stop - 1) * HOP + 1 : HOP]
    return np.rint(np.abs(np.fft.rfft(frames * _HANN, axis=1)) * np.float32(16))


def peaks_of(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks: above their neighbours in time and frequency and their frame's mean."""
    samples = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    n = (len(samples) - UNIT) // HOP + 1
    times, bins = [], []
    for at in range(0, n, BLOCK):
        first, last = max(0, at - 1), min(n, at + BLOCK + 1)
        mags = spectrum(samples, first, last)
        mags[:, :2] = 0  # the mean level of the text
        pad = np.zeros((len(mags) + 2, mags.shape[1] + 4), np.float32)
        pad[1:-1, 2:-2] = mags
        wide = np.maximum(np.maximum(pad[:, :-1], pad[:, 1:])[:, :-3], np.maximum(pad[:, 3:-1], pad[:, 4:]))
        np.maximum(wide, pad[:, 2:-2], out=wide)
        high = np.maximum(np.maximum(wide[:-2], wide[2:]), wide[1:-1])
        level = np.maximum(mags.mean(axis=1, keepdims=True), 16)
        left = np.where((mags == high) & (mags > level), mags, 0)[at - first : at - first + min(BLOCK, n - at)]
        rows, picked = np.arange(len(left)), []
        for _ in range(PEAKS):
            k = left.argmax(axis=1)
            picked.append(np.where(left[rows, k] > 0, k, -1))
            left[rows, k] = 0
        k = np.stack(picked, axis=1)
        t, _ = np.nonzero(k >= 0)
        bins.append(k[k >= 0])
        times.append(t + at)
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order], f[order]


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and hashes of the peak pairs: 7 bits of either bin, 6 of the distance."""
    t, f = peaks_of(payload)
    times, hashes = [], []
    for d in range(1, FAN + 1):
        near = (gap := t[d:] - t[:-d]) <= REACH
        times.append(t[:-d][near])
        hashes.append((f[:-d] << 13 | f[d:] << 6 | gap)[near])
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order].astype("<i4"), h[order].astype("<i4")


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (WAV bytes), fp_time and fp_hash (the time-coded fingerprint) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                media = write_wav(payload_of(data := text.encode()))
                t, h = fingerprint(read_wav(media))
                rows.append((doc_id, len(data), media, t, h))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.types[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.list_(pa.int32()))], ["doc_id", "n_bytes", "media", "fp_time", "fp_hash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", sql_text().alias("text")), run, f"doc_id {kind}, n_bytes long, media binary, fp_time array<int>, fp_hash array<int>")


def media_digests(media: DataFrame) -> DataFrame:
    """The digests of a media column: the stored bytes are read by the wave module once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            stored, times, hashes = batch.column(2), batch.column(3), batch.column(4)
            for i in range(batch.num_rows):
                raw = stored[i].as_py()
                payload = read_wav(raw)
                t, h = (x[i].values.to_numpy(zero_copy_only=False).astype("<i4") for x in (times, hashes))
                feature = f"{(len(payload) - UNIT) // HOP + 1}:{len(t)}:{hashlib.sha256(t.tobytes() + h.tobytes()).hexdigest()}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, len(t)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pairs"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_batches(media, run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pairs long")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's WAV form and fingerprint (``feature``: frames, pairs, SHA-256 of the arrays)."""
    return media_digests(media_column(table(spark, sf_dir, "documents")))


QUERIES = {"op1_media": op1_media}
ORACLE_SQL: dict[str, str] = {}
