"""Analysis of decoded tracks: one Arrow pass makes the numbers of a track, Columns turn them into labels and sections.

Tracks are rows with ``pcm`` (little-endian samples, channels interleaved), ``rate``, ``channels`` and ``width`` (bytes a sample), as the source ``wav_windows``
gives them or as any binary column with the three numbers beside it.  Tracks are independent, so a pass needs no shuffle; a worker holds one Arrow
batch of tracks, which ``packing`` bounds, and the results of PIECE bytes of samples.

A track that can't be analysed (null or empty samples, an unknown width) gets empty results and the reason in ``error``; it fails no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import signal
from curatrix.operators import merging, numeric, sequences
from curatrix.packing import ship

#: What a track's samples are given by; seconds of the middle that are analysed; seconds of a section at least.
TRACK, WINDOW_S, LEAST_S = ("pcm", "rate", "channels", "width"), 90.0, 12.0
#: Bytes of samples whose results are passed on at once.
PIECE = 4 << 20
#: Labels that ``zero_shot`` takes at most: their vectors are held by every task.
MOST_LABELS = 10_000
# The instruments asked for.
INSTRUMENTS = (
    "acoustic guitar", "electric guitar", "lead guitar", "rhythm guitar",
    "bass guitar", "double bass", "drums", "drum kit", "percussion",
    "piano", "electric piano", "rhodes", "organ", "hammond organ", "synth",
    "violin", "fiddle", "viola", "cello", "acoustic bass",
    "pedal steel guitar", "steel guitar", "dobro", "banjo", "mandolin", "harp",
    "saxophone", "trumpet", "trombone", "french horn", "tuba",
    "flute", "clarinet", "oboe", "bassoon", "harmonica", "accordion",
    "lead vocal", "male vocals", "female vocals", "backing vocals", "choir",
    "cowbell", "tambourine", "congas", "marimba", "xylophone", "bells",
)
FEATURES = "struct<mid: double, side: double, bpm: int, beats: array<double>, chroma: array<double>, harmonic: double, percussive: double, bass: double, middle: double, high: double>"


def per_track(tracks: DataFrame, fn: Callable, kind: str, more: tuple[str, ...] = (), together: int = 0) -> DataFrame:
    """The tracks without pcm, with ``found`` (of type ``kind``) and ``error``. ``fn`` gets the samples (channels, frames), the rate and the columns ``more``.

    ``together``: ``fn`` gets a list of such, as many tracks as have that many frames of samples, and gives a list; if one of them fails, each by itself.
    """
    ship(tracks.sparkSession)
    kept = [c for c in tracks.columns if c != "pcm"]
    schema = tracks.select(*kept).limit(0).withColumns({"found": F.lit(None).cast(kind), "error": F.lit(None).cast("string")}).schema
    found_type = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors, first, size, held, frames = [], [], 0, 0, [], 0
            for row in zip(*(batch.column(c) for c in (*TRACK, *more)), strict=True):
                pcm, rate, channels, width, *rest = (x.as_py() for x in row)
                found.append(None)
                errors.append(None)
                try:
                    sides = signal.decode(pcm or b"", width or 0, channels or 0)
                    if not sides.shape[1] or not rate or rate < 1:
                        raise ValueError("no samples")
                    held.append((len(found) - 1, (sides, rate, *rest)))
                    frames += sides.shape[1]
                except (ValueError, MemoryError) as e:
                    errors[-1] = str(e) or type(e).__name__
                size += len(pcm or b"")
                if frames >= together or size >= PIECE:
                    settle(held, found, errors)
                    held, frames = [], 0
                if size >= PIECE:
                    yield passed(batch.slice(first, len(found)), found, errors)
                    found, errors, first, size = [], [], first + len(found), 0
            settle(held, found, errors)
            if found:
                yield passed(batch.slice(first), found, errors)

    def settle(held: list[tuple], found: list, errors: list) -> None:
        try:
            values = fn([x for _, x in held]) if together else [fn(*x) for _, x in held]
            for (k, _), value in zip(held, values, strict=True):
                found[k] = value
        except (ValueError, MemoryError) as e:
            if len(held) == 1:
                errors[held[0][0]] = str(e) or type(e).__name__
            else:
                for one in held:
                    settle([one], found, errors)

    def passed(rows: pa.RecordBatch, found: list, errors: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(found, found_type), pa.array(errors, pa.string())], [*kept, "found", "error"])

    return tracks.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def middle(sides: np.ndarray, rate: int, seconds: float = WINDOW_S) -> np.ndarray:
    """The middle of a track."""
    n = int(rate * seconds)
    start = max(0, (sides.shape[1] - n) // 2)
    return sides[:, start : start + n]


def analyse(tracks: DataFrame, seconds: float = WINDOW_S, given: Column | None = None) -> DataFrame:
    """The tracks with stereo, side_mid_db, bpm, key, timesig, instruments, instrumental and error, from the middle ``seconds``.

    ``given``: an array of instruments known otherwise; those that neither hold nor are part of an estimated one are appended.
    """
    own = [c for c in tracks.columns if c not in TRACK]

    def each(items: list[tuple]) -> list[dict]:
        out = [{}] * len(items)
        for rate in {rate for _, rate in items}:
            at = [k for k, (_, r) in enumerate(items) if r == rate]
            for k, found in zip(at, signal.features([middle(items[k][0], rate, seconds) for k in at], rate), strict=True):
                out[k] = found
        return out

    made = per_track(tracks, each, FEATURES, together=signal.CHUNK * signal.HOP)
    f = lambda name: F.col(f"found.{name}")
    sides = numeric.stereo_of(f("mid"), f("side"))
    found = merging.band_instruments(f("harmonic"), f("percussive"), f("bass"), f("middle"), f("high"))
    if given is not None:
        within = lambda acc, x: F.exists(acc, lambda y: F.contains(F.lower(y), F.lower(x)) | F.contains(F.lower(x), F.lower(y)))
        found = F.aggregate(F.coalesce(given, F.array().cast("array<string>")), found, lambda acc, x: F.when(within(acc, x), acc).otherwise(F.array_append(acc, x)))
    ok = F.col("error").isNull()
    instruments = F.when(ok, found).otherwise(F.array().cast("array<string>"))
    out = made.withColumns({
        "stereo": F.when(ok, sides["label"]).otherwise(""), "side_mid_db": F.when(ok, sides["db"]), "bpm": F.when(ok, f("bpm")).otherwise(0),
        "key": F.when(ok, numeric.key_of(f("chroma"), legacy=True)).otherwise(""), "timesig": F.when(ok, numeric.time_signature(f("beats"))).otherwise(""), "instruments": instruments,
    })
    spoken = F.lower(F.array_join("instruments", " "))
    return out.withColumn("instrumental", F.when(ok, ~spoken.rlike("vocal|sing|voice")).otherwise(False)).select(*own, "stereo", "side_mid_db", "bpm", "key", "timesig", "instruments", "instrumental", "error")


def seconds_of(pcm: str = "pcm") -> Column:
    """A track's length."""
    return F.floor(F.octet_length(pcm) / (F.col("width") * F.col("channels"))) / F.col("rate")


def segments(tracks: DataFrame, least: float = LEAST_S, most: int = 20) -> DataFrame:
    """The tracks with duration, ``bounds`` (where the adaptive number of most even runs begin, 0 first, the duration last) and ``sections`` (name, start, end).

    Sections are the runs whose begins lie ``least`` seconds apart; the last one ends with the track.
    """
    own = [c for c in tracks.columns if c not in TRACK]
    timed = tracks.withColumn("duration", seconds_of())
    timed = timed.withColumn("_k", F.least(F.lit(most), sequences.adaptive_k(F.col("duration"))))
    made = per_track(timed, lambda sides, rate, k: signal.boundaries(sides.mean(0), rate, k), "array<double>", ("_k",))
    kept = sequences.keep_apart(F.concat(F.array(F.lit(0.0)), "found"), F.lit(float(least)), F.col("duration"))
    made = made.withColumn("_kept", F.when(F.col("error").isNull(), kept))
    each = F.transform(F.slice("_kept", F.lit(1), F.greatest(F.lit(0), F.size("_kept") - 1)), lambda x, i: F.struct(F.format_string("Section_%02d", i + 1).alias("name"), x.alias("start"), F.get(F.col("_kept"), i + 1).alias("end")))
    return made.select(*own, "duration", F.col("found").alias("bounds"), each.alias("sections"), "error")


def split_lead(tracks: DataFrame) -> DataFrame:
    """The tracks with ``lead`` and ``backing``: samples of the same form, of 8 or 16 bits, that add up to the track's exactly."""
    own = [c for c in tracks.columns if c != "pcm"]

    def split(sides: np.ndarray, rate: int, width: int) -> dict:
        if width not in (1, 2):
            raise ValueError(f"{width} bytes a sample")
        whole = np.rint(sides * (1 << 8 * width - 1)).astype(np.int32)
        lead = np.rint(whole * signal.lead_mask(sides.mean(0), rate)).astype(np.int32)
        # 8-bit samples rest at 128
        form = (lambda x: (x + 128).astype(np.uint8)) if width == 1 else (lambda x: x.astype("<i2"))
        return {"lead": form(lead.T).tobytes(), "backing": form((whole - lead).T).tobytes()}

    # the width is asked for twice: as what the samples are decoded by and as what they are encoded to
    return per_track(tracks, split, "struct<lead: binary, backing: binary>", ("width",)).select(*own, "found.lead", "found.backing", "error")


def zero_shot(rows: DataFrame, labels: DataFrame, vector: str = "embedding", scale: float = 100.0, most: int = 6) -> DataFrame:
    """The rows with ``labels``: the ``most`` likeliest as array<struct<label, score>>, by the softmax of scaled cosines to the labels' vectors.

    labels: label, vector; MOST_LABELS at most, checked, for their matrix is sent to every task.  A block of rows is one matrix product.  Equal
    scores come in the labels' order; null vectors and those of another length or without direction have null.
    """
    known = labels.select("label", F.transform("vector", lambda x: x.cast("double")).alias("vector")).limit(MOST_LABELS + 1).collect()
    if len(known) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    ship(rows.sparkSession)
    names = [r.label for r in known]
    matrix = np.array([r.vector for r in known], float).T.reshape(-1, len(names))
    matrix = matrix / np.maximum(1e-300, np.sqrt((matrix**2).sum(0)))
    kind = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(vector)
            flat = own.flatten().to_numpy(zero_copy_only=False).astype(float)
            sizes = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            fits = sizes == len(matrix)
            x = flat[np.repeat(fits, sizes)].reshape(-1, len(matrix))
            length = np.sqrt((x**2).sum(1))
            score = scale * (x @ matrix) / np.where(length > 0, length, 1)[:, None]
            score = np.exp(score - score.max(1, keepdims=True, initial=-np.inf))
            score /= score.sum(1, keepdims=True)
            best = np.argsort(-score, axis=1, kind="stable")[:, :most]
            out: list = [None] * len(fits)
            for k, order, p, n in zip(np.flatnonzero(fits).tolist(), best.tolist(), np.take_along_axis(score, best, 1).tolist(), length.tolist(), strict=True):
                if n > 0 and np.isfinite(n):
                    out[k] = [{"label": names[j], "score": s} for j, s in zip(order, p, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "labels"])

    return rows.mapInArrow(run, rows.limit(0).withColumn("labels", F.lit(None).cast("array<struct<label: string, score: double>>")).schema)
