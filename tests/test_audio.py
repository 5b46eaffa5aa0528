"""Audio sources and operators: samples and files against the wave module, numbers against plain versions."""

import struct
import wave

import numpy as np
import pytest

from pyspark.sql import functions as F

from curatrix.functions import signal
from curatrix.operators import audio
from curatrix.sources import store, wav

RATE = 22050
SCHEMA = "id int, pcm binary, rate int, channels int, width int"


def pcm16(y):
    return np.rint(np.clip(y, -1, 1) * 32767).astype("<i2").T.tobytes()


def clicks(bpm, rate, seconds, every=(1.0,)):
    y = np.zeros(int(rate * seconds))
    tick = np.exp(-np.arange(rate // 50) / (rate / 400)) * np.sin(2 * np.pi * 1500 * np.arange(rate // 50) / rate)
    for k, t in enumerate(np.arange(0.1, seconds - 0.1, 60 / bpm)):
        at = int(t * rate)
        y[at : at + len(tick)] += tick[: len(y) - at] * every[k % len(every)]
    return y


def tone(hertz, seconds, rate=RATE):
    return sum(np.sin(2 * np.pi * h * np.arange(int(rate * seconds)) / rate) for h in hertz) / len(hertz) * 0.5


# --- samples and files


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_decode(width):
    values = [-(1 << 8 * width - 1), -1, 0, 1, (1 << 8 * width - 1) - 1, 7]
    raw = b"".join((v + 128 if width == 1 else v).to_bytes(width, "little", signed=width > 1) for v in values)
    got = signal.decode(raw + b"x", width, 2)
    assert got.shape == (2, 3)
    assert np.allclose(got.T.ravel(), np.array(values) / (1 << 8 * width - 1))


def written(path, y, rate, width=2):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(len(y))
        f.setsampwidth(width)
        f.setframerate(rate)
        whole = np.rint(y.T.ravel() * ((1 << 8 * width - 1) - 1)).astype(int)
        f.writeframes(b"".join((int(v) + 128 if width == 1 else int(v)).to_bytes(width, "little", signed=width > 1) for v in whole))


def test_source(spark, tmp_path):
    rng = np.random.default_rng(1)
    forms = {"a.wav": (2, 2), "deep/b.WAV": (1, 1), "deep/er/c.wav": (3, 1), "d.wav": (4, 2)}
    (tmp_path / "deep/er").mkdir(parents=True)
    for name, (width, channels) in forms.items():
        written(tmp_path / name, rng.uniform(-1, 1, (channels, 1000)), 100, width)
    (tmp_path / "e.wav").write_bytes(b"RIFF1234WAVEjunk")
    (tmp_path / "f.wav").write_bytes(b"")
    (tmp_path / "g.txt").write_bytes(b"no audio")
    whole = (tmp_path / "a.wav").read_bytes()
    # a chunk of odd length before the samples, a length that runs past the end, and a float format
    (tmp_path / "h.wav").write_bytes(whole[:36] + b"note\x03\0\0\0abc\0" + b"data" + struct.pack("<I", 0xFFFFFFFF) + whole[44:])
    (tmp_path / "i.wav").write_bytes(whole[:20] + struct.pack("<H", 3) + whole[22:])
    rows = {r.path.rsplit("/", 1)[-1]: r for r in wav.wav_windows(spark, str(tmp_path), 2.0).collect()}
    assert sorted(rows) == ["a.wav", "b.WAV", "c.wav", "d.wav", "e.wav", "f.wav", "h.wav", "i.wav"]
    for name, (width, channels) in forms.items():
        r = rows[name.rsplit("/", 1)[-1]]
        with wave.open(str(tmp_path / name)) as f:
            f.setpos(400)
            assert (r.rate, r.channels, r.width, r.n_frames, r.start, bytes(r.pcm), r.error) == (100, channels, width, 1000, 400, f.readframes(200), None)
    assert bytes(rows["h.wav"].pcm) == bytes(rows["a.wav"].pcm)
    assert all(rows[x].pcm is None and rows[x].error for x in ("e.wav", "f.wav", "i.wav"))
    one = wav.wav_windows(spark, str(tmp_path / "a.wav"), 0).first()
    assert len(one.pcm) == 4000 and one.start == 0


def test_encoded_files_are_read_by_the_wave_module(spark, tmp_path):
    rows = [(0, b"\x01\x02\x03", 8000, 1, 1), (1, b"", 300, 2, 2), (2, None, 44100, 2, 3), (3, bytes(range(256)), 70000, 2, 2)]
    own = spark.createDataFrame(rows, SCHEMA).select(F.concat("id", F.lit(".wav")).alias("name"), wav.encoded(*map(F.col, ("pcm", "rate", "channels", "width"))).alias("content"))
    store.write_binaries(own, f"file://{tmp_path}/out")
    for k, pcm, rate, channels, width in rows:
        with wave.open(str(tmp_path / f"out/{k}.wav")) as f:
            assert (f.getframerate(), f.getnchannels(), f.getsampwidth()) == (rate, channels, width)
            assert f.readframes(f.getnframes()) == (pcm or b"")[: len(pcm or b"") // (channels * width) * channels * width]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0.wav", "1.wav", "2.wav", "3.wav"]


def test_copies(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(256)) * 40_000)
    (tmp_path / "b.bin").write_bytes(b"")
    files = spark.createDataFrame([(f"{tmp_path}/{x}", f"{tmp_path}/to/deep/{x}") for x in ("a.bin", "b.bin", "none.bin")] + [(None, f"{tmp_path}/to/n")], "source string, target string")
    states = lambda: [r.state for r in store.copy_files(files.coalesce(1)).collect()]
    assert states() == ["copied", "copied", "missing", "missing"]
    assert states() == ["there", "there", "missing", "missing"]
    (tmp_path / "to/deep/a.bin").write_bytes(b"part of an older run")
    assert states() == ["copied", "there", "missing", "missing"]
    assert sorted(p.name for p in (tmp_path / "to/deep").iterdir()) == ["a.bin", "b.bin"]
    assert (tmp_path / "to/deep/a.bin").read_bytes() == (tmp_path / "a.bin").read_bytes()


def test_a_writer_that_fails_leaves_nothing(tmp_path):
    def pieces():
        yield b"first"
        raise RuntimeError("lost")

    own, root = store.opened(str(tmp_path))
    with pytest.raises(RuntimeError):
        store.put(own, f"{root}/x", pieces())
    assert list(tmp_path.iterdir()) == []


# --- segmentation


def plain_runs(x, k):
    runs = [(i, i + 1, x[i].astype(float)) for i in range(len(x))]
    while len(runs) > max(1, k):
        costs = [signal.ward_cost(b - a, d - c, s, t) for (a, b, s), (c, d, t) in zip(runs, runs[1:], strict=False)]
        i = int(np.argmin(costs))
        (a, _, s), (_, d, t) = runs[i : i + 2]
        runs[i : i + 2] = [(a, d, s + t)]
    return [r[0] for r in runs]


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_plain_version(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 3)) if seed < 3 else rng.integers(0, 2, (60, 2)).astype(float)
    for k in (1, 2, 5, 20, 60, 90):
        assert signal.adjacent_runs(x, k) == plain_runs(x, k)


def test_cosine_transform_and_filters():
    assert np.allclose(signal.mel_filters(RATE).sum(1)[10:] * RATE / signal.FRAME, 1, atol=0.2)  # triangles of area 1
    y = tone([440, 1000], 2)
    got, db = signal.mfcc(y, RATE), signal.mel_db(y, RATE)
    want = np.array([[sum(v * np.cos(np.pi * c * (2 * n + 1) / 256) for n, v in enumerate(row)) * np.sqrt((1 if c == 0 else 2) / 128) for c in range(13)] for row in db[:3]])
    assert np.allclose(got[:3], want)
    mags = np.concatenate(list(signal.spectra(y)))
    frame = np.pad(y, 1024)[5 * 512 : 5 * 512 + 2048] * np.hanning(2049)[:-1]
    assert np.allclose(mags[5], np.abs(np.fft.fft(frame))[:1025])
    assert abs(mags.shape[0] - len(y) / 512) <= 1


def test_segments(spark):
    y = np.concatenate([tone([220], 20), tone([2500, 3000], 25), tone([600], 30)])
    silent, short = np.zeros((1, RATE * 70)), tone([300], 1.0)[None]
    tracks = spark.createDataFrame([(0, pcm16(y[None]), RATE, 1, 2), (1, pcm16(silent), RATE, 1, 2), (2, pcm16(short), RATE, 1, 2), (3, b"", RATE, 1, 2), (4, None, RATE, 2, 2), (5, b"abc", RATE, 1, 9)], SCHEMA)
    got = {r.id: r for r in audio.segments(tracks).collect()}
    inner = got[0].bounds[1:-1]
    assert got[0].bounds[0] == 0 and got[0].bounds[-1] == 75.0 and len(inner) == 3
    assert min(abs(b - 20) for b in inner) < 0.1 and min(abs(b - 45) for b in inner) < 0.1
    ends = [(s.start, s.end) for s in got[0].sections]
    assert ends[0][0] == 0 and ends[-1][1] == 75.0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert [s.name for s in got[0].sections] == [f"Section_{k + 1:02d}" for k in range(len(ends))]
    assert all(b - a >= 12 for a, b in ends[:-1])
    assert got[1].error is None and got[2].bounds == [0.0, signal.adjacent_runs(signal.mfcc(signal.decode(pcm16(short), 2, 1)[0], RATE), 2)[1] * 512 / RATE, 1.0]
    assert [got[k].error for k in (3, 4, 5)] == ["no samples", "no samples", "9 bytes a sample, 1 channels"]
    assert got[3].sections is None


# --- tempo, key, metre, sides


@pytest.mark.parametrize("bpm", [60, 80, 100, 120, 140, 160, 180])
def test_tempo_of_clicks(bpm):
    y = clicks(bpm, 44100, 15)
    got = signal.tempo(signal.onset_strength(y, 44100), 44100)
    assert abs(got - bpm) <= 2


def test_tempo_of_silence_and_nothing():
    assert signal.tempo(np.zeros(0), RATE) == 0
    assert signal.tempo(signal.onset_strength(np.zeros(RATE * 3), RATE), RATE) > 0


def test_beats_fall_on_clicks():
    y = clicks(120, RATE, 20)
    onset = signal.onset_strength(y, RATE)
    at = signal.beats(onset, RATE, 120) * 512 / RATE
    assert len(at) >= 35
    assert np.median(np.abs((at - 0.1 + 0.25) % 0.5 - 0.25)) < 0.06
    assert len(signal.beats(np.zeros(50), RATE, 120)) == 0


def test_analyse(spark):
    chord = tone([220, 261.63, 329.63, 440], 6)  # A, C, E
    waltz, march = clicks(120, RATE, 45, (1.0, 0.25, 0.25)), clicks(120, RATE, 45, (1.0, 0.2, 0.2, 0.2))
    two = np.stack([tone([200], 3), tone([330], 3)])
    rows = [(0, pcm16(np.stack([chord, chord])), RATE, 2, 2), (1, pcm16(waltz[None]), RATE, 1, 2), (2, pcm16(march[None]), RATE, 1, 2), (3, pcm16(two), RATE, 2, 2), (4, b"", RATE, 1, 2), (5, pcm16(tone([100], 4)[None]), RATE, 1, 2)]
    got = {r.id: r for r in audio.analyse(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[0].stereo, got[0].side_mid_db, got[3].stereo, got[1].stereo) == ("mono", None, "stereo", "mono")
    # the mirrored tonic: A is nine steps above C, so its name is that of three
    assert got[0].key == "D# minor"
    assert (got[1].timesig, got[2].timesig) == ("3/4", "4/4")
    assert abs(got[1].bpm - 120) <= 3 and "drums" in got[1].instruments
    assert got[5].instruments[0] == "bass" and got[5].instrumental
    assert tuple(got[4])[1:] == ("", None, 0, "", "", [], False, "no samples")
    given = audio.analyse(spark.createDataFrame(rows[5:], SCHEMA), given=F.array(F.lit("Bass guitar"), F.lit("Male vocals"), F.lit("vocals"))).first()
    assert given.instruments == ["bass", "Male vocals"] and not given.instrumental


def test_the_middle_counts(spark):
    y = np.concatenate([np.zeros(RATE * 3), tone([150], 2), np.zeros(RATE * 3)])
    whole = pcm16(y[None])
    mid = audio.analyse(spark.createDataFrame([(0, whole, RATE, 1, 2)], SCHEMA), seconds=2.0).first()
    own = audio.analyse(spark.createDataFrame([(0, pcm16(tone([150], 2)[None]), RATE, 1, 2)], SCHEMA)).first()
    assert tuple(mid) == tuple(own)


def test_median_filter():
    x = np.random.default_rng(2).random((50, 40)).astype(np.float32)
    for axis in (0, 1):
        padded = np.pad(x, [(15, 15) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        want = np.array([[np.median(padded[i : i + 31, j] if axis == 0 else padded[i, j : j + 31]) for j in range(40)] for i in range(50)])
        assert np.allclose(signal.medians(x, axis), want)


def test_medians_share_their_work():
    from time import perf_counter

    x = np.random.default_rng(3).integers(0, 50, (200, 1025)).astype(np.float32)
    times = []
    for make in (lambda: np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, ((15, 15), (0, 0)), mode="symmetric"), 31, axis=0), axis=2), lambda: signal.medians(x, 0)):
        start = perf_counter()
        found = make()
        times.append(perf_counter() - start)
        assert np.array_equal(found if len(times) == 1 else known, found)
        known = found
    assert times[1] < times[0] / 2
    for shape in ((1, 1), (2, 3), (40, 1)):
        assert np.array_equal(signal.medians(np.ones(shape, np.float32), 1), np.ones(shape))


def test_medians_of_parts():
    x, lengths = np.random.default_rng(7).integers(0, 9, (98, 20)).astype(np.float32), [1, 2, 0, 17, 32, 46]
    ends = np.cumsum(lengths)
    want = np.concatenate([signal.medians(x[e - n : e], 0) for e, n in zip(ends, lengths, strict=True) if n])
    assert np.array_equal(signal.medians(x, 0, lengths=lengths), want)


def test_short_tracks_share_their_steps(monkeypatch):
    rng, rate, calls = np.random.default_rng(8), 4000, []
    tracks = [rng.integers(-99, 99, (1 + k % 2, n)).astype(np.float32) / 128 for k, n in enumerate([1, 511, 512, 5000, 16_000, 200_000, 7, 3000])] + [np.zeros((2, 9000), np.float32)]
    alone = [signal.features([sides], rate)[0] for sides in tracks]
    medians = signal.medians
    monkeypatch.setattr(signal, "medians", lambda x, axis, *a, **b: calls.append(len(x)) or medians(x, axis, *a, **b))
    assert signal.features(tracks, rate) == alone
    # two for all tracks, and one more call of the second, along the other axis
    assert len(calls) == 3


def test_a_track_that_fails_fails_alone(spark):
    def each(items):
        if any(sides.shape[1] == 3 for sides, _ in items):
            raise ValueError("three")
        return [sides.shape[1] for sides, _ in items]

    rows = spark.createDataFrame([(k, bytes(n), 100, 1, 1) for k, n in enumerate([2, 3, 0, 5, 3, 7])], SCHEMA).coalesce(1)
    got = [(r.found, r.error) for r in audio.per_track(rows, each, "long", together=1000).orderBy("id").collect()]
    assert got == [(2, None), (None, "three"), (None, "no samples"), (5, None), (None, "three"), (7, None)]


def test_texts_of_one_row_group_are_the_work_of_many_tasks(spark, tmp_path):
    from curatrix.plans import audio as plans

    spark.range(64).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), F.col("id").cast("int")).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.tracks(spark, str(tmp_path)).rdd.glom().map(len).collect()
    assert sum(found) == 64 and len(found) >= 4 and max(found) < 24


def test_tracks_pass_on_results_in_pieces(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = spark.range(7).select("id", F.repeat(F.lit("ab"), F.when(F.col("id") % 3 == 0, 3_000_000).otherwise(5)).cast("binary").alias("pcm"), F.lit(1000).alias("rate"), F.lit(1).alias("channels"), F.lit(1).alias("width"))
    made = audio.per_track(rows.coalesce(1), lambda sides, rate: sides.shape[1], "long")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert [(r.id, r.found, r.error) for r in made.collect()] == [(i, 10 if i % 3 else 6_000_000, None) for i in range(7)]


# --- lead and backing


@pytest.mark.parametrize("width", [1, 2])
def test_lead_and_backing_add_up(spark, width):
    rng = np.random.default_rng(4)
    y = np.stack([np.concatenate([tone([220, 440, 660], 2), rng.normal(0, 0.02, RATE)]), np.concatenate([tone([220], 2), rng.normal(0, 0.02, RATE)])])
    raw = pcm16(y) if width == 2 else (np.rint(y.T * 127).astype(int) + 128).clip(0, 255).astype(np.uint8).tobytes()
    got = audio.split_lead(spark.createDataFrame([(0, raw, RATE, 2, width), (1, b"", RATE, 1, 1), (2, b"abcabc", RATE, 1, 3)], SCHEMA)).orderBy("id").collect()
    part = lambda x: np.rint(signal.decode(x, width, 2) * (1 << 8 * width - 1)).astype(int)
    lead, backing = part(bytes(got[0].lead)), part(bytes(got[0].backing))
    assert (lead + backing == part(raw)).all()
    # the voiced part leads, the noise does not
    share = lambda a, b: np.abs(lead[:, a:b]).sum() / np.abs(part(raw)[:, a:b]).sum()
    assert share(RATE // 2, RATE) > 0.8 and share(RATE * 5 // 2, RATE * 3 - 2000) < 0.2
    assert (got[1].error, got[2].error) == ("no samples", "3 bytes a sample")


def test_voicing():
    y = np.concatenate([tone([150, 300, 450], 1), np.random.default_rng(5).normal(0, 0.3, RATE)])
    v = signal.voicing(y, RATE)
    assert v[5:35].min() > 0.9 and np.median(v[50:80]) < 0.5
    own = np.pad(y, 1024)[10 * 512 : 10 * 512 + 2048]
    lags = range(int(RATE / 1000), int(RATE / 80) + 1)
    want = max(own[:-k] @ own[k:] / np.sqrt((own[:-k] @ own[:-k]) * (own[k:] @ own[k:])) for k in lags)
    assert abs(v[10] - want) < 1e-6


# --- labels


def test_zero_shot(spark):
    rng = np.random.default_rng(6)
    names, matrix = [f"l{k}" for k in range(9)], rng.normal(size=(9, 4))
    matrix[8] = matrix[3]
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(rng.normal(size=(40, 4)))] + [(40, None, 1), (41, [0.0] * 4, 1), (42, [1.0, 2.0], 1), (43, matrix[3].tolist(), 0)]
    labels = spark.createDataFrame(list(zip(names, matrix.tolist(), strict=True)), "label string, vector array<double>").coalesce(1)
    got = {r.id: r.labels for r in audio.zero_shot(spark.createDataFrame(rows, "id int, embedding array<double>, kind int"), labels, scale=3.0, most=4).collect()}
    for k, v, _ in rows:
        if k in (40, 41, 42):
            assert got[k] is None
            continue
        z = np.exp([3 * np.dot(v, m) / np.linalg.norm(v) / np.linalg.norm(m) for m in matrix])
        want = sorted(zip(-z / z.sum(), range(9), strict=True), key=lambda x: (round(x[0], 12), x[1]))[:4]
        assert [x.label for x in got[k]] == [names[j] for _, j in want]
        assert np.allclose([x.score for x in got[k]], [-s for s, _ in want])
    assert [x.label for x in got[43]][:2] == ["l3", "l8"]
    assert len(audio.INSTRUMENTS) == 48
    with pytest.raises(ValueError, match="labels"):
        audio.zero_shot(labels, spark.range(audio.MOST_LABELS + 1).select(F.lit("x").alias("label"), F.array(F.lit(1.0)).alias("vector")), "vector")
