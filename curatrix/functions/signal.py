"""Numeric helpers on the samples of one track, called by the Arrow passes of ``operators.audio``.

Spectra are made CHUNK frames at a time, so that memory holds the samples and a few spectra, not the whole spectrogram of a long track.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: Samples of a frame and between frames; frames whose spectra are held at once.
FRAME, HOP, CHUNK = 2048, 512, 256
#: Mel bands, coefficients, decibels below the loudest band that count.
BANDS, COEFFICIENTS, RANGE_DB = 128, 13, 80.0
#: Width of the median filters, values that they sort at once; seconds of the autocorrelation; tempo that is likeliest, and the highest.
MEDIAN, PLACES, AUTO_S, LIKELY_BPM, MOST_BPM = 31, 131072, 8.0, 120.0, 320.0
#: Weight of even beats; pitch range of a voice in hertz; autocorrelation from which a frame counts as voiced.
TIGHTNESS, VOICE_HZ, VOICED = 100.0, (80.0, 1000.0), 0.6


def decode(pcm: bytes, width: int, channels: int) -> np.ndarray:
    """Little-endian samples of 1 (unsigned), 2, 3 or 4 bytes as floats of -1 to 1, (channels, frames); a last part of a frame is left out."""
    if width not in (1, 2, 3, 4) or channels < 1:
        raise ValueError(f"{width} bytes a sample, {channels} channels")
    raw = np.frombuffer(pcm, np.uint8)
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = raw.astype(np.float32) - 128
    elif width == 3:
        x = (np.pad(raw.reshape(-1, 3), ((0, 0), (1, 0))).view("<i4").ravel() >> 8).astype(np.float32)
    else:
        x = raw.view(f"<i{width}").astype(np.float32)
    return x.reshape(-1, channels).T / np.float32(1 << 8 * width - 1)


def spectra(y: np.ndarray, frame: int = FRAME, hop: int = HOP) -> Iterator[np.ndarray]:
    """Magnitudes (frames, bins) of Hann-weighted frames around every hop-th sample, CHUNK at a time."""
    window, rest = _hann(frame), np.zeros(frame // 2, y.dtype)
    views = sliding_window_view(np.concatenate([rest, y, rest]), frame)[::hop]
    for k in range(0, len(views), CHUNK):
        yield np.abs(np.fft.rfft(views[k : k + CHUNK] * window))


@lru_cache(8)
def _hann(width: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)


def _hertz(mel: np.ndarray) -> np.ndarray:
    """Mel: linear to 1000 Hz, then 27 steps to 6400 Hz."""
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@lru_cache(8)
def mel_filters(rate: int, frame: int = FRAME, bands: int = BANDS) -> np.ndarray:
    """Triangles (bands, bins) of equal area, evenly placed in mel up to half the rate."""
    top = rate / 2
    edges = _hertz(np.linspace(0, top * 3 / 200 if top < 1000 else 15 + 27 * np.log(top / 1000) / np.log(6.4), bands + 2))
    bins = np.fft.rfftfreq(frame, 1 / rate)
    up = (bins - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - bins) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel_db(y: np.ndarray, rate: int) -> np.ndarray:
    """Decibels (frames, bands), at most RANGE_DB below the loudest."""
    return _mel_db(spectra(y), rate)


def _mel_db(magnitudes: Iterable[np.ndarray], rate: int) -> np.ndarray:
    filters = mel_filters(rate).T
    db = np.concatenate([10 * np.log10(np.maximum(1e-10, m**2 @ filters)) for m in magnitudes])
    return np.maximum(db, db.max() - RANGE_DB)


def mfcc(y: np.ndarray, rate: int) -> np.ndarray:
    """The first COEFFICIENTS of the orthonormal cosine transform of mel_db, (frames, COEFFICIENTS)."""
    k = np.arange(COEFFICIENTS)[:, None]
    basis = np.cos(np.pi * k * (2 * np.arange(BANDS) + 1) / (2 * BANDS)) * np.where(k == 0, 1, np.sqrt(2)) / np.sqrt(BANDS)
    return mel_db(y, rate) @ basis.T


def ward_cost(n: float, m: float, a: np.ndarray, b: np.ndarray) -> float:
    """How much the squared error grows when runs of n and m frames with sums a and b are joined."""
    d = a / n - b / m
    return float(n * m / (n + m) * (d @ d))


def adjacent_runs(x: np.ndarray, k: int) -> list[int]:
    """The first frames of k runs: neighbours of the lowest Ward cost are joined until k are left; of equal costs the first.

    A heap holds the costs of the present neighbours; outdated entries are known by the lengths that they were made for.
    """
    n = len(x)
    size, total = np.ones(n, np.int64), x.astype(float).copy()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ward_cost(1, 1, total[i], total[i + 1]), i, i + 1, 1, 1) for i in range(n - 1)]
    heapify(heap)
    left = n
    while left > max(1, k) and heap:
        _, i, j, ni, nj = heappop(heap)
        if size[i] != ni or size[j] != nj or after[i] != j:
            continue
        total[i] += total[j]
        size[i], size[j] = ni + nj, 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            heappush(heap, (ward_cost(size[i], size[after[i]], total[i], total[after[i]]), i, after[i], int(size[i]), int(size[after[i]])))
        if (p := before[i]) >= 0:
            heappush(heap, (ward_cost(size[p], size[i], total[p], total[i]), p, i, int(size[p]), int(size[i])))
        left -= 1
    return np.flatnonzero(size).tolist()


def boundaries(y: np.ndarray, rate: int, k: int) -> list[float]:
    """Seconds at which the k most even runs of frames begin (0 first), and the duration."""
    if not len(y):
        return []
    return [*(i * HOP / rate for i in adjacent_runs(mfcc(y, rate), k)), len(y) / rate]


def onset_strength(y: np.ndarray, rate: int) -> np.ndarray:
    """The mean rise of the mel bands from frame to frame, placed at the middle of the rising frame."""
    return _rises(mel_db(y, rate))


def _rises(db: np.ndarray) -> np.ndarray:
    rise = np.maximum(0, np.diff(db, axis=0)).mean(1)
    return np.concatenate([np.zeros(1 + FRAME // (2 * HOP)), rise])[: len(db)]


def tempo(onset: np.ndarray, rate: int) -> float:
    """Beats a minute: the period whose mean local autocorrelation, weighed by how likely a tempo is, is highest; 0 without frames."""
    return tempos([onset], rate)[0]


def tempos(onsets: list[np.ndarray], rate: int) -> list[float]:
    """The tempo of each; what their windows go through is done for CHUNK windows at a time."""
    width = int(AUTO_S * rate / HOP)
    if width < 2:
        return [0.0] * len(onsets)
    window = _hann(width)
    bpm = 60 * rate / HOP / np.arange(1, width)
    likely, fast, half = 0.5 * np.log2(bpm / LIKELY_BPM) ** 2, bpm >= MOST_BPM, width // 2
    views = [sliding_window_view(np.concatenate([np.linspace(0, x[0], half, False), x, np.linspace(0, x[-1], half, False)[::-1]]), width)[: len(x)] for x in onsets if len(x)]
    totals = []
    for part in _grouped(views):
        auto = np.fft.irfft(np.abs(np.fft.rfft(np.concatenate(part) * window, 2 * width)) ** 2)[:, :width]
        most = np.abs(auto).max(1, keepdims=True)
        auto = np.divide(auto, most, out=np.zeros_like(auto), where=most > 0)
        ends = np.cumsum([len(x) for x in part])
        totals += [auto[end - len(x) : end].sum(0) for x, end in zip(part, ends, strict=True)]
    out, parts = [], iter(totals)
    for x in onsets:
        total = sum((next(parts) for _ in range(0, len(x), CHUNK)), np.zeros(width))
        score = np.log1p(1e6 * total[1:] / max(1, len(x))) - likely
        score[fast] = -np.inf
        best = score.argmax()
        out.append(float(bpm[best]) if len(x) and np.isfinite(score[best]) else 0.0)
    return out


def _grouped(views: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Arrays in order, cut into pieces of CHUNK rows, with as many pieces together as have CHUNK rows at most."""
    own, size = [], 0
    for piece in (x[k : k + CHUNK] for x in views for k in range(0, len(x), CHUNK)):
        if own and size + len(piece) > CHUNK:
            yield own
            own, size = [], 0
        own.append(piece)
        size += len(piece)
    if own:
        yield own


def beats(onset: np.ndarray, rate: int, bpm: float) -> np.ndarray:
    """The frames of beats: the chain of strong frames about a beat apart with the highest score."""
    period = round(60 * rate / HOP / bpm) if bpm > 0 else 0
    spread = onset.std(ddof=1) if period >= 1 and len(onset) >= 2 else 0
    if not spread > 0:
        return np.zeros(0, np.int64)
    bell = np.exp(-0.5 * (np.arange(-period, period + 1) * 32 / period) ** 2)
    local = np.convolve(onset / spread, bell)[period : period + len(onset)]
    back = np.arange(-2 * period, -max(1, round(period / 2)) + 1)
    uneven = -TIGHTNESS * np.log(-back / period) ** 2
    # a frame without one before it stands for itself; the few steps of a frame are faster as Python's numbers
    step, steps = -int(back[-1]), uneven.tolist()
    score, link = local.tolist(), [-1] * len(local)
    for i in range(step, len(local)):
        first = max(0, 2 * period - i)
        best = list(map(add, steps[first:], score[i - 2 * period + first : i - step + 1]))
        most = max(best)
        score[i] += most
        link[i] = i - 2 * period + first + best.index(most)
    begun = np.flatnonzero(local[step:] >= 0.01 * local.max())
    score, link = np.array(score), np.array(link)
    link[: step + begun[0] if len(begun) else len(link)] = -1
    peak = (score > np.concatenate([[0.0], score[:-1]])) & (score >= np.concatenate([score[1:], [0.0]]))
    if not peak.any():
        return np.zeros(0, np.int64)
    found = [int(np.flatnonzero(peak & (score * 2 > np.median(score[peak]))).max(initial=0))]
    while link[found[-1]] >= 0:
        found.append(int(link[found[-1]]))
    return np.array(found[::-1])


@lru_cache(8)
def chroma_filters(rate: int, frame: int = FRAME) -> np.ndarray:
    """Weights (12, bins) of the pitch classes from C on: bells around each class, most for the octaves about 440 Hz."""
    hertz = np.fft.rfftfreq(frame, 1 / rate)[1:]
    pitch = 12 * np.log2(hertz / 27.5)  # semitones above the lowest A
    pitch = np.concatenate([[pitch[0] - 18], pitch])
    width = np.concatenate([np.maximum(1, np.diff(pitch)), [1]])
    apart = (pitch - np.arange(12)[:, None] + 6) % 12 - 6
    bells = np.exp(-0.5 * (2 * apart / width) ** 2)
    bells /= np.sqrt((bells**2).sum(0))
    return np.roll(bells * np.exp(-0.5 * ((pitch / 12 - 5) / 2) ** 2), -3, axis=0)


def _compared(x: np.ndarray, n: int, turned: bool = False) -> np.ndarray:
    """Along the first axis, the lesser and the greater of each value and the one n places on, in runs of 2 n; ``turned``: the second halves run backwards."""
    pairs = x.reshape(-1, 2, n, *x.shape[1:])
    first, second, out = pairs[:, 0], pairs[:, 1, ::-1] if turned else pairs[:, 1], np.empty_like(pairs)
    np.minimum(first, second, out=out[:, 0])
    np.maximum(first, second, out=out[:, 1])
    return out.reshape(x.shape)


def _smoothed(x: np.ndarray, n: int) -> np.ndarray:
    """Bitonic runs of n along the first axis, sorted; n: a power of two."""
    while n > 1:
        n //= 2
        x = _compared(x, n)
    return x


def _sorted(x: np.ndarray) -> np.ndarray:
    """The first axis, whose length is a power of two, sorted at every place at once (bitonic sort)."""
    n = 1
    while n < len(x):
        x = _smoothed(_compared(x, n, turned=True), n)
        n *= 2
    return x


def medians(x: np.ndarray, axis: int, width: int = MEDIAN, lengths: list[int] | None = None) -> np.ndarray:
    """Medians of ``width`` neighbours along an axis, mirrored at the ends; width: 3, 7, 15, 31 and so on. ``lengths``: of the parts of axis 0, each with its own ends.

    The windows of (width + 1) / 2 neighbouring places have as many values in common, which are sorted once.  The places are halved until each is alone;
    either half adds what its windows have in common beyond that, sorted, and keeps the values that can still be its medians, as many as it has places:
    the middle third of both lists, which is bitonic after two comparisons a value.
    """
    group = (width + 1) // 2
    if width < 3 or width & (width + 1):
        raise ValueError(f"windows of {width}")
    if axis == 1:
        return np.ascontiguousarray(medians(np.ascontiguousarray(x.T), 0, width).T)
    own = np.array([len(x)] if lengths is None else lengths, int)
    groups = -(-own // group)
    part = np.repeat(np.arange(len(own)), groups)
    first = group * (np.arange(len(part)) - (np.cumsum(groups) - groups)[part])
    n, start = own[part], (np.cumsum(own) - own)[part]
    at = (first + np.arange(1 - group, width)[:, None]) % (2 * n)
    at = np.minimum(at, 2 * n - 1 - at) + start
    real = (first[:, None] + np.arange(group) < n[:, None]).ravel()
    out, step = np.empty_like(x), max(1, PLACES // max(1, len(real)))
    for k in range(0, x.shape[1], step):
        piece = np.ascontiguousarray(x[:, k : k + step])
        half, begins = group, np.zeros(1, int)  # of each part of the group: where the window of its first place begins
        known = _sorted(piece.take(at[group - 1 : width], 0))
        while half > 1:
            half //= 2
            more = _sorted(piece.take(at[np.arange(half)[:, None, None] + begins[:, None] + np.array([half - 1, width])], 0))
            known = np.maximum(known[:half].reshape(half, len(begins), 1, *known.shape[-2:]), np.minimum(known[half:].reshape(half, len(begins), 1, *known.shape[-2:]), more[::-1]))
            begins = (begins[:, None] + np.array([0, half])).ravel()
            known = _smoothed(known.reshape(half, len(begins), *known.shape[-2:]), half)
        out[:, k : k + step] = known[0].swapaxes(0, 1).reshape(len(real), -1)[real]
    return out


def harmonic_shares(magnitude: np.ndarray, lengths: list[int] | None = None) -> np.ndarray:
    """For every frame and bin the share that lasts in time against that which spreads over pitch. ``lengths``: frames of each track, if they are several."""
    lasting, spreading = medians(magnitude, 0, lengths=lengths) ** 2, medians(magnitude, 1) ** 2
    both = lasting + spreading
    return np.divide(lasting, both, out=np.full_like(both, 0.5), where=both > 0)


def features(tracks: list[np.ndarray], rate: int) -> list[dict]:
    """Of (channels, frames) samples: energies of mid and side, tempo, strengths of beats, mean chroma, energies by kind and band. Short tracks share their steps."""
    hertz, out, magnitudes, onsets = np.fft.rfftfreq(FRAME, 1 / rate), [], [], []
    bands = {name: slice(*np.searchsorted(hertz, (lo, np.nextafter(hi, np.inf)))) for name, lo, hi in (("bass", 50, 250), ("middle", 250, 2000), ("high", 2000, 8000))}
    for sides in tracks:
        wide = sides.astype(np.float64)
        mid, side = (float((((wide[0] + s * wide[1]) / 2) ** 2).sum()) for s in (1, -1)) if len(wide) > 1 else (0.0, None)
        parts = []
        onsets.append(_rises(_mel_db((parts.append(m.astype(np.float32)) or m for m in spectra((sum(wide) / len(wide)).astype(np.float32))), rate)))
        magnitudes.append(np.concatenate(parts))
        power = magnitudes[-1] ** 2
        chroma = power @ chroma_filters(rate).T
        most = chroma.max(1, keepdims=True)
        chroma = np.divide(chroma, most, out=np.zeros_like(chroma), where=most > 0).mean(0)
        energy = {name: float(np.ascontiguousarray(power.T[own]).mean()) if own.start < own.stop else 0.0 for name, own in bands.items()}
        out.append({"mid": mid, "side": side, "chroma": chroma.astype(float).tolist(), **energy})
    for found, onset, bpm in zip(out, onsets, tempos(onsets, rate), strict=True):
        found |= {"bpm": round(bpm), "beats": onset[beats(onset, rate, bpm)].astype(float).tolist()}
    lengths = [len(m) for m in magnitudes]
    magnitude = np.concatenate(magnitudes) if len(tracks) > 1 else magnitudes[0]
    share = harmonic_shares(magnitude, lengths)
    for kind, own in (("harmonic", (magnitude * share) ** 2), ("percussive", (magnitude * (1 - share)) ** 2)):
        for found, end, n in zip(out, np.cumsum(lengths), lengths, strict=True):
            found[kind] = float(own[end - n : end].mean())
    return out


def voicing(y: np.ndarray, rate: int, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """For every frame the highest normalised autocorrelation at a period of VOICE_HZ."""
    views = sliding_window_view(np.pad(y, frame // 2), frame)[::hop]
    lags = np.arange(max(1, int(rate / VOICE_HZ[1])), min(frame // 2, int(rate / VOICE_HZ[0])) + 1)
    out = np.zeros(len(views))
    for k in range(0, len(views) if len(lags) else 0, CHUNK):
        own = views[k : k + CHUNK].astype(float)
        auto = np.fft.irfft(np.abs(np.fft.rfft(own, 2 * frame)) ** 2)[:, lags]
        upto = np.pad(np.cumsum(own**2, 1), ((0, 0), (1, 0)))
        norm = np.sqrt(np.maximum(0, upto[:, frame - lags] * (upto[:, [frame]] - upto[:, lags])))
        out[k : k + CHUNK] = np.divide(auto, norm, out=np.zeros_like(auto), where=norm > 1e-9).max(1)
    return out


def lead_mask(y: np.ndarray, rate: int) -> np.ndarray:
    """For every sample the share that belongs to the lead voice: high where a frame is voiced and its lasting part is strong."""
    magnitude = np.concatenate([m.astype(np.float32) for m in spectra(y)])
    strength = np.sqrt(((magnitude * harmonic_shares(magnitude)) ** 2).mean(1))
    salience = strength * (voicing(y, rate) >= VOICED)
    salience = salience / (salience.max(initial=0) + 1e-9)
    mask = np.repeat(1 / (1 + np.exp(-8 * (salience - 0.5))), HOP)[: len(y)]
    return np.pad(mask, (0, len(y) - len(mask)))
