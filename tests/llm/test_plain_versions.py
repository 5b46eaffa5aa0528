"""Training, kernels and spectra against plain versions, written from their definitions one number at a time."""

import cmath
import math
import random

import numpy as np
import pytest

from curatrix.llm import media, quality, toxicity


# --- quality: hashed features, FTRL-proximal, sparse dot products


def plain_ftrl(sample, counts, bits, updates):
    z, n, zb, nb = [0.0] * (1 << bits), [0.0] * (1 << bits), 0.0, 0.0

    def weight(k):
        return 0.0 if abs(z[k]) <= quality.L1 else -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    bias = 0.0
    share = {c: len(sample) * counts.get(c, 0) / max(1, sum(counts.values())) / max(1, sum(y == c for y, _ in sample)) for c in (0, 1)}
    order = np.random.default_rng(7)
    for _ in range(-(-updates // len(sample))):
        for k in order.permutation(len(sample)):
            y, own = sample[k]
            x = 1 / math.sqrt(len(own)) if len(own) else 0.0
            w = {i: weight(i) for i in own.tolist()}
            error = (1 / (1 + math.exp(-(sum(w.values()) * x + bias))) - y) * share[y]
            for i in w:
                g = error * x
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
            sigma = (math.sqrt(nb + error * error) - math.sqrt(nb)) / quality.ALPHA
            zb, nb = zb + error - sigma * bias, nb + error * error
            bias = -zb / ((quality.BETA + math.sqrt(nb)) / quality.ALPHA)
    return [weight(k) for k in range(1 << bits)], bias


def test_quality_training_and_scores(spark):
    rng = random.Random(1)
    texts = [(k % 2, " ".join(rng.choice(["good", "fine", "text"] if k % 2 else ["bad", "junk", "text"]) + str(rng.randrange(3)) for _ in range(rng.randrange(1, 30)))) for k in range(40)] + [(0, ""), (1, "!?")]
    sample, counts = [(y, quality.features(t, 10)) for y, t in texts], {0: 300, 1: 100}
    weights, bias = quality.train(sample, counts, 10, 200)
    want, want_bias = plain_ftrl(sample, counts, 10, 200)
    assert np.allclose(weights, want, atol=1e-6) and abs(bias - want_bias) < 1e-9 and np.count_nonzero(weights) > 10
    # scores: the dot product of the distinct buckets
    full = quality.train([(y, quality.features(t)) for y, t in texts], counts, updates=100)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    for r in quality.score(docs, full).collect():
        own = quality.features(texts[r.doc_id][1] if r.doc_id < 99 else "")
        margin = sum(float(full[0][i]) for i in own.tolist()) / math.sqrt(max(1, len(own))) + full[1]
        assert abs(r.score - 1 / (1 + math.exp(-margin))) < 1e-6 and r.predicted == int(r.score >= 0.5)


def test_quality_features_are_words_and_pairs():
    def bucket(hashes):
        a = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
        mixed = 0
        for h, m in zip(hashes, a, strict=False):
            mixed ^= h * m % (1 << 64)
        return mixed >> (64 - quality.BITS)

    from zlib import crc32

    text = "A b, a B c"
    words = [crc32(w.encode()) for w in ["a", "b", ",", "a", "b", "c"]]
    want = {bucket([w]) for w in words} | {bucket(p) for p in zip(words, words[1:], strict=False)}
    assert set(quality.features(text).tolist()) == want


# --- toxicity: the gap-weighted subsequence kernel, Nyström features, the margin of a unit


def subsequences(window):
    """Weights of the subsequences of three characters by their codes."""
    codes, out = toxicity.encode([window])[0].tolist(), {}
    n = len(window)
    for a in range(n):
        for c in range(a + 2, min(n, a + toxicity.SPAN)):
            for b in range(a + 1, c):
                key = (codes[a], codes[b], codes[c])
                out[key] = out.get(key, 0.0) + toxicity.DECAY ** (c - a + 1)
    return out


def plain_kernel(a, b):
    x, y = subsequences(a), subsequences(b)
    dot = lambda p, q: sum(v * q.get(k, 0.0) for k, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


@pytest.mark.parametrize("seed", range(3))
def test_kernel(seed):
    rng = random.Random(seed)
    landmarks = [toxicity.windows_of(u)[0] for u in ("idiot", "moron", "stupid", "worthless", "éèß", "aaaa")]
    units = ["idiot", "idiots", "i-d-iot", "moroon", "stup1d", "worth", "xyz", "aaaaaaa", "ééè", "abc"] + ["".join(rng.choice("idotmrnsupa") for _ in range(rng.randrange(3, 18))) for _ in range(60)]
    windows = [w for u in units for w in toxicity.windows_of(u)]
    rows, got = toxicity.Kernel(landmarks)(windows)
    want = np.array([[k if (k := plain_kernel(w, x)) >= toxicity.FLOOR else 0.0 for x in landmarks] for w in windows]) ** toxicity.POWER
    near = np.array([[abs(plain_kernel(w, x) - toxicity.FLOOR) < 1e-5 for x in landmarks] for w in windows])  # rounding may go either way
    full = np.zeros_like(want)
    full[rows] = got
    assert np.allclose(np.where(near, 0, full), np.where(near, 0, want), atol=1e-5)
    assert set(rows.tolist()) >= set(np.flatnonzero(np.where(near, 0, want).any(axis=1)).tolist()) and len(rows) < len(windows)


def test_margin_is_that_of_the_nearest_window():
    sample = [(1, f"you are an {w} friend{k}") for k in range(30) for w in ("idiot", "moron")] + [(0, f"you are a good friend{k} indeed") for k in range(60)]
    model = toxicity.train(sample, {0: 90, 1: 10})
    for unit in ("idiot", "iddiot", "moron", "friend", "good", "an-idiot-that-is-very-long-indeed"):
        margins = []
        for w in toxicity.windows_of(unit):
            kernels = np.array([k**toxicity.POWER if (k := plain_kernel(w, x)) >= toxicity.FLOOR else 0.0 for x in model.kernel.landmarks])
            margins.append(float(kernels @ model.weights) + model.bias)
        assert abs(model.margins([unit])[0] - max(model.bias, *margins)) < 1e-4
    assert toxicity.Scorer(model)(["what an iddiot", "a fine day"])[0] > 0.5


# --- media: the short-time Fourier transform, its peaks and their pairs


def plain_fingerprint(payload):
    unit, hop = media.UNIT, media.HOP
    frames = []
    for start in range(0, len(payload) - unit + 1, hop):
        windowed = [(payload[start + i] - 128) * float(media._HANN[i]) for i in range(unit)]
        frames.append([float(np.rint(abs(sum(v * cmath.exp(-2j * math.pi * b * i / unit) for i, v in enumerate(windowed))) * 16)) for b in range(unit // 2 + 1)])
    mags = [[0.0 if b < 2 else v for b, v in enumerate(f)] for f in frames]
    peaks = []
    for t, frame in enumerate(mags):
        level, found = max(sum(frame) / len(frame), 16), []
        for b, v in enumerate(frame):
            around = [mags[s][c] for s in (t - 1, t, t + 1) if 0 <= s < len(mags) for c in range(b - 2, b + 3) if 0 <= c < len(frame)]
            if v > level and v == max(around):
                found.append((-v, b))
        peaks += [(t, b) for b in sorted(b for _, b in sorted(found)[: media.PEAKS])]
    pairs = [(t, f << 13 | g << 6 | u - t) for k, (t, f) in enumerate(peaks) for u, g in peaks[k + 1 : k + 1 + media.FAN] if u - t <= media.REACH]
    return sorted(pairs)


@pytest.mark.parametrize("text", ["", "a plain text of some length, with Ümlauts and 日本 in it. " * 12, "ab" * 700, "\x00\x7f" * 300])
def test_fingerprints(text):
    payload = media.payload_of(text.encode())
    times, hashes = media.fingerprint(payload)
    assert list(zip(times.tolist(), hashes.tolist(), strict=True)) == plain_fingerprint(payload)
    assert media.read_wav(media.write_wav(payload)) == payload
