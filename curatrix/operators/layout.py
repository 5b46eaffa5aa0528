"""A map of vectors in two dimensions that keeps neighbours together: t-SNE of a bounded sample, all other rows placed by their neighbours in it.

The sample, the SAMPLE distinct vectors with the lowest hashes, is laid out on the driver (its size is fixed, so is the cost); its vectors and places are all that is
sent to the tasks, which place every row in blocks: one matrix product a batch.  The layout begins with the principal components and uses no
random numbers, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.packing import ship

#: Vectors of the sample; neighbours that place a row; rounds of the descent, the first of them with EARLY times the attraction.
SAMPLE, NEIGHBOURS, ROUNDS, EARLY_ROUNDS, EARLY = 1000, 5, 500, 120, 12.0


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b."""
    return np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T)


def affinities(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Symmetric shares of neighbourhood: each row's Gaussian is as wide as gives it ``perplexity`` neighbours, found by bisection for all rows at once."""
    n = len(d)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.full(n, 1 / max(1e-12, np.median(d)))
    least = np.where(np.eye(n, dtype=bool), np.inf, d).min(1, keepdims=True)
    for _ in range(60):
        p = np.exp(-np.minimum(700, (d - least) * beta[:, None]))
        np.fill_diagonal(p, 0)
        p /= np.maximum(1e-300, p.sum(1, keepdims=True))
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return np.maximum((p + p.T) / (2 * n), 1e-12)


def tsne(x: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Places (n, 2) of vectors; 0, 0 for less than two."""
    n = len(x)
    if n < 2:
        return np.zeros((n, 2))
    x = x - x.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    u *= np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1, 1)  # signs that don't depend on the library
    y = np.zeros((n, 2))
    y[:, : min(2, u.shape[1])] = (u * s)[:, :2]
    y *= 1e-4 / max(1e-12, y[:, 0].std())
    p = affinities(distances(x, x), min(30.0, max(2.0, (n - 1) / 3)))
    speed, gain = np.zeros_like(y), np.ones_like(y)
    for k in range(rounds):
        near = 1 / (1 + distances(y, y))
        np.fill_diagonal(near, 0)
        pull = ((EARLY if k < EARLY_ROUNDS else 1) * p - near / near.sum()) * near
        slope = 4 * (pull.sum(1)[:, None] * y - pull @ y)
        gain = np.maximum(0.01, np.where((slope > 0) == (speed > 0), gain * 0.8, gain + 0.2))
        speed = (0.5 if k < EARLY_ROUNDS else 0.8) * speed - max(50.0, n / 48) * gain * slope
        y = y + speed
        y -= y.mean(0)
    return y


def placed(x: np.ndarray, known: np.ndarray, places: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Places of vectors: means of those of the k nearest known ones, weighed by nearness; a vector that is known has its own place."""
    d = distances(x, known)
    k = min(k, len(known))
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    own = np.take_along_axis(d, near, 1)
    weight = np.exp(-own / np.maximum(1e-12, own[:, -1:]) * 2)
    weight[own[:, 0] <= 1e-12 * np.maximum(1, (x**2).sum(1))] = [1.0] + [0.0] * (k - 1)
    return (weight[:, :, None] * places[near]).sum(1) / weight.sum(1)[:, None]


def layout_2d(rows: DataFrame, vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """rows with x and y. Null vectors, and those of another length than most of the sample, have null places; less than two different vectors are at 0, 0."""
    ship(rows.sparkSession)
    own = rows.select(F.transform(vector, lambda v: v.cast("double")).alias("v")).filter("v IS NOT NULL AND NOT exists(v, e -> e IS NULL OR isnan(e))").distinct()
    found = [r.v for r in own.orderBy(F.xxhash64("v"), "v").limit(sample).collect()]
    sizes = [len(v) for v in found]
    width = max(sorted(set(sizes)), key=sizes.count, default=0)
    known = np.array([v for v in found if len(v) == width], float).reshape(sizes.count(width), width)
    places = tsne(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vector)
            sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            x = flat[np.repeat(sizes == width, np.maximum(0, sizes))].reshape((sizes == width).sum(), width)
            out = np.full((len(sizes), 2), np.nan)
            whole = np.isfinite(x).all(1)
            fits = np.flatnonzero(sizes == width)[whole] if len(known) else np.zeros(0, int)
            if len(fits):
                out[fits] = placed(x[whole], known, places)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[:, c], from_pandas=True) for c in (0, 1))], [*batch.schema.names, "x", "y"])

    return rows.mapInArrow(run, rows.limit(0).withColumns({"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")}).schema)


def trustworthiness(x: np.ndarray, y: np.ndarray, k: int = 12) -> float:
    """How far the k nearest in the map are near in truth: 1 if all are, about 0.5 by chance."""
    n = len(x)
    far = lambda z: np.where(np.eye(n, dtype=bool), np.inf, distances(z, z))
    rank = np.argsort(np.argsort(far(x), axis=1, kind="stable"), axis=1)
    near = np.argsort(far(y), axis=1, kind="stable")[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * float(np.maximum(0, np.take_along_axis(rank, near, 1) - k + 1).sum())
