"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

A text's features are its distinct words and word pairs, hashed into 2**BITS buckets, each with the weight
1 / sqrt(features).  Training (FTRL-Proximal, passes over a bounded sample of labelled texts until UPDATES are made) runs
on the driver; the weights, 2**BITS floats, are the only thing sent to the tasks, which score texts as sparse
dot products.

Defined results: null and empty texts have no features and score by the bias alone; very long texts are read whole; repeated rows score alike;
a null doc_id is scored like any, counts as '' for what is held out and never learned from;
without usable labels every score is 0.5; with one class only, the score follows that class; extra columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from curatrix.llm._run import map_batches, sql_text, table
from curatrix.llm._sample import held_out, labelled_sample

#: Feature buckets (as a power of two), labelled texts of either class to learn from, updates at least.
BITS, SAMPLE, UPDATES = 18, 2000, 16_000
#: FTRL: learning rate, its smoothing, and the two regularisers.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.1

_TOKENS = re.compile(r"\w+|[^\w\s]+")
#: Hashes of words seen in this Python worker; emptied when full.
_SEEN: dict[str, int] = {}
_MOST_SEEN = 100_000


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Sorted distinct buckets of the words and word pairs of a text."""
    if len(_SEEN) > _MOST_SEEN:
        _SEEN.clear()
    words, seen = _TOKENS.findall(text.lower()), _SEEN
    hashes = []
    for w in words:
        if (h := seen.get(w)) is None:
            h = seen[w] = crc32(w.encode())
        hashes.append(h)
    one = np.array(hashes, np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    both = np.concatenate([one * np.uint64(0x9E3779B97F4A7C15), two]) >> np.uint64(64 - bits)
    used = np.zeros(1 << bits, bool) if len(both) > 1 << (bits - 3) else None
    if used is None:
        return np.unique(both).astype(np.int64)
    used[both.astype(np.int64)] = True
    return np.flatnonzero(used)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def train(sample: list[tuple[int, np.ndarray]], counts: dict[int, int], bits: int = BITS, updates: int = UPDATES) -> tuple[np.ndarray, float]:
    """Weights and bias. Rows of a class weigh so that the classes' shares are those of ``counts``."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = bias = 0.0
    got = [sum(1 for y, _ in sample if y == c) for c in (0, 1)]
    total = max(1, sum(counts.get(c, 0) for c in (0, 1)))
    share = [len(sample) * counts.get(c, 0) / total / max(1, got[c]) for c in (0, 1)]
    order = np.random.default_rng(7)
    for _ in range(-(-updates // max(1, len(sample)))):
        for k in order.permutation(len(sample)):
            y, f = sample[k]
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) > L1, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(nf)) / ALPHA + L2), 0)
            x = 1 / math.sqrt(len(f)) if len(f) else 0.0
            err = (sigmoid(float(w.sum()) * x + bias) - y) * share[y]
            g = err * x
            sigma = (np.sqrt(nf + g * g) - np.sqrt(nf)) / ALPHA
            z[f] = zf + g - sigma * w
            n[f] = nf + g * g
            sigma = (math.sqrt(nb + err * err) - math.sqrt(nb)) / ALPHA
            zb, nb = zb + err - sigma * bias, nb + err * err
            bias = -zb / ((BETA + math.sqrt(nb)) / ALPHA)
    return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0).astype(np.float32), bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 3, rest: int = 1, most: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A model of the labelled texts that are not held out; ``most`` texts of either class at most."""
    sample, counts = labelled_sample(docs, labels, label, held_out(mod, rest), most)
    return train([(y, features(t)) for y, t in sample], counts)


def score(docs: DataFrame, model: tuple[np.ndarray, float], mod: int = 3, rest: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            scores = []
            for text in batch.column(2):
                f = features(text.as_py())
                scores.append(sigmoid(float(weights[f].sum(dtype=np.float64)) / math.sqrt(max(1, len(f))) + bias))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", held_out(mod, rest).alias("held_out"), sql_text().alias("text")), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_quality": op6_quality}
ORACLE_SQL: dict[str, str] = {}
