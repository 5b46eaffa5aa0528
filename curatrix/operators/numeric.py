"""Numeric operators over decoded arrays. Decoding itself needs a library that is not here; arrays are the input."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.packing import ship

# Key profiles, names of the keys, and the level below which a mix counts as mono.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
KEYS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
MONO_DB = -30.0


def stereo(left: Column, right: Column) -> Column:
    """label and side/mid level in decibels of two channels (right null: one channel); native folds."""
    halves = lambda sign: F.aggregate(F.zip_with(left, right, lambda a, b: (a + sign * b) / 2), F.lit(0.0), lambda s, x: s + x * x)
    return stereo_of(F.when(right.isNotNull(), halves(1)), F.when(right.isNotNull(), halves(-1)))


def stereo_of(mid: Column, side: Column) -> Column:
    """label and side/mid level in decibels of the energies of mid and side (null: one channel)."""
    db = F.when((mid > 0) & (side > 0), 10 * F.log10(side / mid))
    label = F.when(side.isNull() | ((mid <= 0) & (side <= 0)), "mono").when(mid <= 0, "stereo").when(side <= 0, "mono").when(db < MONO_DB, "mono").otherwise("stereo")
    return F.struct(label.alias("label"), db.alias("db"))


def key_of(chroma: Column, legacy: bool = False) -> Column:
    """The key whose profile correlates best with a mean chroma of 12; '' for a flat one. legacy names the mirrored tonic."""
    ship()

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        profiles = np.array([np.roll(p, k) for k in range(12) for p in (MAJOR, MINOR)])
        profiles = (profiles - profiles.mean(1, keepdims=True)) / profiles.std(1, keepdims=True)
        out = []
        for row in rows:
            x = np.asarray(row if row is not None else [], float)
            if len(x) != 12 or not x.std() > 0:
                out.append("")
                continue
            k, mode = divmod(int((profiles @ (x - x.mean())).argmax()), 2)
            out.append(f"{KEYS[-k % 12 if legacy else k]} {'minor' if mode else 'major'}")
        return pd.Series(out)

    return run(chroma)


def time_signature(beats: Column) -> Column:
    """3/4 or 4/4 by how uneven the mean strengths of the beats of a bar are, '' if neither stands out; 24 beats at least."""
    n = F.size(beats) - F.size(beats) % 12
    own = F.slice(beats, F.lit(1), F.greatest(F.lit(0), n))

    def salience(k: int) -> Column:
        means = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.aggregate(F.filter(own, lambda x, j: j % k == i), F.lit(0.0), lambda a, x: a + x) / (n / k))
        mean = F.aggregate(means, F.lit(0.0), lambda a, x: a + x) / k
        return F.sqrt(F.aggregate(means, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / k) / (mean + 1e-9)

    three, four = salience(3), salience(4)
    clear = (n >= 24) & (F.greatest(three, four) >= 0.08)
    return F.when(clear & (three > four * 1.15), "3/4").when(clear & (four > three * 1.15), "4/4").otherwise("")


def l2_normalize(vector: Column) -> Column:
    """The vector over its length; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def project_2d(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows with x and y: the first two principal components of the centred vectors; 0, 0 for less than two rows.

    The covariance is summed in the tasks; only a matrix of the vectors' width reaches the driver.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if rows.limit(2).count() < 2:
        return rows.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    width = len(rows.select(vector).first()[0])
    mean = rows.agg(*[F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"m{i}") for i in range(width)]).first()
    centred = F.zip_with(vector, F.array(*[F.lit(m) for m in mean]), lambda a, b: a.cast("double") - b)
    own = rows.withColumn("_v", array_to_vector(centred))
    out = PCA(k=2, inputCol="_v", outputCol="_p").fit(own).transform(own).withColumn("_p", vector_to_array("_p"))
    return out.withColumns({"x": F.get("_p", F.lit(0)), "y": F.get("_p", F.lit(1))}).drop("_v", "_p")


def top_labels(scores: Column, most: int = 6) -> Column:
    """The most likely labels of an array of (score, label) after softmax."""
    high = F.array_max(F.transform(scores, lambda s: s["score"]))
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s["score"] - high))
    return F.slice(F.sort_array(F.transform(scores, lambda s: F.struct((F.exp(s["score"] - high) / total).alias("p"), s["label"].alias("label"))), asc=False), 1, most)


def no_vocals(sources: Column, peak_in: Column) -> Column:
    """The sum of arrays, scaled down so that its peak is at most 0.9 of the input's."""
    total = F.aggregate(F.slice(sources, F.lit(2), F.greatest(F.lit(0), F.size(sources) - 1)), F.get(sources, F.lit(0)), lambda a, s: F.zip_with(a, s, lambda x, y: x + y))
    peak = F.array_max(F.transform(total, lambda x: F.abs(x)))
    return F.transform(total, lambda x: x * F.least(F.lit(1.0), F.when(peak > 0, 0.9 * peak_in / peak).otherwise(1.0)))
