"""Toxicity: support vector machine over a gap-weighted subsequence string kernel, with Nyström landmarks.

A unit is a word between two border marks; single characters set apart by blanks or marks ("i d i o t", "i - d - i - o - t")
are joined to one unit, a word with marks inside ("i--d--i--o--t") also counts without them, long units are windowed.  The kernel of two units compares all subsequences of ORDER characters within
SPAN places, each weighing DECAY ** places, normalised and raised to the power POWER; inserted characters only
lower it.  Landmarks are units that tell toxic texts from others, picked until they cover the toxic texts.  A unit's
features are its kernels with the landmarks times the inverse root of the landmarks' own kernel matrix (Nyström).

Labels belong to texts, not to sentences, so training alternates (multiple-instance learning): the most toxic
unit of each toxic text is its witness, all units of other texts are negatives, and a linear SVM (hinge loss,
averaged subgradients) is fitted to both.  A text scores by its most toxic unit, through a logistic curve fitted to the sample.

Training takes a bounded sample of labelled texts on the driver; what is sent to the tasks is a table of fixed size.

Defined results: null and empty texts have no unit and score lowest; repeated rows score alike; a null doc_id is scored like any, counts as '' for what is held out and never learned from; without toxic or
without other labels every score is 0; texts are read whole; extra columns are kept by ``reject`` and not read by ``score``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from curatrix.llm._run import map_batches, sql_text, table
from curatrix.llm._sample import held_out, labelled_sample

#: The kernel: characters of a subsequence, places that it may span, decay by place, power of the normalised kernel.
ORDER, SPAN, DECAY, POWER = 3, 6, 0.7, 3
#: Normalised kernels below this count as 0; so do units of whose weight (squared, repeats apart) the landmarks share less than its square.
FLOOR = 0.3
#: Labelled texts of either class to learn from, landmarks, rounds of witnesses, subgradient steps of a round.
SAMPLE, LANDMARKS, ROUNDS, STEPS = 1500, 64, 3, 240
#: Characters of a unit, and the step between windows of longer ones.
WIDTH, STEP = 20, 10
#: Windows compared at once: bounds memory, whatever the units' lengths.
AT_ONCE = 1024
#: Codes of a character.
CODES = 64

_SINGLES = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
#: Single letters or digits set apart by any blanks and marks, and the marks within a word.
_APART = re.compile(r"(?<![^\W_])[^\W_](?=[\W_])(?:[\W_]+[^\W_](?![^\W_])){2,}")
_MARKS = re.compile(r"[\W_]+")
#: A single letter or digit between marks.
_ALONE = re.compile(r"(?<![^\W_])[^\W_](?![^\W_])")
_WITHIN = re.compile(r"(?<=[^\W_])[\W_]+(?=[^\W_])")
_OFFSETS = [(i, j, DECAY ** (j + 1)) for j in range(2, SPAN) for i in range(1, j)]


def units_of(text: str) -> set[str]:
    """The distinct units of a text."""
    low = text.lower()
    return _joined(low).union(*map(units_of_token, set(low.split())))


def units_of_token(token: str) -> set[str]:
    """The units within what lies between two blanks: itself, without marks, and single characters joined."""
    out = {token} if len(token) > 2 else set()
    if not token.isalnum():
        out.update(_MARKS.sub("", run) for run in _APART.findall(token))
        if len(bare := _WITHIN.sub("", token)) > 2:
            out.add(bare)
    return out


def _joined(low: str) -> set[str]:
    """The units of single characters across blanks."""
    out = {"".join(run.split()) for run in _SINGLES.findall(low)}
    out.update([u for w in out if not w.isalnum() and len(u := _WITHIN.sub("", w)) > 2])
    out.update(_MARKS.sub("", run) for run in _APART.findall(low))
    return out


def is_loose(token: str) -> bool:
    """Whether a run of single characters across blanks may begin, end or go on in the token."""
    return len(token) == 1 or not token.isalnum() and (_ALONE.search(token) is not None or not _MARKS.sub("", token))


def windows_of(unit: str) -> list[str]:
    """The unit between border marks; one longer than WIDTH in overlapping windows that cover it."""
    unit = f"\x02{unit}\x03"
    if len(unit) <= WIDTH:
        return [unit]
    return [unit[i : i + WIDTH] for i in range(0, len(unit) - WIDTH + STEP, STEP)]


def encode(windows: list[str]) -> np.ndarray:
    """Character codes, 1 to CODES - 1, by row; 0 behind the end."""
    width = max(map(len, windows))
    points = np.array(windows, f"U{width}").view(np.uint32).reshape(len(windows), width)
    letters = (points >= 97) & (points <= 122)
    other = 30 + points * np.uint32(2654435761) % np.uint32(34)  # the others share the remaining codes
    codes = np.where(letters, points - 96, np.where(points == 2, 27, np.where(points == 3, 28, other)))
    return np.where(points == 0, 0, codes).astype(np.int32)


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the subsequences of each row (-1: none), and the weights of the columns."""
    n, width = codes.shape
    pad = np.zeros((n, width + SPAN), np.int32)
    pad[:, :width] = codes
    keys, weights = [], []
    for i, j, weight in _OFFSETS:
        a, b, c = pad[:, :width], pad[:, i : i + width], pad[:, j : j + width]
        keys.append(np.where(c > 0, (a * CODES + b) * CODES + c, -1))
        weights.append(np.full(width, weight, np.float32))
    return np.concatenate(keys, axis=1), np.concatenate(weights)


def own_kernel(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The kernel of each row with itself."""
    out = np.empty(len(keys))
    for at in range(0, len(keys), 4096):
        part = keys[at : at + 4096]
        order = np.argsort(part, axis=1, kind="stable")
        sorted_, w = np.take_along_axis(part, order, 1), np.where(np.take_along_axis(part, order, 1) >= 0, weights[order], 0).astype(np.float64)
        new = np.ones(part.shape, bool)
        new[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
        sums = np.add.reduceat(w.ravel(), starts := np.flatnonzero(new))
        out[at : at + 4096] = np.bincount(starts // part.shape[1], sums * sums, len(part))
    return out


class Kernel:
    """Kernels with some landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        keys, weights = subsequences(encode(landmarks))
        used = np.unique(keys[keys >= 0])
        self.place = np.full(CODES**3, -1, np.int32)
        self.place[used] = np.arange(len(used))
        self.table = np.zeros((len(used), len(landmarks)), np.float32)
        row, col = np.nonzero(keys >= 0)
        np.add.at(self.table, (self.place[keys[row, col]], row), weights[col])
        self.table /= np.sqrt(own_kernel(keys, weights))[None, :].astype(np.float32)
        # the most that some landmarks have of a subsequence, for ever smaller groups of like landmarks
        order = np.argsort(landmarks)
        groups = [np.array_split(order, k) for k in (1, 4, 16) if k < len(landmarks)]
        self.most = [np.stack([self.table[:, part].max(axis=1, initial=0) for part in parts], axis=1) for parts in groups]

    def __call__(self, windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the windows that have a kernel of FLOOR or more with some landmark; the kernels of these."""
        keys, weights = subsequences(encode(windows))
        row, col = np.nonzero((at := np.where(keys >= 0, self.place[keys], -1)) >= 0)
        # no kernel exceeds the root of what the shared subsequences weigh against the whole unit, repeats apart
        least = FLOOR**2 * ((keys >= 0) * weights**2).sum(axis=1)
        keep = (np.bincount(row, weights[col] ** 2, len(windows)) >= least)[row]
        row, at, weight = row[keep], at[row[keep], col[keep]], weights[col[keep]][:, None]
        # nor what every shared subsequence would weigh with the landmark of a group that has most of it
        for table in [*self.most, self.table]:
            if not len(row):
                return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)), np.float32)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            sums = np.add.reduceat(table[at] * weight, first, axis=0)
            if table is not self.table:
                near = sums.max(axis=1).astype(np.float64) ** 2 >= least[row[first]] * (1 - 1e-5)  # sums are rounded
                keep = np.repeat(near, np.diff(np.append(first, len(row))))
                row, at, weight = row[keep], at[keep], weight[keep]
        rows = row[first]
        out = sums / np.sqrt(own_kernel(keys[rows], weights))[:, None].astype(np.float32)
        out = np.where(out >= FLOOR, out, 0) ** POWER
        some = out.any(axis=1)
        return rows[some], out[some]

    def all(self, units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of all units' windows, in pieces of AT_ONCE: numbers of the units that have a kernel with some landmark, and the kernels."""
        windows, owner = [], []
        for k in sorted(range(len(units)), key=lambda k: len(units[k])):
            for w in windows_of(units[k]):
                windows.append(w)
                owner.append(k)
                if len(windows) == AT_ONCE:
                    rows, kernels = self(windows)
                    yield np.array(owner)[rows], kernels
                    windows, owner = [], []
        if windows:
            rows, kernels = self(windows)
            yield np.array(owner)[rows], kernels


class Model:
    """Kernel, weights of the landmarks and of the logistic curve."""

    def __init__(self, kernel: Kernel | None, weights: np.ndarray | None, bias: float, slope: float, shift: float):
        self.kernel, self.weights, self.bias, self.slope, self.shift = kernel, weights, bias, slope, shift

    def margins(self, units: list[str]) -> np.ndarray:
        """The SVM's margin of each unit."""
        out = np.full(len(units), self.bias)
        for owner, kernels in self.kernel.all(units):
            np.maximum.at(out, owner, (kernels @ self.weights + self.bias).astype(float))
        return out

    def score(self, margin: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * margin + self.shift))))


def pick_landmarks(toxic: list[list[str]], clean: list[list[str]], most: int = LANDMARKS) -> list[str]:
    """Units that toxic texts hold and others hardly do, each the best for the toxic texts that have least of those before."""
    seen = Counter(u for t in toxic for u in t)
    against = Counter(u for t in clean for u in t)
    known = sorted(u for u, n in seen.items() if n > 1 and n * len(clean) > 5 * against[u] * len(toxic))
    holders = {u: [] for u in known}
    for k, t in enumerate(toxic):
        for u in t:
            if u in holders:
                holders[u].append(k)
    cover, out = np.ones(len(toxic)), []
    gains = {u: np.array(h) for u, h in holders.items()}
    worth = {u: cover[h].sum() / (1 + against[u]) for u, h in gains.items()}
    while worth and len(out) < most:
        best = max(worth, key=lambda u: (worth[u], u))
        now = cover[gains[best]].sum() / (1 + against[best])
        if now < worth[best] - 1e-9:  # stale
            worth[best] = now
            continue
        if now < 0.02:
            break
        cover[gains[best]] *= 0.6
        out.append(best)
        del worth[best]
    return out


def train(sample: list[tuple[int, str]], counts: dict[int, int]) -> Model:
    """A model of (label, text) rows; classes weigh in the logistic curve as in ``counts``."""
    # equal units are one object, in lists: a third of what sets of their own would take of the driver's memory
    names: dict[str, str] = {}
    texts = [(y, sorted(names.setdefault(u, u) for u in units_of(t))) for y, t in sample]
    toxic, clean = [u for y, u in texts if y], [u for y, u in texts if not y]
    landmarks = pick_landmarks(toxic, clean) if toxic and clean else []
    if not landmarks:
        return Model(None, None, -30.0, 1.0, 0.0)
    kernel = Kernel([windows_of(u)[0] for u in landmarks])
    _, own = kernel(kernel.landmarks)
    values, vectors = np.linalg.eigh(own.astype(np.float64))
    good = values > 1e-3 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # features: kernels @ root

    # kernels of the units that have any; the others are all alike
    vocabulary = sorted(names)
    number, kernels = {}, []
    for owner, some in kernel.all(vocabulary):
        for k, own_k in zip(owner.tolist(), some, strict=True):
            if (u := vocabulary[k]) not in number:
                number[u] = len(kernels)
                kernels.append(own_k)
    kernels = np.array(kernels, np.float32)
    features = kernels @ root.astype(np.float32)
    bags = [np.array([number[u] for u in t if u in number], np.int64) for t in toxic]
    fair = [np.array([number[u] for u in t if u in number], np.int64) for t in clean]
    negative = np.unique(np.concatenate(fair))
    # the first witnesses: units near landmarks that toxic texts come nearer to than others do
    nearest = lambda bags: sum(kernels[b].max(axis=0) for b in bags if len(b)) / len(bags)
    weights = np.linalg.lstsq(root, nearest(bags) - nearest(fair), rcond=None)[0]
    bias = 0.0
    for _ in range(ROUNDS):
        margins = features @ weights
        witness = [b[margins[b].argmax()] for b in bags if len(b)]
        x = features[[*witness, *negative.tolist()]]
        y = np.r_[np.ones(len(witness)), -np.ones(len(negative))].astype(np.float32)
        each = np.r_[np.full(len(witness), 0.5 / max(1, len(witness))), np.full(len(negative), 0.5 / max(1, len(negative)))].astype(np.float32)
        weights, bias, mean_w, mean_b = np.zeros(x.shape[1], np.float32), 0.0, 0.0, 0.0
        for step in range(1, STEPS + 1):
            pull = each * y * (y * (x @ weights + bias) < 1)
            rate = 8 / math.sqrt(step)
            weights, bias = weights + rate * (pull @ x - 1e-3 * weights), bias + rate * float(pull.sum())
            if step > STEPS // 2:
                mean_w, mean_b = mean_w + weights / (STEPS - STEPS // 2), mean_b + bias / (STEPS - STEPS // 2)
        weights, bias = mean_w, mean_b
    margins = features @ weights + bias
    tops = np.array([max(bias, margins[b].max()) if len(b) else bias for b in [*bags, *fair]])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
    total = max(1, counts.get(0, 0) + counts.get(1, 0))
    each = np.where(y > 0, counts.get(1, 0) / total / len(toxic), counts.get(0, 0) / total / len(clean))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-np.clip(slope * tops + shift, -30, 30)))
        r, h = each * (p - y), each * p * (1 - p) + 1e-9
        g = np.array([(r * tops).sum() + 1e-4 * slope, r.sum()])
        m = np.array([[(h * tops * tops).sum() + 1e-4, (h * tops).sum()], [(h * tops).sum(), h.sum() + 1e-9]])
        d = np.clip(np.linalg.solve(m, g), -2, 2)
        slope, shift = slope - d[0], shift - d[1]
    return Model(kernel, (root @ weights).astype(np.float32), float(bias), float(slope), float(shift))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 5, rest: int = 0, most: int = SAMPLE) -> Model:
    """A model of the labelled texts that are not held out; ``most`` texts of either class at most."""
    return train(*labelled_sample(docs, labels, label, held_out(mod, rest), most))


class Scorer:
    """Scores of texts; margins of tokens seen are kept, up to a bound."""

    MOST = 150_000

    def __init__(self, model: Model):
        self.model, self.seen, self.loose = model, {}, set()

    @classmethod
    def of(cls, model: Model) -> Scorer:
        """The model's scorer, kept beside it, so that a worker's next task finds the tokens seen."""
        if getattr(model, "scorer", None) is None:
            model.scorer = cls(model)
        return model.scorer

    def _learn(self, tokens: set[str]) -> None:
        """Keep each token's most toxic unit."""
        order = sorted(tokens)
        units = [units_of_token(t) for t in order]
        every = sorted(set().union(*units))
        margin = dict(zip(every, self.model.margins(every).tolist(), strict=True))
        for token, own in zip(order, units, strict=True):
            self.seen[token] = max(map(margin.__getitem__, own), default=self.model.bias)
        self.loose.update(t for t in order if is_loose(t))

    def __call__(self, texts: list[str]) -> list[float]:
        if self.model.kernel is None:
            return [0.0] * len(texts)
        out = []
        for text in texts:
            low = text.lower()
            words = low.split()
            own = set(words)
            out.append((low, words, own))
        if len(self.seen) > self.MOST:
            self.seen.clear()
            self.loose.clear()
        if fresh := set().union(*(own for _, _, own in out)) - self.seen.keys():
            self._learn(fresh)
        tops = [max(map(self.seen.__getitem__, own), default=self.model.bias) for _, _, own in out]
        # single characters across blanks need two loose tokens side by side
        runs = {k: _joined(low) for k, (low, words, own) in enumerate(out) if not self.loose.isdisjoint(own) and any(a in self.loose and b in self.loose for a, b in zip(words, words[1:], strict=False))}
        every = sorted(set().union(*runs.values()))
        margin = dict(zip(every, self.model.margins(every).tolist(), strict=True))
        for k, units in runs.items():
            tops[k] = max([tops[k], *map(margin.__getitem__, units)])
        return [self.model.score(m) for m in tops]


def score(docs: DataFrame, model: Model, mod: int = 5, rest: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(sent.value)
        for batch in batches:
            scores = scorer(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", held_out(mod, rest).alias("held_out"), sql_text().alias("text")), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text scores below 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([s < 0.5 for s in scorer([t or "" for t in batch.column(at).to_pylist()])], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
