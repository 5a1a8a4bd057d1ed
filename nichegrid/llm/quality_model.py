"""A quality classifier: naive Bayes log-count ratios under a linear support vector machine.

A text's features are indicators of n-grams, hashed: runs of one and two words (lower case), runs of
three bytes as they stand, and a run of equal words. Each indicator is scaled by the log ratio of
its smoothed counts in the two classes; a hinge-loss model is then fitted to the scaled features by
dual coordinate descent, one example at a time in a random order, with the bias as one more feature.
The two classes weigh the same. Margins on folds of the sample that a model has not seen give the
logistic curve that turns margins into scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.llm import labelled, wordhash

WORD_BITS, BYTE_BITS = 17, 15
SIZE = (1 << WORD_BITS) + (1 << BYTE_BITS) + 4
CUTOFF = 0.3


def features(texts: Sequence[bytes]) -> Iterator[np.ndarray]:
    """The sorted numbers of the n-grams that each text holds."""
    seen = np.zeros(SIZE, bool)
    for first, last, hashes, bounds in wordhash.words_of_all(texts):
        one = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        pair = wordhash.mixed(hashes[:-1] * np.uint64(3) + hashes[1:]) >> np.uint64(64 - WORD_BITS)
        pair = pair.astype(np.int64)
        equal = hashes[:-1] == hashes[1:]
        for i in range(first, last):
            a, b = int(bounds[i - first]), int(bounds[i - first + 1])
            parts = [one[a:b], pair[a : max(b - 1, a)]]
            raw = np.frombuffer(texts[i], np.uint8).astype(np.uint32)
            runs = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
            runs = (runs * np.uint32(2654435761)) >> np.uint32(32 - BYTE_BITS)
            parts.append((1 << WORD_BITS) + runs.astype(np.int64))
            same = int(np.count_nonzero(equal[a : max(b - 1, a)]))
            # texts without words, and those where one, a tenth or a half of the words repeat the one before
            flags = [b == a, same > 0, same * 10 > b - a, same * 2 > b - a]
            parts.append(SIZE - 4 + np.flatnonzero(flags))
            for part in parts:
                seen[part] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # already scaled by the ratios
    bias: float
    slope: float
    shift: float

    def margins(self, texts: Sequence[bytes]) -> np.ndarray:
        return np.array([self.weights[own].sum() / math.sqrt(max(len(own), 1)) + self.bias for own in features(texts)])

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        return labelled.logistic(self.slope * self.margins(texts) + self.shift)


def ratios(rows: Sequence[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log((share of good rows with the n-gram) / (share of bad rows with it)), smoothed by one."""
    counts = [
        1 + np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, y in zip(rows, labels, strict=True) if y == k)]), minlength=SIZE)
        for k in (0, 1)
    ]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(
    rows: Sequence[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 8
) -> tuple[np.ndarray, float]:
    """Weights (scaled by ``scale``) and bias of the hinge-loss model, by dual coordinate descent."""
    sign = np.where(labels == 1, 1.0, -1.0)
    upper = cost * np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    weights, bias = np.zeros(SIZE), 0.0
    alpha = np.zeros(len(rows))
    norm = [1 / math.sqrt(max(len(r), 1)) for r in rows]
    values = [scale[r] * n for r, n in zip(rows, norm, strict=True)]
    square = [float(v @ v) + 1.0 for v in values]
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            own, value = rows[i], values[i]
            gradient = sign[i] * (weights[own] @ value + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                weights[own] += step * value
                bias += step
    return weights * scale, bias


def train(rows: Sequence[np.ndarray], labels: np.ndarray, folds: int = 3) -> Model:
    """The model of sampled feature rows; without both labels every text scores the same prior."""
    labels = np.asarray(labels, np.int64)
    if not 0 < labels.sum() < len(labels):
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(SIZE), 0.0, 0.0, float(np.log(share / (1 - share))))
    margins = np.zeros(len(rows))
    fold = np.arange(len(rows)) % folds
    for k in range(folds):
        seen = np.flatnonzero(fold != k)
        if not 0 < labels[seen].sum() < len(seen):
            continue
        own = [rows[i] for i in seen]
        weights, bias = descend(own, labels[seen], ratios(own, labels[seen]), epochs=4)
        for i in np.flatnonzero(fold == k):
            margins[i] = weights[rows[i]].sum() / math.sqrt(max(len(rows[i]), 1)) + bias
    slope, shift = labelled.curve(margins, labels)
    weights, bias = descend(rows, labels, ratios(rows, labels))
    return Model(weights.astype(np.float32), bias, slope, shift)


def fit(documents: DataFrame, labels: DataFrame, rows: int = labelled.FITTED_ROWS) -> Model:
    """Fitted on the bounded sample: its n-gram numbers come to the driver, some 6 kB a row."""

    @F.arrow_udf("binary")
    def numbers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([f.astype("<i4").tobytes() for f in features(batch.to_pylist())], pa.binary())

    taken = labelled.sample(documents, labels, "quality", rows)
    got = taken.select("doc_id", "label", numbers("text").alias("own")).orderBy("doc_id", "own").collect()
    return train([np.frombuffer(r["own"], "<i4") for r in got], np.array([r["label"] for r in got], np.int64))


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score of at least CUTOFF) for every row.

    Null and empty texts have no n-grams and score what such texts deserve. Repeated rows score alike.
    """
    model = fit(documents, labels)
    return labelled.scored(documents, model.scores, CUTOFF)
