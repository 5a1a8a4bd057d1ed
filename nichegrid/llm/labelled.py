"""What the two classifiers share: folds, a bounded sample of labelled rows, and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.llm.tables import fold

FOLDS = 5
#: labelled rows a classifier is fitted on, those with the smallest hash of their id; a documented bound
FITTED_ROWS = 5_000


def held_out():
    """Whether a row is kept from fitting: crc32 of the id as text, modulo FOLDS, is 0."""
    return fold("doc_id", FOLDS) == 0


def sample(documents: DataFrame, labels: DataFrame, label: str, rows: int = FITTED_ROWS) -> DataFrame:
    """doc_id, text, label (0 or 1) of at most ``rows`` labelled documents outside the held-out fold.

    Labels that are null, contradict each other or have no id are left out. The labels are cut to the
    bound first and are therefore safe to broadcast; of equal texts among them the first id stays, so
    that copies do not pass for evidence.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("_high"))
        .where("label = _high")
        .orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
        .limit(rows)
        .select("doc_id", F.col("label").cast("int").alias("label"))
    )
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    taken = texts.join(F.broadcast(known), "doc_id")
    first = F.min(F.struct("doc_id", "label")).alias("first")
    return taken.groupBy("text").agg(first).select("first.doc_id", "text", "first.label")


def scored(documents: DataFrame, score: Callable[[Any], np.ndarray], cutoff: float) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; null counts as the empty text.

    ``score`` turns a list of texts (bytes) into an array of numbers from 0 to 1.
    """

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(score([x or b"" for x in batch.to_pylist()]), pa.float64())

    return documents.select(
        "doc_id", held_out().alias("held_out"), run(F.col("text").cast("binary")).alias("score")
    ).withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to labels, by Newton's method."""
    # targets a little inside 0 and 1, as for few examples of a class
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = logistic(x @ beta)
        slopes = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(slopes, x.T @ (target - p) - 1e-6 * beta), -2, 2)
    return float(max(beta[0], 0.0)), float(beta[1])
