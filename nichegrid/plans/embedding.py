"""Suitability as similarity to the mean embedding of the presences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.functions.vectors import batch_similarity, mean_vector


def score_by_similarity(
    pixels: DataFrame, presence_pixels: DataFrame, vector: str = "embedding", cosine: bool = False
) -> DataFrame:
    """Adds ``score`` to every pixel, its similarity to the mean of the presences."""
    return score_against(pixels, mean_of(presence_pixels, vector), vector, cosine)


def mean_of(presence_pixels: DataFrame, vector: str = "embedding") -> list[float]:
    """The mean embedding of the presences: one row of as many numbers as there are bands."""
    mean = mean_vector(presence_pixels, vector).first()["mean"]
    if not mean:
        raise ValueError("no presence has an embedding")
    return mean


def score_against(
    pixels: DataFrame, mean: Sequence[float], vector: str = "embedding", cosine: bool = False
) -> DataFrame:
    """Adds ``score``, the similarity to ``mean``; the numbers go out with the function, pixels are only scanned."""
    return pixels.withColumn("score", batch_similarity(F.col(vector), mean, cosine))


def evaluation_rows(
    presences: DataFrame, background: DataFrame, score: str = "score", keep: Sequence[str] = ()
) -> DataFrame:
    """Scored presences and background with their label."""
    return (
        presences.select(*keep, score, F.lit(1).alias("PresAbs"))
        .unionByName(background.select(*keep, score, F.lit(0).alias("PresAbs")))
        .where(F.col(score).isNotNull())
    )
