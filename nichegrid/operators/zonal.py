"""Summaries of a surface over regions and points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichegrid.operators.ordering import exact_quantile

THRESHOLD_QUANTILE = 0.1


def observation_years(points: DataFrame, year: str = "yr") -> DataFrame:
    """Distinct years that occur, ascending."""
    return points.select(year).dropna().distinct().orderBy(year)


def bounds(points: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Extent and centre of the points."""
    box = points.agg(
        F.min(x).alias("west"), F.max(x).alias("east"), F.min(y).alias("south"), F.max(y).alias("north")
    )
    return box.withColumns(
        {
            "center_x": (F.col("west") + F.col("east")) / 2,
            "center_y": (F.col("south") + F.col("north")) / 2,
        }
    )


def suitability_threshold(
    scored_presences: DataFrame, score: str = "score", q: float = THRESHOLD_QUANTILE
) -> DataFrame:
    """Score below which only a tenth of the presences lies."""
    return exact_quantile(scored_presences, score, q, name="threshold")


def suitable_share(
    surface: DataFrame, threshold: float | Column, by: Sequence[str] = (), score: str = "score",
    weight: Column | None = None,
) -> DataFrame:
    """Share of the area at or above the threshold; ``weight`` may hold cos(latitude)."""
    hit = (F.col(score) >= threshold).cast("double")
    share = F.avg(hit) if weight is None else F.try_divide(
        F.sum(hit * weight), F.sum(F.when(hit.isNotNull(), weight))
    )
    return surface.groupBy(*by).agg(share.alias("suitable_share"))


def zonal_mean_where(
    surface: DataFrame, value: str, threshold: float | Column, by: Sequence[str] = (), score: str = "score"
) -> DataFrame:
    """Mean of a layer over the suitable cells of each region."""
    return surface.groupBy(*by).agg(
        F.avg(F.when(F.col(score) >= threshold, F.col(value))).alias(f"mean_{value}")
    )


def zonal_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact median of a layer per region; regions may be of any size."""
    return exact_quantile(df, value, 0.5, by, f"median_{value}")
