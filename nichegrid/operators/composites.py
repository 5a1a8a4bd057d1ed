"""Time series of pixels to one layer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichegrid.functions import spectral
from nichegrid.operators.joins import BROADCAST_ROWS, has_at_most, lookup_join
from nichegrid.operators.ordering import group_median

CELL = ("cx", "cy")

# Scene season (half-open, month-day) and cloud limit of the scrub indices.
SEASON_START, SEASON_END = "09-01", "11-01"
MAX_CLOUD_PCT = 65
TRAILING_DAYS = 4
SNOWFALL_FACTOR = 1000


def annual_mean(
    df: DataFrame, values: Sequence[str], ts: str = "ts", keys: Sequence[str] = CELL
) -> DataFrame:
    """Mean per cell and calendar year, all years in one pass."""
    return df.groupBy(*keys, F.year(ts).cast("long").alias("yr")).agg(
        *[F.avg(v).alias(v) for v in values]
    )


def mosaic(
    df: DataFrame,
    values: Sequence[str],
    order: Sequence[str] = ("ts",),
    keys: Sequence[str] = CELL,
    on_top: str = "last",
) -> DataFrame:
    """The last (or first) unmasked value of each band in scene order."""
    if on_top not in ("last", "first"):
        raise ValueError("on_top is 'last' or 'first'")
    pick = F.max_by if on_top == "last" else F.min_by
    # a single column combines in the hash aggregate, several need the sort-based one
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return df.groupBy(*keys).agg(
        *[
            pick(v, F.when(F.col(v).isNotNull(), position)).alias(v)
            for v in values
        ]
    )


def between(ts: Column, start: str, end: str) -> Column:
    """Half-open date range; compares the bare column, so it reaches the scan."""
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))


_INDICES = {
    "nari": (spectral.nari, ("b3", "b5")),
    "ncri": (spectral.ncri, ("b5", "b7")),
}


def index_median(scenes: DataFrame, index: str, year: int, keys: Sequence[str] = CELL) -> DataFrame:
    """Median NARI or NCRI over the clear pixels of one season."""
    return index_medians(scenes, index, [year], keys).drop("yr")


def index_medians(
    scenes: DataFrame, index: str, years: Sequence[int], keys: Sequence[str] = CELL
) -> DataFrame:
    """:func:`index_median` for several years in one pass, with the year as ``yr``."""
    if index not in _INDICES:
        raise ValueError(f"unknown index {index!r}; expected one of {sorted(_INDICES)}")
    formula, bands = _INDICES[index]
    seasons = [between(F.col("ts"), f"{y}-{SEASON_START}", f"{y}-{SEASON_END}") for y in sorted(set(years))]
    chosen = scenes.where(reduce(or_, seasons) & (F.col("cloudy_pct") < MAX_CLOUD_PCT)).select(
        *keys, F.year("ts").cast("long").alias("yr"), "qa60", *bands
    )
    pixels = spectral.mask_clouds(chosen, bands).select(
        *keys, "yr", formula(*[F.col(b) for b in bands]).alias(index)
    )
    return group_median(pixels, index, [*keys, "yr"], index)


def ndvi_mean(scenes: DataFrame, year: int, nir: str, red: str, keys: Sequence[str] = CELL) -> DataFrame:
    """Mean NDVI over the clear pixels of a calendar year."""
    chosen = scenes.where(
        between(F.col("ts"), f"{year}-01-01", f"{year + 1}-01-01")
        & (F.col("cloudy_pct") < MAX_CLOUD_PCT)
    )
    return (
        spectral.mask_clouds(chosen, [nir, red])
        .groupBy(*keys)
        .agg(F.avg(spectral.ndvi(F.col(nir), F.col(red))).alias("ndvi"))
        .where("ndvi is not null")
    )


def _daily(climate: DataFrame, value: str, how, keys: Sequence[str]) -> DataFrame:
    return climate.groupBy(*keys, "d").agg(how(value).alias(value))


def _trailing(
    points: DataFrame, climate: DataFrame, value: str, how, name: str, keys: Sequence[str]
) -> DataFrame:
    """Aggregate of the days [d - 4, d) at each point's cell and date.

    The distinct (cell, date) requests are spread over the four days they need and joined by
    equality; repeated points are attached afterwards.
    """
    wanted = points.select(*keys, "d").dropna().distinct()
    asked = wanted.withColumnRenamed("d", "_asked").withColumn(
        "d",
        F.explode(
            F.sequence(F.date_sub("_asked", TRAILING_DAYS), F.date_sub("_asked", 1))
        ),
    )
    few = has_at_most(wanted, BROADCAST_ROWS // TRAILING_DAYS)
    # only days that somebody asks for are added up
    days = asked.select(*keys, "d").distinct()
    needed = climate.join(F.broadcast(days) if few else days, [*keys, "d"], "left_semi")
    daily = _daily(needed, value, how, keys)
    hits = daily.join(F.broadcast(asked) if few else asked, [*keys, "d"])
    result = (
        hits.groupBy(*keys, F.col("_asked").alias("d")).agg(how(value).alias(name)).dropna(subset=[name])
    )
    if few:  # no more rows than the counted requests
        return points.join(F.broadcast(result), [*keys, "d"])
    return lookup_join(points, result, [*keys, "d"])


def snowfall_4d(points: DataFrame, climate: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Snowfall of the four days before each point's date, in thousandths."""
    out = _trailing(points, climate, "snowfall_sum", F.sum, "snowfall", keys)
    return out.withColumn("snowfall", F.col("snowfall") * SNOWFALL_FACTOR)


def snowcover_4d(points: DataFrame, climate: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Mean snow cover of the four days before each point's date."""
    return _trailing(points, climate, "snow_cover", F.avg, "snowcover", keys)
