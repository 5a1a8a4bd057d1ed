"""Satellite band arithmetic. A masked pixel is NULL and a division by zero masks too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quality-band bits for cloud and cirrus, and the reflectance scale.
CLOUD_BIT = 10
CIRRUS_BIT = 11
REFLECTANCE_SCALE = 10000.0


def is_clear(qa: Column) -> Column:
    """Neither the cloud nor the cirrus bit is set."""
    flags = (1 << CLOUD_BIT) | (1 << CIRRUS_BIT)
    return qa.bitwiseAND(F.lit(flags).cast("long")) == 0


def mask_clouds(df: DataFrame, bands: Sequence[str], qa: str = "qa60") -> DataFrame:
    """Bands as reflectance where the pixel is clear, NULL elsewhere."""
    clear = is_clear(F.col(qa))
    return df.withColumns(
        {b: F.when(clear, F.col(b) / F.lit(REFLECTANCE_SCALE)) for b in bands}
    )


def inverse_difference(first: Column, second: Column) -> Column:
    """``(1/first - 1/second) / (1/first + 1/second)``."""
    one = F.lit(1.0)
    a, b = F.try_divide(one, first), F.try_divide(one, second)
    return F.try_divide(a - b, a + b)


def nari(green: Column, red_edge_1: Column) -> Column:
    """Normalised anthocyanin reflectance index."""
    return inverse_difference(green, red_edge_1)


def ncri(red_edge_1: Column, red_edge_3: Column) -> Column:
    """Normalised chlorophyll reflectance index."""
    return inverse_difference(red_edge_1, red_edge_3)


def ndvi(near_infrared: Column, red: Column) -> Column:
    """Normalised difference vegetation index."""
    return F.try_divide(near_infrared - red, near_infrared + red)
