"""Per-pixel terrain, vegetation and soil expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Factor from stored integers to physical units, per soil layer.
SOIL_FACTORS = {
    "soil_ph": 0.1,
    "soil_soc": 0.1,
    "soil_clay": 0.1,
    "soil_sand": 0.1,
    "soil_bdod": 0.01,
    "soil_nitrogen": 0.01,
}

TREE_HEIGHT_M = 1


def northness(aspect: Column) -> Column:
    return F.cos(F.radians(aspect))


def eastness(aspect: Column) -> Column:
    return F.sin(F.radians(aspect))


def trees(canopy_height: Column) -> Column:
    """Canopy height where it counts as a tree, masked elsewhere."""
    return F.when(canopy_height >= TREE_HEIGHT_M, canopy_height)


def on_land(value: Column, elevation: Column) -> Column:
    """Value on pixels above sea level, masked on water."""
    return F.when(elevation > 0, value)


def scale_soil(df: DataFrame, layers: Mapping[str, str] | None = None) -> DataFrame:
    """Stored soil integers to physical units, as float.

    ``layers`` maps the soil layer name to the stored column; by default every soil layer
    that ``df`` already has under its own name.
    """
    layers = layers or {name: name for name in SOIL_FACTORS if name in df.columns}
    unknown = sorted(set(layers) - set(SOIL_FACTORS))
    if unknown:
        raise ValueError(f"not a soil layer: {unknown}")
    return df.withColumns(
        {
            name: (F.col(stored) * F.lit(SOIL_FACTORS[name])).cast("float")
            for name, stored in layers.items()
        }
    )


def shift_layers(
    df: DataFrame, offsets: Mapping[str, object], layers: Sequence[str] | None = None
) -> DataFrame:
    """What-if: add an offset to each named layer of the original stack.

    A missing or unreadable offset counts as zero; names that are not in the stack are left out.
    """
    chosen = [c for c in (layers or list(offsets)) if c in df.columns]
    return df.withColumns({c: F.col(c) + F.lit(as_offset(offsets.get(c))) for c in chosen})


def as_offset(value: object) -> float:
    try:
        return float(value or 0.0)
    except (TypeError, ValueError):
        return 0.0
