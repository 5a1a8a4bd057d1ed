"""All predictor layers of an area, from the tables they are made of.

Every source is brought to long form ``(cell, layer, value)`` and the layers are put side by side
in one grouping, however many there are. Names are those of the layer catalogue.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.functions import surface
from nichegrid.functions.surface import SOIL_FACTORS
from nichegrid.operators import composites
from nichegrid.operators.grid import custom_layer, stack_layers, terrain

CELL = ("cx", "cy")

# Layer name of each column of the climate series.
CLIMATE_LAYERS = {
    "snow_depth_water_equivalent": "SWE",
    "snow_depth": "snow_depth",
    "snow_cover": "snow_cover",
    "snow_albedo": "snow_albedo",
}


def _long(df: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    values = df.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    return values.unpivot(list(keys), list(names), "layer", "value")


def _stacked(parts: Sequence[DataFrame], names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    if not parts:
        raise ValueError("no layer source given")
    return stack_layers(reduce(DataFrame.unionByName, parts), names, keys)


def static_layers(
    dem: DataFrame | None = None,
    canopy: DataFrame | None = None,
    soil: DataFrame | None = None,
    rasters: Mapping[str, DataFrame] | None = None,
    spacing: float = 1.0,
    canopy_order: Sequence[str] = ("ts",),
) -> DataFrame:
    """Layers that do not change with the year, a column each.

    ``dem`` (``cx, cy, elevation``) gives elevation, slope, aspect, northness and eastness;
    ``canopy`` (``cx, cy, height`` and the tile order) the topmost height as CHM and Trees; ``soil``
    (stored integers under the soil layer names) the soil layers; ``rasters`` any other
    single-band table by layer name, such as land cover, human impact or bioclimatic variables.
    """
    parts, names = [], []

    def add(df: DataFrame, layers: Sequence[str]) -> None:
        parts.append(_long(df, layers, CELL))
        names.extend(layers)

    if dem is not None:
        add(dem, ["elevation"])
        slopes = terrain(dem, spacing=spacing).withColumns(
            {"northness": surface.northness(F.col("aspect")), "eastness": surface.eastness(F.col("aspect"))}
        )
        add(slopes, ["slope", "aspect", "northness", "eastness"])
    if canopy is not None:
        top = composites.mosaic(canopy, ["height"], canopy_order).withColumnRenamed("height", "CHM")
        add(top.withColumn("Trees", surface.trees(F.col("CHM"))), ["CHM", "Trees"])
    if soil is not None:
        add(surface.scale_soil(soil), [n for n in SOIL_FACTORS if n in soil.columns])
    for name, raster in (rasters or {}).items():
        add(custom_layer(raster, None, name), [name])
    return _stacked(parts, names, CELL)


def yearly_layers(
    years: Sequence[int],
    climate: DataFrame | None = None,
    greenness: DataFrame | None = None,
    scenes: DataFrame | None = None,
) -> DataFrame:
    """Layers of every requested year at once, keyed by ``cx, cy, yr``.

    ``climate`` (``ts`` and the climate columns) gives annual means, ``greenness``
    (``ts, cx, cy, NDVI``) the mean NDVI, ``scenes`` the median NARI and NCRI.
    """
    keys = (*CELL, "yr")
    first, last = min(years), max(years)
    wanted = F.col("yr").isin(list(years))

    def annual(df: DataFrame, values: Sequence[str]) -> DataFrame:
        seen = df.where(composites.between(F.col("ts"), f"{first}-01-01", f"{last + 1}-01-01"))
        return composites.annual_mean(seen, values).where(wanted)

    parts, names = [], []
    if climate is not None:
        columns = {c: n for c, n in CLIMATE_LAYERS.items() if c in climate.columns}
        means = annual(climate, list(columns)).withColumnsRenamed(columns)
        parts.append(_long(means, list(columns.values()), keys))
        names.extend(columns.values())
    if greenness is not None:
        parts.append(_long(annual(greenness, ["NDVI"]), ["NDVI"], keys))
        names.append("NDVI")
    if scenes is not None:
        for index in ("nari", "ncri"):
            medians = composites.index_medians(scenes, index, years).withColumnRenamed(index, index.upper())
            parts.append(_long(medians, [index.upper()], keys))
            names.append(index.upper())
    return _stacked(parts, names, keys)
