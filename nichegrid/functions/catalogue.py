"""The built-in predictor layers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layer:
    name: str
    category: str
    units: str
    source: str
    about: str
    temporal: bool = False


# Layer names, categories in display order, units and data products.
CATEGORIES = (
    "Terrain",
    "Vegetation",
    "Climate",
    "Land Cover & Human Impact",
    "BioClim",
    "Soil Properties",
)

_SRTM = "USGS SRTMGL1"
_ERA5 = "ERA5-Land Hourly"
_CANOPY = "Meta Canopy Height"
_SOIL = "SoilGrids 250m v2 (ISRIC)"
_WORLDCLIM = "WorldClim BioClim"

# The nineteen public bioclimatic variables, b1 to b19.
_BIOCLIM = (
    ("Annual Mean Temperature", "°C × 10"),
    ("Mean Diurnal Range", "°C × 10"),
    ("Isothermality", "%"),
    ("Temperature Seasonality", "°C × 100"),
    ("Max Temperature of Warmest Month", "°C × 10"),
    ("Min Temperature of Coldest Month", "°C × 10"),
    ("Temperature Annual Range", "°C × 10"),
    ("Mean Temperature of Wettest Quarter", "°C × 10"),
    ("Mean Temperature of Driest Quarter", "°C × 10"),
    ("Mean Temperature of Warmest Quarter", "°C × 10"),
    ("Mean Temperature of Coldest Quarter", "°C × 10"),
    ("Annual Precipitation", "mm"),
    ("Precipitation of Wettest Month", "mm"),
    ("Precipitation of Driest Month", "mm"),
    ("Precipitation Seasonality", "CV"),
    ("Precipitation of Wettest Quarter", "mm"),
    ("Precipitation of Driest Quarter", "mm"),
    ("Precipitation of Warmest Quarter", "mm"),
    ("Precipitation of Coldest Quarter", "mm"),
)

LAYERS: tuple[Layer, ...] = (
    Layer("elevation", "Terrain", "m", _SRTM, "height above the sea"),
    Layer("slope", "Terrain", "°", _SRTM, "steepness of the ground"),
    Layer("aspect", "Terrain", "°", _SRTM, "compass direction the slope faces"),
    Layer("northness", "Terrain", "−1–1", _SRTM, "how far the slope faces north"),
    Layer("eastness", "Terrain", "−1–1", _SRTM, "how far the slope faces east"),
    Layer("NDVI", "Vegetation", "−1–1", "Landsat 8 8-day composite", "greenness", True),
    Layer("NARI", "Vegetation", "index", "Sentinel-2", "anthocyanin index", True),
    Layer("NCRI", "Vegetation", "index", "Sentinel-2", "chlorophyll index", True),
    Layer("Trees", "Vegetation", "m", _CANOPY, "canopy height of trees only"),
    Layer("CHM", "Vegetation", "m", _CANOPY, "canopy height of all vegetation"),
    Layer("SWE", "Climate", "m", _ERA5, "water held in the snow pack", True),
    Layer("snow_depth", "Climate", "m", _ERA5, "depth of lying snow", True),
    Layer("snow_cover", "Climate", "0–1", _ERA5, "share of the cell under snow", True),
    Layer("snow_albedo", "Climate", "0–1", _ERA5, "brightness of the snow", True),
    Layer("landcover", CATEGORIES[3], "class code", "Copernicus Corine V20 100m 2018", "land use"),
    Layer("GHMI", CATEGORIES[3], "0–1", "GHM 2022 300m", "human pressure"),
    *(
        Layer(f"b{i}", "BioClim", units, _WORLDCLIM, about)
        for i, (about, units) in enumerate(_BIOCLIM, start=1)
    ),
    Layer("soil_ph", "Soil Properties", "pH", _SOIL, "acidity in water"),
    Layer("soil_soc", "Soil Properties", "g/kg", _SOIL, "organic carbon"),
    Layer("soil_clay", "Soil Properties", "g/kg", _SOIL, "clay share"),
    Layer("soil_sand", "Soil Properties", "g/kg", _SOIL, "sand share"),
    Layer("soil_bdod", "Soil Properties", "g/cm³", _SOIL, "bulk density"),
    Layer("soil_nitrogen", "Soil Properties", "g/kg", _SOIL, "total nitrogen"),
)

TEMPORAL_LAYERS = frozenset(layer.name for layer in LAYERS if layer.temporal)


def split_temporal(selected: list[str]) -> tuple[list[str], list[str]]:
    """(temporal, static) parts of a selection; custom layers are static."""
    temporal = [name for name in selected if name in TEMPORAL_LAYERS]
    return temporal, [name for name in selected if name not in TEMPORAL_LAYERS]


def layer_table(spark: SparkSession) -> DataFrame:
    """The catalogue as a 41-row dimension; always small enough to broadcast."""
    rows = [
        (i, x.name, CATEGORIES.index(x.category), x.category, x.units, x.source, x.about, x.temporal)
        for i, x in enumerate(LAYERS)
    ]
    return spark.createDataFrame(
        rows,
        "position int, layer string, category_position int, category string, units string, "
        "source string, about string, temporal boolean",
    )


def layers_by_category(long_layers: DataFrame, layer: str = "layer") -> DataFrame:
    """Catalogue grouped by category in display order, for the layers present in a long table.

    Layers are counted first (a row per name), so the lists are bounded by the catalogue.
    """
    present = long_layers.groupBy(layer).agg(F.count("*").alias("pixels"))
    table = layer_table(long_layers.sparkSession).withColumnRenamed("layer", layer)
    entry = F.struct("position", layer)
    return (
        present.join(F.broadcast(table), layer)
        .groupBy("category_position", "category")
        .agg(
            F.concat_ws(",", F.transform(F.sort_array(F.collect_list(entry)), lambda e: e[layer]))
            .alias("layers"),
            F.sum(F.col("temporal").cast("long")).alias("n_temporal"),
            F.sum("pixels").alias("pixels"),
        )
    )
