"""Uploaded presence files and background tables."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nichegrid.functions.geo import UPLOADS, to_wgs84, upload_coordinates
from nichegrid.sources.geojson import FEATURE_SCHEMA, read_documents

# Fixed value: the name of a species nobody named.
UNKNOWN_SPECIES = "unknown"

def presence_columns(
    species: Column | None, year: Column | None, lon: Column, lat: Column
) -> list[Column]:
    """The standard presence columns from whatever a file offered."""
    number = year.try_cast("double") if year is not None else F.lit(None).cast("double")
    return [
        (species.cast("string") if species is not None else F.lit(UNKNOWN_SPECIES)).alias("species"),
        number.try_cast("int").alias("year"),
        lon.alias("lon"),
        lat.alias("lat"),
    ]


def normalise(
    df: DataFrame, lon: str | None = None, lat: str | None = None, epsg: int | None = None
) -> DataFrame:
    """Any table with coordinates to ``species, year, lon, lat`` in EPSG:4326.

    Coordinate headers are detected unless given. A missing name is NULL, a missing name column
    is ``unknown``; a year that is not a number is NULL.
    """
    if lon is None or lat is None:
        pair = upload_coordinates(df.columns)
        if pair is None:
            raise ValueError(f"no pair of coordinate columns among {', '.join(df.columns)}")
        lon, lat = pair
    x, y = to_wgs84(
        F.col(f"`{lon}`").try_cast("double"), F.col(f"`{lat}`").try_cast("double"), epsg
    )
    species, year = (UPLOADS.best(df.columns, column) for column in ("species", "year"))
    return df.select(
        *presence_columns(
            F.col(f"`{species}`") if species else None, F.col(f"`{year}`") if year else None, x, y
        )
    )


def read_points_csv(
    spark: SparkSession, path: str, lon: str | None = None, lat: str | None = None
) -> DataFrame:
    """Delimited text. The delimiter comes from the header line, values are cast, not inferred."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"no coordinate columns: {path} is empty")
    delimiter = max(",;\t|", key=first[0].count)
    table = spark.read.option("header", "true").option("sep", delimiter).csv(path)
    return normalise(table, lon, lat)


def _properties(df: DataFrame) -> list[Column | None]:
    """The properties that serve as species and year, in the spelling that the features have."""
    accepted = [name for column in ("species", "year") for name in UPLOADS.accepted[column]]
    keys = F.filter(F.map_keys("properties"), lambda k: F.lower(k).isin(accepted))
    found = sorted(r["k"] for r in df.select(F.explode(keys).alias("k")).distinct().collect())  # a few names
    names = [UPLOADS.best(found, column) for column in ("species", "year")]
    return [F.col("properties")[name] if name else None for name in names]


def _epsg_of(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)$", 1).try_cast("int")


def reproject_rows(df: DataFrame, x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Per-row :func:`to_wgs84`; an unknown code stops the job."""
    lon, lat = to_wgs84(x, y, 3857)
    geographic = epsg.isNull() | epsg.isin(4326, 84)
    unknown = F.raise_error(F.concat(F.lit("Unsupported coordinate system EPSG:"), epsg.cast("string")))

    def choose(plain: Column, projected: Column) -> Column:
        return F.when(geographic, plain).when(epsg == 3857, projected).otherwise(unknown.cast("double"))

    return choose(x, lon), choose(y, lat)


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """GeoJSON features as ``kind, coordinates (JSON text), properties, epsg``.

    ``lines`` reads one feature per line; documents are read by ranges (:mod:`nichegrid.sources.geojson`). A
    line or a document that is not JSON stops the job.
    """
    if lines:
        rows = spark.read.schema(FEATURE_SCHEMA).option("mode", "FAILFAST").json(path)
        return rows.where("geometry is not null").select(
            F.col("geometry.type").alias("kind"),
            F.col("geometry.coordinates").alias("coordinates"),
            "properties",
            F.lit(None).cast("int").alias("epsg"),
        )
    crs = F.from_json("crs", "properties map<string,string>")["properties"]["name"]
    return read_documents(spark, path).select(
        F.col("feature.geometry.type").alias("kind"),
        F.col("feature.geometry.coordinates").alias("coordinates"),
        F.col("feature.properties").alias("properties"),
        _epsg_of(crs).alias("epsg"),
    )


def points_of_features(features: DataFrame) -> DataFrame:
    """Presence columns from point features; a feature of another kind stops the job."""
    other = F.raise_error(F.concat(F.lit("not a point feature: "), F.col("kind")))
    text = F.when(F.col("kind") == "Point", F.col("coordinates")).otherwise(other.cast("string"))
    point = F.from_json(text, "array<double>")
    placed = features.where("kind is not null").select(
        point[0].alias("x"), point[1].alias("y"), "properties", "epsg"
    )
    species, year = _properties(placed)
    lon, lat = reproject_rows(placed, F.col("x"), F.col("y"), F.col("epsg"))
    return placed.select(*presence_columns(species, year, lon, lat))


def read_points_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return points_of_features(read_features(spark, path, lines))


def read_presence_file(spark: SparkSession, path: str) -> DataFrame:
    """Presence points by file extension."""
    from nichegrid.sources.shapefiles import read_shapefile_zips

    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".zip":
        return read_shapefile_zips(spark, path)
    if suffix in (".geojson", ".json"):
        return read_points_geojson(spark, path)
    if suffix in (".csv", ".txt"):
        return read_points_csv(spark, path)
    raise ValueError(f"Unsupported kind of file {suffix!r}: points come as zipped shapefile, GeoJSON or text")


def read_background(
    spark: SparkSession, path: str, features: Sequence[str] | None = None, geometry: str = ".geo"
) -> DataFrame:
    """Background table whose geometry column holds GeoJSON written with single quotes."""
    table = spark.read.option("header", "true").option("escape", '"').csv(path)
    if geometry not in table.columns:
        raise ValueError(f"no {geometry!r} column in {path}")
    shape = F.from_json(
        F.regexp_replace(F.col(f"`{geometry}`"), "'", '"'), "type string, coordinates array<double>"
    )
    names = list(features) if features is not None else [c for c in table.columns if c != geometry]
    values = [
        F.col(f"`{c}`").try_cast("double").alias(c) if features is not None else F.col(f"`{c}`")
        for c in names
    ]
    return table.select(
        *values, shape["coordinates"][0].alias("lon"), shape["coordinates"][1].alias("lat")
    )
