"""Administrative boundaries and the choice of an area."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichegrid.operators.clip import rings_to_edges
from nichegrid.sources.files import read_features

COUNTRY_LEVEL, COUNTY_LEVEL = 0, 2


def read_boundaries(spark: SparkSession, path: str, level: int, lines: bool = False) -> DataFrame:
    """Boundary polygons as ``level, cntr_code, nuts_name, rings``."""
    return boundaries_of_features(read_features(spark, path, lines), level)


def boundaries_of_features(features: DataFrame, level: int) -> DataFrame:
    single = F.from_json("coordinates", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("coordinates", "array<array<array<array<double>>>>"))
    # a boundary of any other kind is a wrong file, not an empty region
    other = F.raise_error(F.concat(F.lit("not a polygon feature: "), F.col("kind"))).cast(
        "array<array<array<double>>>"
    )
    rings = F.when(F.col("kind") == "Polygon", single).when(F.col("kind") == "MultiPolygon", multi).otherwise(other)
    corner = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    return features.where("kind is not null").select(
        F.lit(level).alias("level"),
        F.col("properties")["CNTR_CODE"].alias("cntr_code"),
        F.col("properties")["NUTS_NAME"].alias("nuts_name"),
        F.transform(rings, lambda ring: F.transform(ring, corner)).alias("rings"),
    ).where("rings is not null")


def boundary_edges(boundaries: DataFrame) -> DataFrame:
    return rings_to_edges(boundaries, "rings", ("level", "cntr_code", "nuts_name"))


def region_options(boundaries: DataFrame, country_code: str) -> DataFrame:
    """County names of a country."""
    return (
        boundaries.where(F.col("cntr_code") == country_code)
        .select("nuts_name")
        .distinct()
        .orderBy("nuts_name")
    )


def select_area(
    countries: DataFrame, counties: DataFrame, country_code: str, county_name: str | None = None
) -> DataFrame:
    """Boundary rows of the county when one is named, else of the country.

    An unknown code or name is an error rather than an empty area.
    """
    if county_name:
        chosen, what = counties.where(F.col("nuts_name") == county_name), f"county {county_name!r}"
    else:
        chosen, what = countries.where(F.col("cntr_code") == country_code), f"country {country_code!r}"
    if chosen.isEmpty():
        raise ValueError(f"unknown {what}")
    return chosen
