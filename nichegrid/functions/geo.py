"""Cells, coordinate systems and coordinate columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grid resolutions a model run may choose, in metres.
RESOLUTIONS_M = (10, 30, 100, 300, 1000)

# Sphere of the web-mercator projection and metres per degree along a meridian.
EARTH_RADIUS_M = 6378137.0
METRES_PER_DEGREE = math.pi * EARTH_RADIUS_M / 180.0

# Accepted headers per column, in order of preference. Uploads take longitude and
# latitude from the same place in their lists and ignore case; archives respect case.
UPLOAD_HEADERS = {
    "lon": ("x", "lon", "longitude", "decimallongitude"),
    "lat": ("y", "lat", "latitude", "decimallatitude"),
    "species": ("species", "name", "taxon"),
    "year": ("year", "date"),
}
ARCHIVE_HEADERS = {
    "lon": ("decimalLongitude", "lon", "longitude", "x"),
    "lat": ("decimalLatitude", "lat", "latitude", "y"),
}


def degrees_for(resolution_m: int) -> float:
    """Cell size in degrees for an allowed resolution."""
    if resolution_m not in RESOLUTIONS_M:
        raise ValueError(f"resolution must be one of {RESOLUTIONS_M}, got {resolution_m}")
    return resolution_m / METRES_PER_DEGREE


def cell_index(coordinate: Column, step: float) -> Column:
    """Index of the cell that holds a coordinate: ``floor(coordinate / step)``."""
    return F.floor(coordinate / F.lit(float(step))).cast("long")


@dataclass(frozen=True)
class Headers:
    """Which header of a table serves a column, by a list of accepted names per column."""

    accepted: Mapping[str, Sequence[str]]
    any_case: bool

    def places(self, columns: Sequence[str], column: str) -> dict[int, str]:
        """Header of the table for each place in the column's list of names."""
        fold = str.lower if self.any_case else str
        rank = {fold(name): place for place, name in enumerate(self.accepted[column])}
        return {rank[fold(c)]: c for c in columns if fold(c) in rank}

    def best(self, columns: Sequence[str], column: str) -> str | None:
        held = self.places(columns, column)
        return held[min(held)] if held else None

    def together(self, columns: Sequence[str], *wanted: str) -> tuple[str, ...] | None:
        """The headers of several columns from the first place that all of them have."""
        held = [self.places(columns, column) for column in wanted]
        common = set(held[0]).intersection(*held[1:])
        return tuple(h[min(common)] for h in held) if common else None


UPLOADS = Headers(UPLOAD_HEADERS, any_case=True)
ARCHIVES = Headers(ARCHIVE_HEADERS, any_case=False)


def upload_coordinates(columns: Sequence[str]) -> tuple[str, ...] | None:
    """(lon, lat) headers of an uploaded table: a pair that belongs together, any case."""
    return UPLOADS.together(columns, "lon", "lat")


def archive_coordinates(columns: Sequence[str]) -> tuple[str, str]:
    """(lon, lat) headers of a downloaded archive: each axis by itself, exact case."""
    lon, lat = (ARCHIVES.best(columns, axis) for axis in ("lon", "lat"))
    if lon is None or lat is None:
        missing = "longitude" if lon is None else "latitude"
        raise ValueError(f"the archive has no coordinate column for the {missing}")
    return lon, lat


def to_wgs84(x: Column, y: Column, epsg: int | None) -> tuple[Column, Column]:
    """Longitude and latitude in EPSG:4326; a missing code means 4326 already."""
    if epsg in (None, 4326):
        return x, y
    if epsg == 3857:
        lon = F.degrees(x / F.lit(EARTH_RADIUS_M))
        lat = F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(EARTH_RADIUS_M))) - F.lit(math.pi / 2))
        return lon, lat
    raise ValueError(f"Unsupported coordinate system EPSG:{epsg}")


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3857 metres from longitude and latitude."""
    x = F.radians(lon) * F.lit(EARTH_RADIUS_M)
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / F.lit(2.0))) * F.lit(EARTH_RADIUS_M)
    return x, y
