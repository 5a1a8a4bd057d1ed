"""Folders of zipped point shapefiles."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from nichegrid.sources.files import points_of_features

# Fixed values of the public shapefile layout: header length and point record types.
_HEADER_BYTES = 100
_POINT_TYPES = (1, 11, 21)
_ROWS_PER_BATCH = 20_000

_FEATURES = "kind string, coordinates string, properties map<string,string>, epsg int"


def _points(shp: bytes) -> np.ndarray:
    """x, y per record; NaN where the shape is empty."""
    out, at = [], _HEADER_BYTES
    while at + 8 <= len(shp):
        words = int.from_bytes(shp[at + 4 : at + 8], "big")
        body = shp[at + 8 : at + 8 + 2 * words]
        kind = int.from_bytes(body[:4], "little")
        if kind in _POINT_TYPES:
            out.append(np.frombuffer(body, "<f8", 2, 4))
        elif kind == 0:
            out.append(np.array([np.nan, np.nan]))
        else:
            raise ValueError(f"Unsupported shape type {kind}: only points are read")
        at += 8 + 2 * words
    return np.array(out).reshape(-1, 2)


def _attributes(dbf: bytes) -> pd.DataFrame:
    rows = int.from_bytes(dbf[4:8], "little")
    head = int.from_bytes(dbf[8:10], "little")
    width = int.from_bytes(dbf[10:12], "little")
    fields = []
    at = 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), dbf[at + 16]))
        at += 32
    cells = np.frombuffer(dbf, np.uint8, rows * width, head).reshape(rows, width)
    columns, start = {}, 1
    for name, length in fields:
        raw = np.ascontiguousarray(cells[:, start : start + length]).view(f"S{length}").ravel()
        text = pd.Series([v.decode("utf-8", "replace").strip() for v in raw], dtype=object)
        columns[name] = text.where(text != "", None)
        start += length
    frame = pd.DataFrame(columns, index=range(rows))
    frame["_deleted"] = cells[:, 0] == ord("*") if rows else []
    return frame


def _member(archive: zipfile.ZipFile, stem: str, suffix: str) -> bytes | None:
    for name in archive.namelist():
        if name.lower() == stem.lower() + suffix:
            return archive.read(name)
    return None


def _epsg(prj: bytes | None) -> int | None:
    text = (prj or b"").decode("utf-8", "replace")
    if not text or text.startswith("GEOGCS"):
        return None
    if "Pseudo-Mercator" in text or "Web_Mercator" in text:
        return 3857
    raise ValueError("Unsupported coordinate system in .prj")


def decode_bundle(content: bytes) -> pd.DataFrame:
    """One zipped shapefile as feature rows."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    shapes = sorted(n for n in archive.namelist() if n.lower().endswith(".shp"))
    if not shapes:
        raise ValueError("ZIP archive contains no .shp file; include .shp, .shx and .dbf")
    stem = shapes[0][:-4]
    xy = _points(archive.read(shapes[0]))
    dbf = _member(archive, stem, ".dbf")
    table = _attributes(dbf) if dbf else pd.DataFrame({"_deleted": [False] * len(xy)})
    keep = ~(np.isnan(xy[:, 0]) | table["_deleted"].to_numpy(bool))
    names = [c for c in table.columns if c != "_deleted"]
    return pd.DataFrame(
        {
            "kind": "Point",
            "coordinates": [f"[{x!r},{y!r}]" for x, y in xy[keep].tolist()],
            "properties": [dict(zip(names, r)) for r in table.loc[keep, names].itertuples(index=False)],
            "epsg": pd.array([_epsg(_member(archive, stem, ".prj"))] * int(keep.sum()), "Int32"),
        }
    )


def decode_bundles(bundles: DataFrame) -> DataFrame:
    """Point presences of a table with the bundles' bytes in ``content``; one task per bundle."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                features = decode_bundle(bytes(content))
                for start in range(0, len(features), _ROWS_PER_BATCH):
                    yield features.iloc[start : start + _ROWS_PER_BATCH]

    return points_of_features(bundles.select("content").mapInPandas(decode, _FEATURES))


def read_shapefile_zips(spark: SparkSession, path: str) -> DataFrame:
    return decode_bundles(spark.read.format("binaryFile").load(path))
