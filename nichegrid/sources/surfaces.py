"""Embedding mosaics in, suitability surfaces out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.functions.geo import degrees_for
from nichegrid.functions.vectors import clamp_year
from nichegrid.operators.clip import AreaIndex, clip
from nichegrid.operators.grid import regrid

TILE_CELLS = 1024
NO_DATA = 0.0


def embedding_for_year(embeddings: DataFrame, year: int) -> DataFrame:
    """The mosaic of one year; on a table partitioned by year only that part is read."""
    return embeddings.where(F.col("year") == clamp_year(year))


def clip_cells(
    cells: DataFrame,
    edges: DataFrame | AreaIndex,
    step: float,
    region: str = "region",
    tile: float | None = None,
) -> DataFrame:
    """Cells whose centre lies inside a region."""
    centred = cells.withColumns(
        {
            "_x": (F.col("cx") + F.lit(0.5)) * F.lit(float(step)),
            "_y": (F.col("cy") + F.lit(0.5)) * F.lit(float(step)),
        }
    )
    return clip(centred, edges, "_x", "_y", region, tile).drop("_x", "_y")


def export_surface(
    surface: DataFrame,
    path: str,
    source_m: int,
    target_m: int,
    edges: DataFrame | None = None,
    step: float | None = None,
    fmt: str = "parquet",
) -> None:
    """Write ``cx, cy, score`` at another resolution, by tile, masked cells as no-data.

    A tile holds at most TILE_CELLS squared cells and is written by one task. ``step`` is the
    target cell size in the units of ``edges``; by default degrees for ``target_m``.
    """
    out = regrid(surface.select("cx", "cy", "score"), source_m, target_m)
    if edges is not None:
        inside = clip_cells(out, edges, step or degrees_for(target_m))
        out = inside.select("cx", "cy", "score").dropDuplicates(["cx", "cy"])  # in several regions, but one cell
    tiled = out.select(
        "cx",
        "cy",
        F.coalesce("score", F.lit(NO_DATA)).alias("score"),
        F.floor(F.col("cx") / TILE_CELLS).alias("tile_x"),
        F.floor(F.col("cy") / TILE_CELLS).alias("tile_y"),
    )
    writer = tiled.repartition("tile_x", "tile_y").write.partitionBy("tile_x", "tile_y")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)
