"""Raster tables: the cells of an extent, resampling, neighbourhoods and layer stacks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE_CELLS = 256


def cells_of_extent(df: DataFrame, cx: str = "cx", cy: str = "cy") -> DataFrame:
    """Every cell of the bounding box of ``df``: rows first, spread out, then columns."""
    box = df.agg(
        F.min(cx).alias("x0"), F.max(cx).alias("x1"), F.min(cy).alias("y0"), F.max(cy).alias("y1")
    )
    rows = box.where("x0 is not null").select(
        "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("cy")
    )
    return rows.repartition("cy").select(F.explode(F.sequence("x0", "x1")).alias("cx"), "cy")


def _floor_div(a: Column, b: int) -> Column:
    """Integer division that rounds down for negative cells as well."""
    return F.floor((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def _targets(cell: Column, source_m: int, target_m: int) -> Column:
    """Target cells whose centre lies in source cell ``cell``, as an integer range.

    Centre of target t is (2t + 1) * target / 2; it is inside when
    2 * cell * source <= (2t + 1) * target < 2 * (cell + 1) * source.
    """
    step = 2 * target_m

    def first_at_or_after(edge: Column) -> Column:
        return -_floor_div(-(edge * F.lit(2 * source_m) - F.lit(target_m)), step)

    low, high = first_at_or_after(cell), first_at_or_after(cell + 1) - 1
    return F.when(low <= high, F.sequence(low, high)).otherwise(
        F.array().cast("array<bigint>")
    )


def source_cell(cell: Column, target_m: int, source_m: int) -> Column:
    """The cell of a grid of ``source_m`` that holds the centre of a cell of a grid of ``target_m``."""
    if source_m == target_m:
        return cell
    return _floor_div((cell.cast("long") * 2 + 1) * F.lit(target_m), 2 * source_m)


def regrid(df: DataFrame, source_m: int, target_m: int) -> DataFrame:
    """Nearest-neighbour resampling to another resolution, finer or coarser.

    The source pixel of each target cell is the one under the target's centre. That is plain
    integer arithmetic on the cell itself, so there is no join, grouping or shuffle.
    """
    if source_m == target_m:
        return df
    rest = [c for c in df.columns if c not in ("cx", "cy")]
    wide = df.select(
        *rest, "cy", F.explode(_targets(F.col("cx").cast("long"), source_m, target_m)).alias("cx")
    )
    out = wide.select(
        *rest, "cx", F.explode(_targets(F.col("cy").cast("long"), source_m, target_m)).alias("cy")
    )
    return out.select(*df.columns)


def regrid_mean(df: DataFrame, source_m: int, target_m: int, values: Sequence[str]) -> DataFrame:
    """Coarser grid by averaging the source pixels whose centre falls in each target cell."""
    if target_m < source_m:
        raise ValueError("the mean needs a coarser target")

    return (
        df.select(
            source_cell(F.col("cx").cast("long"), source_m, target_m).alias("cx"),
            source_cell(F.col("cy").cast("long"), source_m, target_m).alias("cy"),
            *values,
        )
        .groupBy("cx", "cy")
        .agg(*[F.avg(v).alias(v) for v in values])
    )


def terrain(dem: DataFrame, elevation: str = "elevation", spacing: float = 1.0) -> DataFrame:
    """Slope and aspect in degrees by central differences of the four neighbours.

    Each pixel goes to its tile, border pixels to the neighbouring tile as well, so one
    shuffle by tile serves both the row and the column window. Aspect is the downhill azimuth,
    clockwise from north. Both are NULL where a neighbour is missing or masked.
    """
    cx, cy = F.col("cx"), F.col("cy")

    def tile_at(dx: int, dy: int) -> Column:
        return F.struct(
            F.floor((cx + dx) / TILE_CELLS).alias("tx"), F.floor((cy + dy) / TILE_CELLS).alias("ty")
        )

    around = F.array_distinct(
        F.array(tile_at(0, 0), tile_at(1, 0), tile_at(-1, 0), tile_at(0, 1), tile_at(0, -1))
    )
    tiled = (
        dem.select("cx", "cy", F.col(elevation).cast("double").alias("_z"), F.explode(around).alias("_t"))
        .select("cx", "cy", "_z", F.col("_t.tx").alias("_tx"), F.col("_t.ty").alias("_ty"))
        .repartition("_tx", "_ty")
    )
    along_row = Window.partitionBy("_tx", "_ty", "cy").orderBy("cx")
    along_column = Window.partitionBy("_tx", "_ty", "cx").orderBy("cy")

    def neighbour(fn, axis: str, shift: int, window) -> Column:
        return F.when(fn(axis).over(window) == F.col(axis) + shift, fn("_z").over(window))

    sides = tiled.withColumns(
        {
            "_w": neighbour(F.lag, "cx", -1, along_row),
            "_e": neighbour(F.lead, "cx", 1, along_row),
        }
    ).withColumns(
        {
            "_s": neighbour(F.lag, "cy", -1, along_column),
            "_n": neighbour(F.lead, "cy", 1, along_column),
        }
    )
    own = sides.where(
        (F.col("_tx") == F.floor(cx / TILE_CELLS)) & (F.col("_ty") == F.floor(cy / TILE_CELLS))
    )
    across = F.lit(2.0 * spacing)
    dzdx, dzdy = (F.col("_e") - F.col("_w")) / across, (F.col("_n") - F.col("_s")) / across
    masked = F.col("_z").isNull() | dzdx.isNull() | dzdy.isNull()
    azimuth = F.degrees(F.atan2(F.lit(0.0) - dzdx, F.lit(0.0) - dzdy))
    return own.select(
        "cx",
        "cy",
        F.when(~masked, F.degrees(F.atan(F.sqrt(dzdx * dzdx + dzdy * dzdy)))).alias("slope"),
        F.when(~masked, F.when(azimuth < 0, azimuth + 360).otherwise(azimuth)).alias("aspect"),
    )


def stack_layers(
    long_layers: DataFrame,
    names: Sequence[str],
    keys: Sequence[str] = ("cx", "cy"),
    layer: str = "layer",
    value: str = "value",
) -> DataFrame:
    """Long layers ``(keys, layer, value)`` to one row per cell with a column per layer.

    Conditional aggregates need one shuffle for any number of layers; joins would need one each
    and ``pivot`` two.
    """
    return (
        long_layers.where(F.col(layer).isin(list(names)))
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col(layer) == n, F.col(value))).alias(n) for n in names])
    )


def stack_wide(
    parts: Sequence[DataFrame], names: Sequence[str], keys: Sequence[str] = ("cx", "cy")
) -> DataFrame:
    """Tables with some of the layers each to one row per cell with all of them.

    The rows are put one below the other and grouped once, whatever the number of tables; a single
    table that has all layers is taken as it is.
    """
    if len(parts) == 1 and all(n in parts[0].columns for n in names):
        return parts[0].select(*keys, *names)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(*keys).agg(*[F.max(f"`{n}`").alias(n) for n in names])


def add_custom_layer(
    stack: DataFrame, asset: DataFrame, band: str | None, name: str, keys: Sequence[str] = ("cx", "cy")
) -> DataFrame:
    """Left-join one band of another raster under a display name."""
    return stack.join(custom_layer(asset, band, name, keys), list(keys), "left")


def custom_layer(
    asset: DataFrame, band: str | None, name: str, keys: Sequence[str] = ("cx", "cy")
) -> DataFrame:
    """One band of a raster, the first when none is named, under a display name."""
    bands = [c for c in asset.columns if c not in keys]
    chosen = band or bands[0]
    if chosen not in bands:
        raise ValueError(f"no band {chosen!r}; the asset has {bands}")
    return asset.select(*keys, F.col(chosen).alias(name))
