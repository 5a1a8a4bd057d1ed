"""Predictor layers on grids of their own, read at the resolution of a run.

All grids share their origin: a cell of a grid of ``m`` metres covers ``[c * m, (c + 1) * m)`` on each
axis. The value of a cell of the run is that of the source pixel under its centre, which is integer
arithmetic either way: points are taken to the source cells, so that sampling does not move a layer, and
a map takes the source cells to the run's, finer or coarser, in place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichegrid.functions.geo import cell_index
from nichegrid.operators import sampling
from nichegrid.operators.grid import regrid, source_cell, stack_wide
from nichegrid.session import cut_lineage

CELL = ("cx", "cy")
YEAR = "yr"


@dataclass(frozen=True)
class Layer:
    """Layers on one grid: ``cx, cy``, for yearly ones ``yr``, and a column each. Cells are ``metres`` wide."""

    table: DataFrame
    metres: int

    @property
    def dated(self) -> bool:
        return YEAR in self.table.columns

    @property
    def names(self) -> list[str]:
        return [c for c in self.table.columns if c not in (*CELL, YEAR)]

    def of_year(self, year: int, names: Sequence[str]) -> DataFrame:
        table = self.table.where(F.col(YEAR) == year) if self.dated else self.table
        return table.select(*CELL, *names)


@dataclass(frozen=True)
class Landscape:
    """Layers as a run sees them. ``step`` is the width of a run's cell in the units of coordinates."""

    layers: tuple[Layer, ...]
    resolution: int
    step: float

    def providers(self, features: Sequence[str]) -> list[tuple[Layer, list[str]]]:
        """The layers that are needed, each with the features it gives; a name belongs to the first that has it."""
        missing, out = list(features), []
        for layer in self.layers:
            own = [f for f in missing if f in layer.names]
            if own:
                out.append((layer, own))
                missing = [f for f in missing if f not in own]
        if missing:
            raise ValueError(f"no layer named {', '.join(missing)}")
        return out

    def dated(self, features: Sequence[str]) -> list[str]:
        return [f for layer, own in self.providers(features) if layer.dated for f in own]

    def placed(self, points: DataFrame) -> DataFrame:
        """Points with the run's cell they stand in."""
        at = {c: cell_index(F.col(x), self.step) for c, x in zip(CELL, ("lon", "lat"), strict=True)}
        return points.withColumns(at)

    def at_points(self, points: DataFrame, features: Sequence[str], year: int | None = None) -> DataFrame:
        """Placed points with a column per feature, NULL where a layer has none.

        A yearly layer is read for ``year``, or for each point's own year ``yr`` if that is not given.
        The points are written between layers: they are asked for their cells, then joined, and a plan
        that holds the layers before would hold each several times, growing as a power of their number.
        """
        for i, (layer, names) in enumerate(self.providers(features)):
            if i:
                points = cut_lineage(points)
            keys = ["_sx", "_sy"]
            table = layer.table if year is None else layer.of_year(year, names)
            if YEAR in table.columns:
                keys.append(YEAR)
            table = table.withColumnsRenamed(dict(zip(CELL, keys, strict=False))).select(*keys, *names)
            at = {k: source_cell(F.col(c), self.resolution, layer.metres) for k, c in zip(keys, CELL, strict=False)}
            points = sampling.sample_layers(points.withColumns(at), table, names, keys, "left").drop("_sx", "_sy")
        return points

    def map(
        self, features: Sequence[str], year: int, inside: Callable[[DataFrame], DataFrame] | None = None
    ) -> DataFrame:
        """``cx, cy`` and the features for every cell of the run that some layer covers.

        ``inside`` keeps the cells of an area; it is applied to each layer before they are brought together
        in one grouping.
        """
        parts = []
        for layer, names in self.providers(features):
            part = regrid(layer.of_year(year, names), layer.metres, self.resolution)
            parts.append(part if inside is None else inside(part))
        return stack_wide(parts, features)


def complete(features: Sequence[str]) -> Column:
    """Whether every feature has a value."""
    out = F.lit(True)
    for f in features:
        out = out & F.col(f"`{f}`").isNotNull()
    return out
