"""A run from its configuration alone: area, presences, layers and resolution are what the choices say."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.config import RunConfig
from nichegrid.functions.geo import METRES_PER_DEGREE
from nichegrid.plans import pipeline
from nichegrid.plans.landscape import Landscape, Layer
from nichegrid.sources import occurrences, regions
from nichegrid.sources.surfaces import embedding_for_year


@dataclass(frozen=True)
class Tables:
    """What runs choose from.

    ``records`` are published records and ``datasets`` own ones by key; ``countries`` and ``counties`` are
    boundaries (``cntr_code, nuts_name`` with rings, or edges); ``layers`` have grids of their own, and so
    has the embedding ``mosaic``, which is one table for all years. ``metres_per_unit`` says how long one
    unit of the coordinates is; ``projected`` coordinates are drawn from evenly as they are.
    """

    records: DataFrame
    countries: DataFrame
    counties: DataFrame
    layers: tuple[Layer, ...] = ()
    mosaic: Layer | None = None
    datasets: Mapping[str, DataFrame] = field(default_factory=dict)
    metres_per_unit: float = METRES_PER_DEGREE
    projected: bool = False


def area(config: RunConfig, tables: Tables) -> DataFrame:
    """Edges of the county of the configuration, or of its country when it names none."""
    chosen = regions.select_area(tables.countries, tables.counties, config.country_code, config.county_name)
    return regions.boundary_edges(chosen) if "rings" in chosen.columns else chosen


def presences(config: RunConfig, tables: Tables) -> DataFrame:
    """``occ_id, species, yr, lon, lat`` by the data mode, species, country and years of the configuration.

    The id is the record's key. Without a key it follows from the record itself; equal records are
    numbered, so that none is lost.
    """
    config.checked()
    records = tables.records
    if config.data_mode == "own":
        if config.dataset_key not in tables.datasets:
            raise ValueError(f"no dataset with the key {config.dataset_key!r}")
        records = tables.datasets[config.dataset_key]
    keyed = ["key"] if "key" in records.columns else []
    found = occurrences.fetch_presences(
        config.data_mode, records, config.species, config.country_code,
        config.year_start, config.year_end, config.dataset_key, carry=keyed,
    )
    if not keyed:
        same = found.groupBy(*found.columns).agg(F.count("*").alias("_n"))
        every = same.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n")
        digest = F.md5(F.to_json(F.struct(*found.columns), {"ignoreNullFields": "false"}))
        found = every.withColumn("key", F.concat_ws("-", digest, F.col("_i").cast("string")))
    return found.select(
        F.col("key").alias("occ_id"), "species", F.col("year").cast("long").alias("yr"), "lon", "lat"
    )


def landscape(config: RunConfig, tables: Tables) -> Landscape:
    """The layers on the grid of the configuration's resolution."""
    return Landscape(tables.layers, config.resolution, config.resolution / tables.metres_per_unit)


def run(config: RunConfig, tables: Tables, tile: float | None = None) -> pipeline.Run:
    """The run that the configuration describes; any failure is one ``RuntimeError``.

    Embedding runs keep their own resolution.
    """
    try:
        config = config.checked()
        edges, points = area(config, tables), presences(config, tables)
        if config.model_type != "embedding":
            land = landscape(config, tables)
            return pipeline.model_run(config, points, edges, land, tile, tables.projected)
        if tables.mosaic is None:
            raise ValueError("an embedding run needs a mosaic")
        one_year = embedding_for_year(tables.mosaic.table, config.year_start).drop("year")
        step = pipeline.EMBEDDING_RESOLUTION / tables.metres_per_unit
        mosaic = Layer(one_year, tables.mosaic.metres)
        return pipeline.embedding_run(config, points, edges, mosaic, step, tile, projected=tables.projected)
    except Exception as error:
        raise RuntimeError(f"SDM run failed: {error}") from error
