"""The notebook's maps: a forest grown on a balanced sample with a smallest leaf, at 30 m."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.config import RunConfig
from nichegrid.operators import sampling
from nichegrid.operators.clip import index_area
from nichegrid.plans import forest, pipeline
from nichegrid.plans.landscape import CELL, Landscape, Layer
from nichegrid.plans.run import Tables, area, presences
from nichegrid.session import cut_lineage
from nichegrid.sources.surfaces import embedding_for_year

# Fixed value: the resolution of these maps in metres.
RESOLUTION = 30


def evened(sample: DataFrame, seed: int) -> DataFrame:
    """All presences and as many background rows by key hash, or all where there are not so many."""
    counts = {r[sampling.LABEL]: r["count"] for r in sample.groupBy(sampling.LABEL).count().collect()}  # two rows
    if counts.get(0, 0) <= counts.get(1, 0):
        return sample
    return sampling.balanced(sample, ["sample_id"], seed)


def forest_area(config: RunConfig, tables: Tables, tile: float | None = None) -> DataFrame:
    """``cx, cy, score`` for the cells of the configured area that have all selected layers."""
    config = config.checked()
    edges, points = area(config, tables), presences(config, tables)
    land = Landscape(tables.layers, RESOLUTION, RESOLUTION / tables.metres_per_unit)
    index = index_area(pipeline.one_area(edges), pipeline.AREA, tile)
    sample, _ = pipeline.training_sample(config, points, edges, land, tile, tables.projected, index)
    features = sampling.clean_names(config.selected_layers)
    vector = forest.feature_vector(features)
    model = forest.fit(
        cut_lineage(evened(sample, config.seed)), vector, ["sample_id"],
        config.n_trees, config.max_depth, config.seed, leaf_share=forest.LEAF_SHARE,
    )
    cells = land.map(config.selected_layers, config.year_start, lambda c: pipeline.cells_inside(c, index, land.step))
    return forest.score(model, cells.toDF(*CELL, *features).dropna(), vector).select(*CELL, "score")


def embedding_area(
    config: RunConfig, tables: Tables, tile: float | None = None, n_trees: int = forest.EMBEDDING_TREES
) -> DataFrame:
    """``cx, cy, score`` for the mosaic's own cells in the configured area, from a forest on its bands.

    Presences and random points of the area take the vectors of their 30 m cells; the forest is grown on
    those, and the mosaic is only scanned.
    """
    config = config.checked()
    edges, points = area(config, tables), presences(config, tables)
    mosaic = Layer(embedding_for_year(tables.mosaic.table, config.year_start).drop("year"), tables.mosaic.metres)
    land = Landscape((mosaic,), RESOLUTION, RESOLUTION / tables.metres_per_unit)
    index = index_area(pipeline.one_area(edges), pipeline.AREA, tile)
    bands = F.col("embedding").cast("array<double>").alias("bands")

    def sampled(df: DataFrame, name: str, label: int) -> DataFrame:
        key = F.concat(F.lit(name[0]), F.col(name).cast("string")).alias("sample_id")
        found = land.at_points(land.placed(df).persist(), ["embedding"]).where("embedding is not null")
        return found.select(key, bands, F.lit(label).alias(sampling.LABEL))

    known = cut_lineage(sampled(points, "occ_id", 1))
    n = known.count()
    if not n:
        raise ValueError("no presence has an embedding")
    draws = sampling.background_points(
        pipeline.one_area(edges), n, pipeline.AREA, tile, config.seed, tables.projected, index
    )
    sample = cut_lineage(known.unionByName(sampled(draws, "draw", 0)))
    vector = array_to_vector(F.col("bands"))
    model = forest.fit(
        evened(sample, config.seed), vector, ["sample_id"], n_trees, forest.EMBEDDING_DEPTH, config.seed,
        leaf_share=forest.LEAF_SHARE,
    )
    cells = pipeline.cells_inside(mosaic.table, index, mosaic.metres / tables.metres_per_unit)
    scored = forest.score(model, cells.where("embedding is not null").select(*CELL, bands), vector)
    return scored.select(*CELL, "score")
