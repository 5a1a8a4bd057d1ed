"""The modelling run end to end.

Inputs are tables: presences ``occ_id, species, yr, lon, lat``, boundary edges of the area,
static layers ``cx, cy, ...``, yearly layers ``cx, cy, yr, ...`` or an embedding mosaic
``cx, cy, year, embedding``. Cells are ``floor(coordinate / step)``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cache, cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.config import RunConfig
from nichegrid.functions.catalogue import TEMPORAL_LAYERS
from nichegrid.functions.surface import shift_layers
from nichegrid.operators import metrics, sampling
from nichegrid.operators.clip import AreaIndex, index_area
from nichegrid.operators.grid import regrid
from nichegrid.plans import embedding as embedding_plan
from nichegrid.plans import forest, maxent
from nichegrid.plans.landscape import CELL, YEAR, Landscape, Layer, complete
from nichegrid.session import cut_lineage
from nichegrid.sources.surfaces import clip_cells, embedding_for_year

AREA = "_area"
# Fixed value: the resolution of embedding runs in metres.
EMBEDDING_RESOLUTION = 30


@dataclass(frozen=True)
class Run:
    """Outcome of a run: a results row, the suitability surface and what is needed to redo it.

    Each is made when it is first asked for, so that a run asked for its figures never looks at a map's cells.
    """

    config: RunConfig
    judge: Callable[[], DataFrame] = field(repr=False)
    draw: Callable[[], DataFrame] = field(repr=False)
    model: object = None
    features: tuple[str, ...] = ()
    layers: Callable[[], DataFrame] | None = field(default=None, repr=False)

    @cached_property
    def results(self) -> DataFrame:
        """One row of figures."""
        return _made(self.judge)

    @cached_property
    def surface(self) -> DataFrame:
        """``cx, cy, score`` for the cells of the area."""
        return _made(self.draw)

    @cached_property
    def stack(self) -> DataFrame | None:
        """The features of the cells of the area."""
        return None if self.layers is None else _made(self.layers)


def _made(make: Callable[[], DataFrame]) -> DataFrame:
    try:
        return make()
    except Exception as error:
        raise RuntimeError(f"SDM run failed: {error}") from error


def one_area(edges: DataFrame) -> DataFrame:
    """Edges with the part they belong to; inside the area is inside any part.

    Parts are told apart by the names a boundary carries. Without one there is a single part.
    """
    names = [c for c in ("level", "cntr_code", "nuts_name", "region") if c in edges.columns]
    part = F.concat_ws("/", *[F.col(c).cast("string") for c in names]) if names else F.lit("area")
    return edges.select(part.alias(AREA), "x1", "y1", "x2", "y2")


def cells_inside(cells: DataFrame, area: AreaIndex, step: float) -> DataFrame:
    """Cells with their centre in any part of the area, each once."""
    found = clip_cells(cells, area, step).drop(area.region)
    return found if area.parts == 1 else found.dropDuplicates(["cx", "cy"])


def _landscape(
    config: RunConfig,
    static: DataFrame | None,
    yearly: DataFrame | None,
    step: float,
    temporal: frozenset[str],
) -> Landscape:
    """The layers of two tables that are on the run's grid already."""
    layers = []
    chosen = config.selected_layers
    if static is not None:
        layers.append(static.select(*CELL, *[f for f in static.columns if f in chosen and f not in temporal]))
    if yearly is not None:
        layers.append(yearly.select(*CELL, YEAR, *[f for f in yearly.columns if f in chosen and f in temporal]))
    return Landscape(tuple(Layer(table, config.resolution) for table in layers), config.resolution, step)


def sampled_presences(config: RunConfig, presences: DataFrame, land: Landscape) -> DataFrame:
    """Every presence with ``sample_id``, its cell and the selected layers, those of its own year where they are
    yearly; NULL where a layer has no value."""
    points = land.placed(presences).persist()  # asked for its cells, then joined, once for each grid
    named = points.withColumn("sample_id", F.concat(F.lit("p"), F.col("occ_id").cast("string")))
    return land.at_points(named, config.selected_layers).select("sample_id", *CELL, *config.selected_layers)


def training_sample(
    config: RunConfig,
    presences: DataFrame,
    edges: DataFrame,
    land: Landscape,
    tile: float | None = None,
    projected: bool = False,
    area: AreaIndex | None = None,
) -> tuple[DataFrame, int]:
    """(labelled sample with key ``sample_id``, number of excluded presences)."""
    features = list(config.selected_layers)
    marked = cut_lineage(sampled_presences(config, presences, land).drop(*CELL))
    counted = marked.agg(F.count("*").alias("n"), F.count(F.when(complete(features), 1)).alias("kept")).first()
    if not counted["kept"]:
        raise ValueError("no presence has a value in every selected layer")
    excluded = counted["n"] - counted["kept"] if land.dated(features) else 0
    draws = sampling.background_points(one_area(edges), counted["n"], AREA, tile, config.seed, projected, area)
    drawn = land.placed(draws).withColumn("sample_id", F.concat(F.lit("b"), F.col("draw").cast("string"))).persist()
    background = land.at_points(drawn, features, config.year_start).where(complete(features))
    sample = sampling.presence_background(marked.where(complete(features)), background, features, ["sample_id"])
    return cut_lineage(sample), excluded


def run_model(
    config: RunConfig,
    presences: DataFrame,
    edges: DataFrame,
    static: DataFrame | None,
    yearly: DataFrame | None,
    step: float,
    tile: float | None = None,
    temporal: frozenset[str] = TEMPORAL_LAYERS,
    projected: bool = False,
) -> Run:
    """A run over layers that are on its grid already; ``step`` is their cell width in units of coordinates."""
    try:
        land = _landscape(config, static, yearly, step, temporal)
        return model_run(config, presences, edges, land, tile, projected)
    except Exception as error:
        raise RuntimeError(f"SDM run failed: {error}") from error


def model_run(
    config: RunConfig,
    presences: DataFrame,
    edges: DataFrame,
    land: Landscape,
    tile: float | None = None,
    projected: bool = False,
) -> Run:
    """Random forest or maximum entropy: sample, split, train, evaluate, classify the area.

    The evaluation runs when the results are asked for, the map when the surface is.
    """
    config = config.checked()
    if config.model_type not in ("rf", "maxent"):
        raise ValueError(f"model_type {config.model_type!r} is not 'rf' or 'maxent'")
    if not config.selected_layers:
        raise ValueError("no layer selected")
    area = index_area(one_area(edges), AREA, tile)
    sample, excluded = training_sample(config, presences, edges, land, tile, projected, area)
    features = tuple(sampling.clean_names(config.selected_layers))
    split = sampling.with_split(sample, ["sample_id"], config.train_size, config.seed)
    model = _fit(config, split.where("is_train"), features)

    def judged() -> DataFrame:
        scored = _score(model, split, features).persist()  # once for both shares
        accuracy = metrics.accuracy(metrics.cut_probability(scored.where("is_train"))).first()["overall_accuracy"]
        auc = metrics.roc_auc(scored.where("not is_train")).first()["roc_auc"]
        scored.unpersist()
        row = {"overall_accuracy": accuracy, "excluded_presence_count": excluded, "roc_auc": auc}
        if config.model_type == "rf":
            row |= forest.importances(model, features)
        return sample.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in row.items() if v is not None])

    @cache
    def stack() -> DataFrame:
        inside = land.map(config.selected_layers, config.year_start, lambda cells: cells_inside(cells, area, land.step))
        return inside.toDF(*CELL, *features)

    return Run(config, judged, lambda: _classify(model, stack(), features), model, features, stack)


def _fit(config: RunConfig, train: DataFrame, features: tuple[str, ...]):
    if config.model_type == "maxent":
        return maxent.fit(train, features)
    return forest.fit(
        train, forest.feature_vector(features), ["sample_id"], config.n_trees, config.max_depth, config.seed
    )


def _score(model, df: DataFrame, features: tuple[str, ...], name: str = "score") -> DataFrame:
    if isinstance(model, maxent.MaxentModel):
        return model.score(df, name)
    return forest.score(model, df, forest.feature_vector(features), name)


def _classify(model, stack: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Probability for every cell that has all layers; a single scan of the stack."""
    return _score(model, stack.dropna(subset=list(features)), features).select("cx", "cy", "score")


def what_if(run: Run, offsets: Mapping[str, object] | None = None) -> DataFrame:
    """Scores on shifted layers next to the original ones; the shifts are those of the configuration unless given.

    Offsets always apply to the original stack, so repeated what-ifs do not add up. Both scores
    come from the same row; nothing is joined.
    """
    if run.config.model_type == "embedding" or run.model is None:
        raise ValueError("what-if is not available for the embedding model")
    if run.stack is None or not run.features:
        raise ValueError("the layer stack is not available")
    offsets = run.config.whatif_offsets if offsets is None else offsets
    original = _score(run.model, run.stack.dropna(subset=list(run.features)), run.features)
    shifted = shift_layers(original, offsets, run.features)
    out = _score(run.model, shifted, run.features, "whatif_score")
    return out.select(
        "cx", "cy", "score", "whatif_score", (F.col("whatif_score") - F.col("score")).alias("delta")
    )


def run_embedding(
    config: RunConfig,
    presences: DataFrame,
    edges: DataFrame,
    embeddings: DataFrame,
    step: float,
    tile: float | None = None,
    limit: int | None = None,
    projected: bool = False,
) -> Run:
    """Similarity to the mean presence embedding, on the grid of the mosaic, whose cells are ``step`` wide."""
    try:
        mosaic = Layer(embedding_for_year(embeddings, config.year_start).drop("year"), EMBEDDING_RESOLUTION)
        return embedding_run(config, presences, edges, mosaic, step, tile, limit, projected)
    except Exception as error:
        raise RuntimeError(f"Embedding run failed: {error}") from error


def embedding_run(
    config: RunConfig,
    presences: DataFrame,
    edges: DataFrame,
    mosaic: Layer,
    step: float,
    tile: float | None = None,
    limit: int | None = None,
    projected: bool = False,
) -> Run:
    """Similarity to the mean presence embedding, evaluated on presences and random points.

    The grid is that of EMBEDDING_RESOLUTION whatever the configuration says, ``step`` wide in units of
    coordinates. ``limit`` evaluates on the first presences by hash instead of all of them. The mosaic is
    scored once for the map, on its own grid; points take their vectors along.
    """
    config = config.checked()
    area = index_area(one_area(edges), AREA, tile)
    land = Landscape((mosaic,), EMBEDDING_RESOLUTION, step)
    points = land.placed(presences).persist()
    at_presences = cut_lineage(
        land.at_points(points, ["embedding"]).where("embedding is not null").select("occ_id", "embedding")
    )
    mean = embedding_plan.mean_of(at_presences)
    scored_presences = embedding_plan.score_against(at_presences, mean)
    chosen = (
        scored_presences
        if limit is None
        else sampling.evaluation_sample(scored_presences, ["occ_id"], limit, config.seed)
    )
    n = chosen.count()
    if n == 0:
        raise ValueError("the evaluation has no samples")

    def judged() -> DataFrame:
        draws = sampling.background_points(one_area(edges), n, AREA, tile, config.seed, projected, area)
        background = land.at_points(land.placed(draws).persist(), ["embedding"]).where("embedding is not null")
        rows = embedding_plan.evaluation_rows(chosen, embedding_plan.score_against(background, mean))
        auc = metrics.roc_auc(rows).first()["roc_auc"]
        if auc is None:
            raise ValueError("the evaluation has no background")
        return mosaic.table.sparkSession.range(1).select(F.lit(auc).alias("roc_auc"))

    def surface() -> DataFrame:
        scored = embedding_plan.score_against(mosaic.table, mean).select(*CELL, "score")
        return cells_inside(regrid(scored, mosaic.metres, EMBEDDING_RESOLUTION), area, step)

    return Run(config, judged, surface)
