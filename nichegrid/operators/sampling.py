"""Layer values at points, and the samples a model is trained on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichegrid.functions.hashing import uniform
from nichegrid.operators.clip import AreaIndex, clip, index_area
from nichegrid.operators.joins import BROADCAST_ROWS, broadcast_limit, has_at_most, lookup_join, shuffled
from nichegrid.operators.ordering import hash_sample

# candidates in the first lot of random points, and lots (each four times the last) that may hit nothing
FIRST_DRAWS, EMPTY_LOTS = 4096, 8
CELL = ("cx", "cy")
LABEL = "PresAbs"


def sample_layers(
    points: DataFrame,
    layers: DataFrame,
    features: Sequence[str] | None = None,
    keys: Sequence[str] = CELL,
    how: str = "inner",
) -> DataFrame:
    """Layer values at the cell of each point; points with a masked value are dropped.

    The distinct cells asked for prune the layers first. When they are counted and few, the
    layers are never shuffled. The pruned layer rows are then attached to the points, so a
    cell that holds a third of the points costs one layer row. ``how="left"`` keeps dropped
    points with NULL features.
    """
    asked = _asked(points, keys)
    return _attach(points, _hits(points, layers, features, keys, asked), keys, how, asked)


def sample_stored(
    points: DataFrame,
    stored: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = CELL,
    how: str = "inner",
) -> DataFrame:
    """The same from a table that is bucketed by the keys (:func:`nichegrid.sources.layers.save_layers`).

    The distinct cells asked for go to the buckets of the layers, whose rows are neither counted nor moved.
    What they find has a row per cell, and a crowded cell is split where it is attached to its points.
    """
    keys, features = list(keys), list(features)
    wanted = points.select(*keys).dropna().distinct()
    hits = stored.select(*keys, *features).dropna(subset=features).join(wanted, keys)
    return points.drop(*features).join(hits, keys, how)


def _asked(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct cells of the points, each with its number of points in ``_rows``."""
    cells = points.select(*keys).dropna().groupBy(*keys)
    return cells.agg(F.count("*").alias("_rows")).persist()  # counted, joined, and searched for crowded cells


def _hits(
    points: DataFrame,
    layers: DataFrame,
    features: Sequence[str] | None,
    keys: Sequence[str],
    asked: DataFrame | None = None,
) -> tuple[DataFrame, bool]:
    """Unmasked layer rows of the cells that are asked for, and whether they may be broadcast."""
    keys = list(keys)
    features = list(features or [c for c in layers.columns if c not in keys])
    wanted = (_asked(points, keys) if asked is None else asked).select(*keys)
    band = layers.select(*keys, *features).dropna(subset=features)
    limit = min(BROADCAST_ROWS, broadcast_limit(band))
    if has_at_most(wanted, limit):
        rows = band.join(F.broadcast(wanted), keys).persist()  # the layer is scanned once
        return rows, has_at_most(rows, limit)  # a layer may hold a cell more than once
    return band.join(shuffled(wanted), keys, "left_semi").persist(), False


def _attach(
    points: DataFrame, hits: tuple[DataFrame, bool], keys: Sequence[str], how: str, asked: DataFrame | None = None
) -> DataFrame:
    rows, small = hits
    points = points.drop(*[c for c in rows.columns if c not in keys])  # a sampled value replaces an own one
    if small:
        return points.join(F.broadcast(rows), list(keys), how)
    return lookup_join(points, rows, list(keys), how, counts=asked)


def sample_by_year(
    points: DataFrame,
    static: DataFrame | None,
    yearly: DataFrame,
    temporal_features: Sequence[str],
    static_features: Sequence[str] = (),
    how: str = "inner",
    keys: Sequence[str] = CELL,
) -> DataFrame:
    """Each presence takes the temporal layers of its own year and the static ones as they are.

    One equality join on (cell, year) serves every year. Points without a year fall out.
    """
    dated = [*keys, "yr"]
    asked = _asked(points, dated)
    out = _attach(points, _hits(points, yearly, temporal_features, dated, asked), dated, how, asked)
    if static_features:
        out = _attach(out, _hits(points, static, static_features, keys), keys, how)
    return out


def excluded_count(
    points: DataFrame,
    static: DataFrame | None,
    yearly: DataFrame,
    temporal_features: Sequence[str],
    static_features: Sequence[str] = (),
) -> DataFrame:
    """Presences, sampled presences and the difference, in one pass over the points."""
    marked = sample_by_year(points, static, yearly, temporal_features, static_features, "left")
    complete = F.lit(True)
    for f in (*temporal_features, *static_features):
        complete = complete & F.col(f).isNotNull()
    return marked.agg(
        F.count("*").alias("n_presence"),
        F.count(F.when(complete, 1)).alias("n_sampled"),
        F.count(F.when(~complete, 1)).alias("excluded"),
    )


def background_cells(cells: DataFrame, n: int, seed: int = 42, keys: Sequence[str] = CELL) -> DataFrame:
    """``n`` background cells of the area, drawn by key hash."""
    return hash_sample(cells, n, list(keys), seed)


def background_points(
    edges: DataFrame,
    n: int,
    region: str = "region",
    tile: float | None = None,
    seed: int = 42,
    projected: bool = False,
    area: AreaIndex | None = None,
) -> DataFrame:
    """``n`` points spread evenly over the area of the polygons.

    Coordinates are longitude and latitude, evened out on the sphere, or plain units when
    ``projected``. A point counts once however many parts of the area hold it. A first lot of candidates
    from the extent shows how much of it the area fills; then as many are drawn as that asks for, and
    doubled until enough fall inside. An area that no candidate hits is an error. Every draw is a hash
    of its number, so reruns agree.
    """
    box = edges.agg(
        F.min(F.least("x1", "x2")).alias("x0"),
        F.max(F.greatest("x1", "x2")).alias("x1"),
        F.min(F.least("y1", "y2")).alias("y0"),
        F.max(F.greatest("y1", "y2")).alias("y1"),
    ).first()
    if box["x0"] is None or box["x0"] == box["x1"] or box["y0"] == box["y1"]:
        raise ValueError("the area is empty")
    width, height = box["x1"] - box["x0"], box["y1"] - box["y0"]
    if area is None:
        named = edges if region in edges.columns else edges.withColumn(region, F.lit("area"))
        area = index_area(named, region, tile)

    def inside(rounds: int) -> DataFrame:
        draws = edges.sparkSession.range(rounds).withColumnRenamed("id", "draw")
        u, v = uniform(["draw"], f"{seed}-x"), uniform(["draw"], f"{seed}-y")
        if projected:
            lat = F.lit(box["y0"]) + v * height
        else:
            low, high = F.sin(F.radians(F.lit(box["y0"]))), F.sin(F.radians(F.lit(box["y1"])))
            lat = F.degrees(F.asin(low + v * (high - low)))
        placed = draws.select("draw", (F.lit(box["x0"]) + u * width).alias("lon"), lat.alias("lat"))
        found = clip(placed, area).drop(area.region)
        return found if area.parts == 1 else found.dropDuplicates(["draw"])

    rounds, empty = FIRST_DRAWS, 0
    while empty < EMPTY_LOTS:
        found = inside(rounds).persist()  # counted, then drawn from
        held = found.count()
        if held >= n:
            return hash_sample(found, n, ["draw"], seed)
        found.unpersist()
        # so many more as the share of hits asks for, twice as many where there is none yet
        empty = 0 if held else empty + 1
        rounds = max(4 * rounds if not held else 2 * rounds, int(1.2 * n * rounds / held) + 64 if held else 0)
    raise ValueError(f"the area is empty: none of {rounds // 4} points of its extent is inside")


def thin(points: DataFrame, keep_lowest: str, by: Sequence[str] = (), keys: Sequence[str] = CELL) -> DataFrame:
    """One record per cell (and per ``by`` group), the one with the lowest ``keep_lowest``.

    A minimum combines on the map side, so a crowded cell never reaches one task whole.
    """
    group = [*by, *keys]
    rest = [c for c in points.columns if c not in group and c != keep_lowest]
    best = points.groupBy(*group).agg(F.min(F.struct(keep_lowest, *rest)).alias("_best"))
    return best.select(*group, "_best.*").select(*points.columns)


def presence_background(
    presence: DataFrame, background: DataFrame, features: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """Labelled union on the background's column order; spaces in names become underscores."""
    columns = [*carry, *features]

    def labelled(df: DataFrame, label: int) -> DataFrame:
        return df.select(
            *[F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in columns], F.lit(label).alias(LABEL)
        )

    return labelled(background, 0).unionByName(labelled(presence, 1))


def clean_names(features: Sequence[str]) -> list[str]:
    """Feature names as they appear after :func:`presence_background`."""
    return [f.replace(" ", "_") for f in features]


def balanced(sample: DataFrame, ids: Sequence[str], seed: int = 42, label: str = LABEL) -> DataFrame:
    """All presences and as many background rows, drawn by key hash; fails if there are fewer."""
    counts = {r[label]: r["count"] for r in sample.groupBy(label).count().collect()}  # two rows
    n, available = counts.get(1, 0), counts.get(0, 0)
    if available < n:
        raise ValueError(f"need {n} background rows, have {available}")
    chosen = hash_sample(sample.where(F.col(label) == 0), n, ids, seed)
    return sample.where(F.col(label) == 1).unionByName(chosen)


def with_split(sample: DataFrame, ids: Sequence[str], train_size: float = 0.75, seed: int | str = "") -> DataFrame:
    """Adds ``random`` and ``is_train`` (``random < train_size``) from the key hash."""
    if not 0 < train_size < 1:
        raise ValueError("train_size must lie between 0 and 1")
    return sample.withColumn("random", uniform(ids, seed)).withColumn(
        "is_train", F.col("random") < train_size
    )


def evaluation_sample(
    presence: DataFrame, ids: Sequence[str], limit: int | None = None, seed: int | str = ""
) -> DataFrame:
    """Presences with their draw ``random``: all of them, or the first ``limit`` in key-hash order."""
    draw: Column = uniform(ids, seed).alias("random")
    drawn = presence.select("*", draw)
    return drawn if limit is None else drawn.orderBy("random", *ids).limit(limit)
