"""Points or cells inside polygons, without a nested-loop join.

Polygons arrive as an edge table ``(region, x1, y1, x2, y2)``; holes and multipolygons need
nothing special. A point is inside when a ray towards +x crosses an odd number of edges.

The edges are turned into an index with one row per (region, tile) that touches the region:

* ``edges``  - edges that pass through the tile; only these are tested exactly
* ``steps``  - y values inside the tile's row where the parity of everything to the right flips
* ``parity`` - parity of everything to the right for the whole row

A point finds its tile by an equi-join and decides alone, so points are neither multiplied by
edges nor grouped again. Interior tiles carry no edges and accept at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from nichegrid.operators.joins import lookup_join
from nichegrid.session import cut_lineage

# an index within both limits is at most some tens of MB
INDEX_ROWS = 200_000
INDEX_EDGES = 1_000_000
CROWDED_TILE = 256
MAX_CUTS = 1024
TARGET_TILES = 20_000
CHUNK_EDGES = 8192


# Each edge once per tile row it spans; horizontal edges never cross the ray.
_ROWS = """
sloped as (
  select {region} as region, cast(x1 as double) as x1, cast(y1 as double) as y1,
    cast(x2 as double) as x2, cast(y2 as double) as y2,
    cast(least(y1, y2) as double) as ylo, cast(greatest(y1, y2) as double) as yhi
  from {edges} where y1 <> y2),
by_row as (
  select *, explode(sequence(floor(ylo / :tile), greatest(ceil(yhi / :tile) - 1, floor(ylo / :tile)))) as ty
  from sloped),
whole_rows as (
  select *, 0L as sub, ty * :tile as y_from, (ty + 1) * :tile as y_to from by_row)"""

# Tile columns an edge can touch between y_from and y_to, padded against rounding.
_SPANNED = """
  select *, floor(least(xa, xb) / :tile - 1e-9) as c_from, floor(greatest(xa, xb) / :tile + 1e-9) as c_to
  from (select *, (x2 - x1) * (greatest(ylo, y_from) - y1) / (y2 - y1) + x1 as xa,
          (x2 - x1) * (least(yhi, y_to) - y1) / (y2 - y1) + x1 as xb from {rows})"""

# Rows of tiles where more than :crowded edges meet in one tile are cut into thinner ones.
_CUT_ROWS = f"""
load as (
  select ty, cast(pow(2, ceil(log2(least(ceil(max(n) / :crowded), :most)))) as bigint) as cuts
  from (select ty, tx, count(*) as n
        from (select ty, explode(sequence(c_from, c_to)) as tx from ({_SPANNED.replace("{rows}", "whole_rows")}))
        group by ty, tx)
  group by ty),
thin as (
  select w.* except (sub), cuts, explode(sequence(0L, cuts - 1)) as sub
  from whole_rows w join load using (ty)),
rows as (
  select * except (cuts) from (
    select * except (y_from, y_to), ty * :tile + sub * :tile / cuts as y_from,
      if(sub = cuts - 1, (ty + 1) * :tile, ty * :tile + (sub + 1) * :tile / cuts) as y_to
    from thin)
  where ylo < y_to and yhi > y_from)"""

# An edge wholly to the right of a tile counts only through its end points: for a point at height
# py it contributes [y > py] for either end. Shared end points cancel unless the two edges start
# in different columns; a flip holds for the tiles between those columns.
_INDEX = f"""
spanned as ({_SPANNED.replace("{rows}", "rows")}),
touching as (
  select region, ty, sub, y_from, y_to, explode(sequence(c_from, c_to)) as tx,
    struct(x1, y1, x2, y2) as edge, cast(null as double) as step
  from spanned),
ends as (
  select region, ty, sub, y_from, y_to, c_from, explode(array(greatest(ylo, y_from), least(yhi, y_to))) as step
  from spanned),
odd as (
  select region, ty, sub, y_from, y_to, step, c_from from ends where step > y_from
  group by all having count(*) % 2 = 1),
ranked as (
  select *, row_number() over w as rank, lead(c_from) over w as c_next from odd
  window w as (partition by region, ty, sub, y_from, y_to, step order by c_from desc)),
flips as (
  select region, ty, sub, y_from, y_to, explode(sequence(c_next, c_from - 1)) as tx,
    cast(null as struct<x1: double, y1: double, x2: double, y2: double>) as edge, step
  from ranked where rank % 2 = 1 and c_next is not null),
parts as (table touching union all table flips)"""

# The edges of a tile in one row.
_WHOLE_TILES = """
select *, 1L as _chunks from (
  select region as _region, tx as _tx, ty as _ty, sub as _sub, y_from as _y_from, y_to as _y_to,
    collect_list(edge) as _edges, collect_list(if(step < y_to, step, null)) as _steps,
    count_if(step >= y_to) as _parity
  from parts
  group by all)
where size(_edges) > 0 or size(_steps) > 0 or _parity % 2 = 1"""

# The edges of a tile in as many rows as it takes to hold about :chunk of them each.
_SHARED_TILES = """
lots as (
  select region, ty, sub, tx, greatest(ceil(count(edge) / :chunk), 1L) as lots from parts group by all),
drawn as (
  select p.*, if(edge is null, 0L, pmod(xxhash64(edge), lots)) as lot
  from parts p join lots using (region, ty, sub, tx))
select *, count(*) over (partition by _region, _ty, _sub, _tx) as _chunks from (
  select region as _region, tx as _tx, ty as _ty, sub as _sub, y_from as _y_from, y_to as _y_to,
    collect_list(edge) as _edges, collect_list(if(step < y_to, step, null)) as _steps,
    count_if(step >= y_to) as _parity
  from drawn
  group by region, tx, ty, sub, y_from, y_to, lot)
where size(_edges) > 0 or size(_steps) > 0 or _parity % 2 = 1"""


def _exact(tile: float) -> float:
    """The power of two nearest to a tile size: dividing by it and multiplying with it never rounds,
    so a point and the rows of its tile always agree."""
    return 2.0 ** round(math.log2(tile))


def most_edges(edges: DataFrame, region: str, tile: float, crowded: int | None = None) -> int:
    """The most edges that meet in one tile of a region; counted, not gathered."""
    named = edges.select(F.col(region).alias("region"), "x1", "y1", "x2", "y2")
    args = {"tile": _exact(tile)}
    rows = "rows as (table whole_rows)"
    if crowded is not None:
        rows, args = _CUT_ROWS, {**args, "crowded": crowded, "most": MAX_CUTS}
    text = f"""with {_ROWS.replace('{region}', 'region')}, {rows},
      spanned as ({_SPANNED.replace("{rows}", "rows")}),
      touching as (select region, ty, sub, explode(sequence(c_from, c_to)) as tx from spanned)
      select max(n) as most from (select count(*) as n from touching group by region, ty, sub, tx)"""
    return edges.sparkSession.sql(text, args=args, edges=named).first()["most"] or 0


def tile_index(
    edges: DataFrame, region: str, tile: float, crowded: int | None = None, chunk: int | None = None
) -> DataFrame:
    """The index described above, one row per (region, tile).

    With ``crowded`` the rows of tiles where more edges meet are cut thinner; with ``chunk`` a
    tile that is still crowded takes several rows.
    """
    named = edges.select(F.col(region).alias("region"), "x1", "y1", "x2", "y2")
    args = {"tile": _exact(tile)}
    rows, tiles = "rows as (table whole_rows)", _WHOLE_TILES
    if crowded is not None:
        rows, args = _CUT_ROWS, {**args, "crowded": crowded, "most": MAX_CUTS}
    if chunk is not None:
        tiles, args = f",{_SHARED_TILES}", {**args, "chunk": chunk}
    text = f"with {_ROWS.replace('{region}', 'region')}, {rows}, {_INDEX}{tiles}"
    return edges.sparkSession.sql(text, args=args, edges=named)


@dataclass(frozen=True)
class AreaIndex:
    """A measured tile index; build it once for several clips of the same area."""

    frame: DataFrame
    region: str
    tile: float
    small: bool
    shared: bool
    parts: int = 1  # regions it knows; a point in several of them comes out once for each


def fitting_tile(edges: DataFrame, region: str) -> float:
    """Tile size at which the extents of all regions together hold about TARGET_TILES tiles."""
    extents = edges.groupBy(region).agg(
        (F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))).alias("w"),
        (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("h"),
    )
    total = extents.agg(F.sum(F.col("w") * F.col("h"))).first()[0]
    return math.sqrt(total / TARGET_TILES) if total else 1.0


def index_area(
    edges: DataFrame, region: str = "region", tile: float | None = None, crowded: int = CROWDED_TILE
) -> AreaIndex:
    """The tile index, written and measured, cut thinner where tiles are crowded.

    Without a ``tile`` size one is chosen that keeps the index small enough to broadcast; a given
    one is rounded to a power of two. Edges are counted per tile before any tile is gathered.
    """
    tile = _exact(tile or fitting_tile(edges, region))
    cut, most = None, most_edges(edges, region, tile)
    if most > crowded:
        cut, most = crowded, most_edges(edges, region, tile, crowded)
    shared = most > CHUNK_EDGES
    frame, size = _measured(tile_index(edges, region, tile, cut, CHUNK_EDGES if shared else None))
    small = size["rows"] <= INDEX_ROWS and (size["edges"] or 0) <= INDEX_EDGES
    return AreaIndex(frame, region, float(tile), small, shared, size["parts"])


def _measured(index: DataFrame) -> tuple[DataFrame, Row]:
    # its plan is long and would be planned, and in places run, again in every plan that clips twice
    index = cut_lineage(index)
    n = F.size("_edges")
    return index, index.agg(
        F.count("*").alias("rows"), F.sum(n).alias("edges"), F.count_distinct("_region").alias("parts")
    ).first()


def clip(
    points: DataFrame,
    edges: DataFrame | AreaIndex,
    x: str = "lon",
    y: str = "lat",
    region: str = "region",
    tile: float | None = None,
    crowded: int = CROWDED_TILE,
) -> DataFrame:
    """Rows of ``points`` inside each region, with the region's name in column ``region``.

    ``edges`` may be an :class:`AreaIndex`, which brings its own region column and tile.
    """
    area = edges if isinstance(edges, AreaIndex) else index_area(edges, region, tile, crowded)
    step = F.lit(area.tile)
    placed = points.withColumns({"_tx": F.floor(F.col(x) / step), "_ty": F.floor(F.col(y) / step)})
    if area.small:
        near = placed.join(F.broadcast(area.frame), ["_tx", "_ty"])
    else:
        near = lookup_join(placed, area.frame, ["_tx", "_ty"], broadcast_rows=0)
    crossings = f"""
      size(filter(_edges, e -> (e.y1 > `{y}`) != (e.y2 > `{y}`)
        and `{x}` < (e.x2 - e.x1) * (`{y}` - e.y1) / (e.y2 - e.y1) + e.x1))
      + size(filter(_steps, step -> step > `{y}`)) + _parity"""
    near = near.where(f"`{y}` >= _y_from and `{y}` < _y_to")
    kept = [c for c in points.columns if c != area.region]
    inside = near.where(f"_chunks = 1 and ({crossings}) % 2 = 1").select(*kept, "_region")
    if area.shared:
        # a point meets every row of such a tile; equal points are counted and given back
        met = near.where("_chunks > 1").groupBy(*kept, "_region", "_chunks")
        summed = met.agg(F.expr(f"sum({crossings})").alias("_c"), F.count("*").alias("_n"))
        odd = summed.withColumn("_copies", F.expr("_n div _chunks")).where("(_c div _copies) % 2 = 1")
        again = odd.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)")))
        inside = inside.unionByName(again.select(*kept, "_region"))
    return inside.withColumnRenamed("_region", area.region)


def rings_to_edges(polygons: DataFrame, rings: str = "rings", keep: tuple[str, ...] = ()) -> DataFrame:
    """Edge table from ``array<array<struct<x,y>>>`` rings; an open ring is closed."""
    ring = polygons.select(*keep, F.explode(rings).alias("_ring"))
    n = F.size("_ring")
    following = F.concat(F.slice("_ring", 2, n), F.slice("_ring", 1, 1))
    pairs = ring.select(*keep, F.explode(F.arrays_zip("_ring", following.alias("_next"))).alias("_e"))
    a, b = F.col("_e")["_ring"], F.col("_e")["_next"]
    return pairs.select(
        *keep,
        a["x"].alias("x1"),
        a["y"].alias("y1"),
        b["x"].alias("x2"),
        b["y"].alias("y2"),
    ).where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
