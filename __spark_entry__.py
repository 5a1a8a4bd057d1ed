"""

A query is registered under the name the blueprint gives the operator. ``nichegrid.standins``
says how the given tables stand in for occurrences, boundaries and rasters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichegrid.config import RunConfig
from nichegrid.functions import catalogue, geo, spectral, surface, vectors
from nichegrid.operators import composites, correlation, grid, metrics, sampling, zonal
from nichegrid.operators.clip import clip, index_area
from nichegrid.plans import embedding, evaluation, forest, layers, notebook, pipeline
from nichegrid.plans import run as runs
from nichegrid.plans.landscape import Layer
from nichegrid.session import cut_lineage, scratch_path
from nichegrid.sources import archives, files, occurrences, regions, shapefiles, surfaces
from nichegrid.sources.layers import save_layers
from nichegrid.standins import (
    Views,
    oracle,
    pixel_years,
    surveyed,
    zipped_shapefiles,
    zipped_tables,
)

# The text operators are a subpackage of their own that may be absent; nothing else needs it.
try:
    import corpus_pipeline
    from nichegrid.llm import queries as _text
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "nichegrid.llm"):
        raise
    _text = None

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = oracle(sql)
        return fn

    return register


def entry(spark: SparkSession) -> DataFrame:
    """Embedding suitability: mean presence vector, similarity per pixel, exact AUC."""
    return queries()["embedding_pipeline"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Views(spark, folder))

    found = {name: bind(fn) for name, fn in _QUERIES.items()}
    if _text is not None:
        found |= _text.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    found = dict(_ORACLES)
    if _text is not None:
        found |= _text.oracle_sql()
        if corpus_pipeline.ORACLE_SQL is not None:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def _r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


def _presences(df: DataFrame) -> DataFrame:
    return df.select("species", F.col("year").cast("long").alias("year"), _r("lon"), _r("lat"))


# ---- occurrence sources ---------------------------------------------------------------------

_OBSERVED = """species = '2-HIGH' and countryCode = 'C1' and hasCoordinate
  and basisOfRecord = 'HUMAN_OBSERVATION'"""
_PRESENCE = "species, year, round(decimalLongitude, 6) as lon, round(decimalLatitude, 6) as lat"


@_query(
    "occ_explore",
    f"""select {_PRESENCE} from {{records}}
where {_OBSERVED} and year between 1996 and 1999 order by key limit 300""",
)
def _(v: Views) -> DataFrame:
    return _presences(occurrences.fetch_presences("explore", v.records, "2-HIGH", "C1", 1996, 1999, limit=occurrences.EXPLORE_LIMIT))


@_query(
    "occ_deepdive",
    f"select {_PRESENCE} from {{records}} where {_OBSERVED} and year between 1996 and 1999",
)
def _(v: Views) -> DataFrame:
    return _presences(occurrences.fetch_presences("deepdive", v.records, "2-HIGH", "C1", 1996, 1999))


@_query(
    "occ_own",
    f"""select {_PRESENCE} from {{records}}
where contains(lower(species), 'hig') and year between 1996 and 1999""",
)
def _(v: Views) -> DataFrame:
    return _presences(
        occurrences.fetch_presences("own", v.records, "HiG", "", 1996, 1999, dataset_key="orders")
    )


@_query(
    "occ_per_year",
    f"select year, count(*) as n, 'read' as status from {{records}} where {_OBSERVED} group by year",
)
def _(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "by-year")
    occurrences.write_by_year(v.records, path)
    stored = occurrences.read_by_year(v.spark, path).withColumn("year", F.col("year").cast("long"))
    seen = stored.where(
        "species = '2-HIGH' and countryCode = 'C1' and hasCoordinate and basisOfRecord = 'HUMAN_OBSERVATION'"
    )
    status = occurrences.year_status(v.spark, path).withColumnRenamed("year", "of").select("of", "status")
    counted = occurrences.records_per_year(seen)
    return counted.join(status, F.col("year").eqNullSafe(F.col("of")), "left").select("year", "n", "status")


# what every file of every year holds, those without a year included
@_query("occ_year_status", "select year, count(*) as n, 'read' as status, count(*) as kept from {records} group by year")
def _(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "by-year")
    occurrences.write_by_year(v.records, path)
    kept, status = occurrences.read_readable(v.spark, path, v.records.schema)
    found = occurrences.records_per_year(kept).select(F.col("year").alias("of"), F.col("n").alias("kept"))
    return status.join(found, F.col("year").eqNullSafe(F.col("of")), "left").drop("of")


@_query(
    "occ_observations",
    f"""select species, year, month, round(decimalLongitude, 6) as lon, round(decimalLatitude, 6) as lat
from {{records}} where {_OBSERVED} order by key limit 10000""",
)
def _(v: Views) -> DataFrame:
    found = occurrences.observations(v.records, "2-HIGH", "C1", occurrences.OBSERVATION_LIMIT)
    return found.select("species", "year", "month", _r("lon"), _r("lat"))


@_query(
    "occ_sql",
    f"""select species, year, round(decimalLongitude, 6) as long, round(decimalLatitude, 6) as lat
from {{records}} where {_OBSERVED} and year >= 1998 order by key limit 2000""",
)
def _(v: Views) -> DataFrame:
    text = """SELECT species, year, decimalLongitude AS long, decimalLatitude AS lat
        FROM occurrence
        WHERE countryCode = :country AND species = :species AND year >= :since
          AND hasCoordinate = TRUE AND basisOfRecord = 'HUMAN_OBSERVATION'
        ORDER BY key LIMIT 2000"""
    out = occurrences.query(v.records, text, {"country": "C1", "species": "2-HIGH", "since": 1998})
    return out.select("species", "year", _r("long"), _r("lat"))


@_query("records", f"select scientificName as {_PRESENCE} from {{records}}")
def _(v: Views) -> DataFrame:
    return _presences(occurrences.records_table(v.records.drop("species"), "2-HIGH"))


@_query(
    "cleanup",
    "select cast(key as string) as key, species, year, cast(hasCoordinate as string) as flag from {records}",
)
def _(v: Views) -> DataFrame:
    raw = v.records.select("key", "species", "year", F.col("hasCoordinate").alias("flag"))
    return occurrences.cleanup(raw).withColumn("year", F.col("year").cast("long"))


@_query(
    "suggest",
    """select distinct name from (
  select coalesce(case when p_partkey % 5 = 0 then null else p_name end, p_type || ' ' || p_name) as name
  from {part}) where starts_with(lower(name), 'bl') order by name limit 5""",
)
def _(v: Views) -> DataFrame:
    taxa = v.part.select(
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("canonicalName"),
        F.concat_ws(" ", "p_type", "p_name").alias("scientificName"),
    )
    return occurrences.suggest(taxa, "Bl")


# ---- files ----------------------------------------------------------------------------------


@_query("ingest_tsv", f"select key, {_PRESENCE}, month from {{records}}")
def _(v: Views) -> DataFrame:
    raw = v.records.select(
        "key", "scientificName", "year", "month", F.col("decimalLatitude").alias("lat"),
        F.col("decimalLongitude").alias("lon"), "species",
    )
    path = scratch_path(v.spark, "ingested")
    table = archives.standardise(archives.table_of_archives(zipped_tables(raw)))
    table.write.mode("ignore").parquet(path)
    return v.spark.read.parquet(path).select(
        F.col("key").cast("long").alias("key"),
        "species",
        "year",
        F.round("decimalLongitude", 6).alias("lon"),
        F.round("decimalLatitude", 6).alias("lat"),
        F.col("month").cast("long").alias("month"),
    )


_POINTS = "select species, yr as year, round(lon, 6) as lon, round(lat, 6) as lat from {occurrence}"


@_query("read_csv_points", _POINTS)
def _(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "points-csv")
    shown = v.occurrence.select(
        F.col("species").alias("Taxon"), F.col("lon").alias("decimalLongitude"),
        F.col("lat").alias("decimalLatitude"), F.col("yr").alias("Year"),
    )
    shown.write.option("header", "true").option("sep", ";").csv(path)
    return _presences(files.read_points_csv(v.spark, path))


@_query("read_geojson", _POINTS)
def _(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "points-geojson")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct("species", F.col("yr").alias("year")).alias("properties"),
    )
    v.occurrence.select(F.to_json(feature)).write.text(path)
    return _presences(files.read_points_geojson(v.spark, path, lines=True))


# whole documents of some thousand features, which several tasks share
@_query("read_geojson_documents", _POINTS)
def _(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "documents-geojson")
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct("species", F.col("yr").alias("year"), F.lit('a "}" in a string').alias("note")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
    ))
    held = v.occurrence.groupBy(F.expr("occ_id div 4000").alias("doc")).agg(F.collect_list(feature).alias("features"))
    text = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join("features", ",\n "), F.lit("]}"))
    held.select("doc", text.alias("value")).write.partitionBy("doc").text(path)
    return _presences(files.read_points_geojson(v.spark, path))


@_query("read_shp_zip", _POINTS)
def _(v: Views) -> DataFrame:
    bundles = zipped_shapefiles(v.occurrence.select("occ_id", "species", "yr", "lon", "lat"))
    return _presences(shapefiles.decode_bundles(bundles))


@_query(
    "read_background",
    """select cast(mx as double) as "NDVI", cast(my as double) as elevation,
  round(lon, 6) as lon, round(lat, 6) as lat from {occurrence}""",
)
def _(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "background")
    shape = F.format_string("{'type': 'Point', 'coordinates': [%s, %s]}", F.col("lon").cast("string"), F.col("lat").cast("string"))
    v.occurrence.select(
        F.col("mx").alias("NDVI"), F.col("my").alias("elevation"), shape.alias(".geo")
    ).write.option("header", "true").option("escape", '"').csv(path)
    out = files.read_background(v.spark, path, ["NDVI", "elevation"])
    return out.select("NDVI", "elevation", _r("lon"), _r("lat"))


@_query(
    "normalise",
    """select species, cast(try_cast(case when occ_id % 3 = 0 then '2020-01-01' else cast(yr as string) end as double) as bigint) as year,
  round(lon, 6) as lon, round(lat, 6) as lat from {occurrence}""",
)
def _(v: Views) -> DataFrame:
    odd = v.occurrence.select(
        F.col("species").alias("Taxon"),
        F.when(F.col("occ_id") % 3 == 0, F.lit("2020-01-01")).otherwise(F.col("yr").cast("string")).alias("Date"),
        F.col("lon").cast("string").alias("X"),
        F.col("lat").cast("string").alias("Y"),
        "basis",
    )
    return _presences(files.normalise(odd))


@_query(
    "crs_3857",
    """select occ_id, round(radians(lon)*6378137.0, 3) as x,
  round(ln(tan(pi()/4 + radians(lat)/2))*6378137.0, 3) as y,
  round(lon, 6) as lon, round(lat, 6) as lat from {occurrence}""",
)
def _(v: Views) -> DataFrame:
    x, y = geo.to_web_mercator(F.col("lon"), F.col("lat"))
    projected = v.occurrence.select("occ_id", x.alias("x"), y.alias("y"))
    lon, lat = geo.to_wgs84(F.col("x"), F.col("y"), 3857)
    return projected.select("occ_id", _r("x", 3), _r("y", 3), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


# ---- regions --------------------------------------------------------------------------------


@_query("aoi_edges", "select cntr_code, nuts_name, x1, y1, x2, y2 from {boundary_edge}")
def _(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "boundaries")
    x0, y0 = F.col("x0"), F.col("y0")
    ring = F.array(
        F.array(x0 + 12.5, y0), F.array(x0 + 25, y0 + 3), F.array(x0 + 12.5, y0 + 6), F.array(x0, y0 + 3),
        F.array(x0 + 12.5, y0),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct(F.col("cntr_code").alias("CNTR_CODE"), F.col("nuts_name").alias("NUTS_NAME")).alias("properties"),
    )
    v.boundary.select(F.to_json(feature)).write.text(path)
    stored = regions.read_boundaries(v.spark, path, regions.COUNTY_LEVEL, lines=True)
    return regions.boundary_edges(stored).drop("level")


@_query(
    "region_options",
    "select distinct nuts_name from {boundary} where cntr_code = 'C3' order by nuts_name",
)
def _(v: Views) -> DataFrame:
    return regions.region_options(v.boundary, "C3")


@_query(
    "aoi_select",
    """select 'country' as chosen, nuts_name, x1, y1, x2, y2 from {boundary_edge} where cntr_code = 'C3'
union all
select 'county' as chosen, nuts_name, x1, y1, x2, y2 from {boundary_edge} where nuts_name = 'Supplier#000000007'""",
)
def _(v: Views) -> DataFrame:
    edges = v.boundary_edge
    country = regions.select_area(edges, edges, "C3").withColumn("chosen", F.lit("country"))
    county = regions.select_area(edges, edges, "C3", "Supplier#000000007").withColumn("chosen", F.lit("county"))
    return country.unionByName(county).drop("cntr_code")


_CLIP = """select occ_id, nuts_name from {occurrence} join {edge}
  on (y1>my)<>(y2>my) and mx < (x2-x1)*(my-y1)/(y2-y1)+x1
group by occ_id, nuts_name having count(*)%2=1"""


def _clipped(v: Views) -> DataFrame:
    return clip(v.occurrence, v.edge, "mx", "my", "nuts_name", tile=100.0)


@_query("clip_aoi", _CLIP)
def _(v: Views) -> DataFrame:
    return _clipped(v).select("occ_id", "nuts_name")


# decimal coordinates and tiles that no power of two divides
_CLIP_DECIMAL = """
with p as (select occ_id, cast(mx as double) / 1000 as x, cast(my as double) / 1000 as y from {occurrence}),
e as (select nuts_name, x1 / 1000 as x1, y1 / 1000 as y1, x2 / 1000 as x2, y2 / 1000 as y2 from {edge})
select occ_id, nuts_name, tile from p join e on (y1>y)<>(y2>y) and x < (x2-x1)*(y-y1)/(y2-y1)+x1,
  (values (0.05), (0.07)) as t(tile)
group by occ_id, nuts_name, tile having count(*)%2=1"""


@_query("clip_decimal", _CLIP_DECIMAL.replace("tile from", "cast(tile as double) as tile from"))
def _(v: Views) -> DataFrame:
    points = v.occurrence.selectExpr("occ_id", "cast(mx as double) / 1000 as x", "cast(my as double) / 1000 as y")
    edges = v.edge.select("nuts_name", *((F.col(c) / 1000).alias(c) for c in ("x1", "y1", "x2", "y2")))
    parts = [
        clip(points, edges, "x", "y", "nuts_name", tile=tile).select("occ_id", "nuts_name", F.lit(tile).alias("tile"))
        for tile in (0.05, 0.07)
    ]
    return parts[0].unionByName(parts[1])


# an area whose parts overlap: every county, and the same counties moved by a quarter of their width
@_query(
    "clip_overlap",
    """
with e as (select nuts_name, x1, y1, x2, y2 from {boundary_edge}
  union all select nuts_name || '/moved', x1 + 6, y1, x2 + 6, y2 from {boundary_edge})
select distinct cx, cy from (
  select pixel_id, cx, cy, nuts_name from {pixel} join e
    on (y1>cy+0.5)<>(y2>cy+0.5) and cx+0.5 < (x2-x1)*((cy+0.5)-y1)/(y2-y1)+x1
  group by pixel_id, cx, cy, nuts_name having count(*)%2=1)""",
)
def _(v: Views) -> DataFrame:
    edges = v.boundary_edge.select("nuts_name", "x1", "y1", "x2", "y2")
    moved = edges.selectExpr("nuts_name || '/moved' as nuts_name", "x1 + 6 as x1", "y1", "x2 + 6 as x2", "y2")
    area = index_area(pipeline.one_area(edges.unionByName(moved)), pipeline.AREA, 4.0)
    return pipeline.cells_inside(v.pixel, area, 1.0).select("cx", "cy")


_CLIP_PIXELS = """select pixel_id, nuts_name from {pixel} join {boundary_edge}
  on (y1>cy+0.5)<>(y2>cy+0.5) and cx+0.5 < (x2-x1)*((cy+0.5)-y1)/(y2-y1)+x1
group by pixel_id, nuts_name having count(*)%2=1"""


def _clipped_pixels(v: Views) -> DataFrame:
    return surfaces.clip_cells(v.pixel, v.boundary_edge, 1.0, "nuts_name", tile=4.0)


@_query("clip_cells", _CLIP_PIXELS)
def _(v: Views) -> DataFrame:
    return _clipped_pixels(v).select("pixel_id", "nuts_name")


# ---- layers ---------------------------------------------------------------------------------

_LONG = {"elevation": "elevation", "aspect": "aspect", "CHM": "chm", "soil_ph": "phh2o", "NDVI": "score"}


def _long_layers(v: Views) -> DataFrame:
    named = v.pixel.select("cx", "cy", *[F.col(c).alias(n) for n, c in _LONG.items()])
    return named.unpivot(["cx", "cy"], list(_LONG), "layer", "value")


@_query(
    "layers_by_category",
    """with n as (select count(*) as n from {pixel})
select cast(0 as bigint) as category_position, 'Terrain' as category, 'elevation,aspect' as layers, cast(0 as bigint) as n_temporal, cast(2*n as bigint) as pixels from n
union all select 1, 'Vegetation', 'NDVI,CHM', 1, 2*n from n
union all select 5, 'Soil Properties', 'soil_ph', 0, n from n""",
)
def _(v: Views) -> DataFrame:
    out = catalogue.layers_by_category(_long_layers(v))
    return out.withColumn("category_position", F.col("category_position").cast("long"))


@_query(
    "watermask",
    "select cx, cy, case when elevation > 0 then phh2o end as phh2o from {pixel}",
)
def _(v: Views) -> DataFrame:
    return v.pixel.select("cx", "cy", surface.on_land(F.col("phh2o"), F.col("elevation")).alias("phh2o"))


@_query(
    "stack",
    """select cx, cy, elevation, aspect, chm as "CHM", phh2o as soil_ph, score as "NDVI" from {pixel}""",
)
def _(v: Views) -> DataFrame:
    return grid.stack_layers(_long_layers(v), list(_LONG))


@_query(
    "custom_layer",
    """select cx, cy, elevation, canopy from {pixel} left join
  (select l_orderkey as pixel_id, max(l_quantity) as canopy from {lineitem} group by l_orderkey) a using (pixel_id)""",
)
def _(v: Views) -> DataFrame:
    asset = v.lineitem.groupBy(
        (F.col("l_orderkey") % 250).alias("cx"), F.floor(F.col("l_orderkey") / 250).alias("cy")
    ).agg(F.max("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"))
    return grid.add_custom_layer(v.pixel.select("cx", "cy", "elevation"), asset, None, "canopy")


@_query(
    "regrid",
    """with t as (select distinct cast(floor((2*cx+1)*300/2000) as bigint) as tx,
    cast(floor((2*cy+1)*300/2000) as bigint) as ty from {pixel})
select tx as cx, ty as cy, elevation from t
join {pixel} p on p.cx = cast(floor((2*tx+1)*1000/600) as bigint) and p.cy = cast(floor((2*ty+1)*1000/600) as bigint)""",
)
def _(v: Views) -> DataFrame:
    return grid.regrid(v.pixel.select("cx", "cy", "elevation"), 300, 1000)


@_query(
    "regrid_mean",
    """select cast(floor((2*cx+1)*300/2000) as bigint) as cx, cast(floor((2*cy+1)*300/2000) as bigint) as cy,
  round(avg(elevation), 6) as elevation from {pixel} group by 1, 2""",
)
def _(v: Views) -> DataFrame:
    return grid.regrid_mean(v.pixel, 300, 1000, ["elevation"]).select("cx", "cy", _r("elevation"))


@_query(
    "terrain",
    """with g as (select p.cx, p.cy, (e.elevation-w.elevation)/cast(200 as double) as dx,
    (n.elevation-s.elevation)/cast(200 as double) as dy from {pixel} p
  left join {pixel} w on w.cx=p.cx-1 and w.cy=p.cy left join {pixel} e on e.cx=p.cx+1 and e.cy=p.cy
  left join {pixel} s on s.cx=p.cx and s.cy=p.cy-1 left join {pixel} n on n.cx=p.cx and n.cy=p.cy+1),
a as (select cx, cy, degrees(atan(sqrt(dx*dx+dy*dy))) as slope, degrees(atan2(0.0-dx, 0.0-dy)) as az from g)
select cx, cy, round(slope, 6) as slope, round(case when slope is null then null when az < 0 then az + 360 else az end, 6) as aspect from a""",
)
def _(v: Views) -> DataFrame:
    out = grid.terrain(v.pixel, spacing=100.0)
    return out.select("cx", "cy", _r("slope"), _r("aspect"))


@_query(
    "exposure",
    "select cx, cy, round(cos(radians(aspect)), 6) as northness, round(sin(radians(aspect)), 6) as eastness from {pixel}",
)
def _(v: Views) -> DataFrame:
    a = F.col("aspect")
    return v.pixel.select(
        "cx", "cy", F.round(surface.northness(a), 6).alias("northness"), F.round(surface.eastness(a), 6).alias("eastness")
    )


@_query("trees", "select cx, cy, case when chm >= 1 then chm end as trees from {pixel}")
def _(v: Views) -> DataFrame:
    return v.pixel.select("cx", "cy", surface.trees(F.col("chm")).alias("trees"))


@_query(
    "soil_scale",
    "select cx, cy, round(phh2o*0.1, 3) as soil_ph, round(bdod*0.01, 3) as soil_bdod from {pixel}",
)
def _(v: Views) -> DataFrame:
    scaled = surface.scale_soil(v.pixel, {"soil_ph": "phh2o", "soil_bdod": "bdod"})
    return scaled.select(
        "cx", "cy", F.round(F.col("soil_ph").cast("double"), 3).alias("soil_ph"),
        F.round(F.col("soil_bdod").cast("double"), 3).alias("soil_bdod"),
    )


@_query(
    "whatif_shift",
    "select cx, cy, elevation + 250 as elevation, aspect, phh2o from {pixel}",
)
def _(v: Views) -> DataFrame:
    stack = v.pixel.select("cx", "cy", "elevation", "aspect", "phh2o")
    return surface.shift_layers(stack, {"elevation": 250, "aspect": "none", "missing": 3})


# ---- scenes and composites ------------------------------------------------------------------

_CLEAR = "(qa60 & 1024) = 0 and (qa60 & 2048) = 0"


@_query(
    "cloud_mask",
    f"""select scene_id, line_no, ts, case when {_CLEAR} then b3/10000 end as b3,
  case when {_CLEAR} then b5/10000 end as b5 from {{scene}}""",
)
def _(v: Views) -> DataFrame:
    return spectral.mask_clouds(v.scene, ["b3", "b5"]).select("scene_id", "line_no", "ts", "b3", "b5")


@_query("nari", "select scene_id, line_no, ts, round((1/b3-1/b5)/(1/b3+1/b5), 6) as nari from {scene}")
def _(v: Views) -> DataFrame:
    value = spectral.nari(F.col("b3"), F.col("b5"))
    return v.scene.select("scene_id", "line_no", "ts", F.round(value, 6).alias("nari"))


@_query("ncri", "select scene_id, line_no, ts, round((1/b5-1/b7)/(1/b5+1/b7), 6) as ncri from {scene}")
def _(v: Views) -> DataFrame:
    value = spectral.ncri(F.col("b5"), F.col("b7"))
    return v.scene.select("scene_id", "line_no", "ts", F.round(value, 6).alias("ncri"))


@_query(
    "ndvi",
    f"""select cx, cy, round(avg((b7-b3)/(b7+b3)), 6) as ndvi from {{scene}}
where {_CLEAR} and cloudy_pct < 65 and ts >= timestamp '1998-01-01' and ts < timestamp '1999-01-01' group by cx, cy""",
)
def _(v: Views) -> DataFrame:
    return composites.ndvi_mean(v.scene, 1998, "b7", "b3").select("cx", "cy", _r("ndvi"))


def _median_sql(index: str, a: str, b: str) -> str:
    return f"""select cx, cy, round(median((1/{a}-1/{b})/(1/{a}+1/{b})), 6) as {index} from {{scene}}
where {_CLEAR} and cloudy_pct < 65 and ts >= timestamp '1998-09-01' and ts < timestamp '1998-11-01' group by cx, cy"""


@_query("nari_median", _median_sql("nari", "b3", "b5"))
def _(v: Views) -> DataFrame:
    return composites.index_median(v.scene, "nari", 1998).select("cx", "cy", _r("nari"))


@_query("ncri_median", _median_sql("ncri", "b5", "b7"))
def _(v: Views) -> DataFrame:
    return composites.index_median(v.scene, "ncri", 1998).select("cx", "cy", _r("ncri"))


@_query(
    "annual_mean",
    """select cx, cy, cast(year(ts) as bigint) as yr, round(avg((1/b3-1/b5)/(1/b3+1/b5)), 6) as nari,
  round(avg((1/b5-1/b7)/(1/b5+1/b7)), 6) as ncri from {scene} group by 1, 2, 3""",
)
def _(v: Views) -> DataFrame:
    b3, b5, b7 = F.col("b3"), F.col("b5"), F.col("b7")
    indexed = v.scene.select(
        "cx", "cy", "ts", spectral.nari(b3, b5).alias("nari"), spectral.ncri(b5, b7).alias("ncri")
    )
    out = composites.annual_mean(indexed, ["nari", "ncri"])
    return out.select("cx", "cy", "yr", _r("nari"), _r("ncri"))


_SCENE_ORDER = ["ts", "scene_id", "line_no", "b5"]


@_query(
    "mosaic",
    "select cx, cy, arg_max(b5, row(ts, scene_id, line_no, b5)) as b5 from {scene} group by cx, cy",
)
def _(v: Views) -> DataFrame:
    return composites.mosaic(v.scene, ["b5"], _SCENE_ORDER)


@_query(
    "first_composite",
    "select cx, cy, arg_min(b5, row(ts, scene_id, line_no, b5)) as b5 from {scene} group by cx, cy",
)
def _(v: Views) -> DataFrame:
    return composites.mosaic(v.scene, ["b5"], _SCENE_ORDER, on_top="first")


_DAILY = """daily as (select cx, cy, d, sum(snowfall_sum) as snowfall, avg(snow_cover) as cover from {climate} group by cx, cy, d),
asked as (select distinct cx, cy, d from {climate})"""


@_query(
    "snowfall_4d",
    f"""with {_DAILY}, s as (select a.cx, a.cy, a.d, sum(b.snowfall)*1000 as snowfall from asked a
  join daily b on a.cx=b.cx and a.cy=b.cy and b.d >= a.d - 4 and b.d < a.d group by a.cx, a.cy, a.d)
select event_id, round(snowfall, 3) as snowfall from {{climate}} join s using (cx, cy, d)""",
)
def _(v: Views) -> DataFrame:
    points = v.climate.select("event_id", "cx", "cy", "d")
    return composites.snowfall_4d(points, v.climate).select("event_id", _r("snowfall", 3))


@_query(
    "snowcover_4d",
    f"""with {_DAILY}, s as (select a.cx, a.cy, a.d, avg(b.cover) as snowcover from asked a
  join daily b on a.cx=b.cx and a.cy=b.cy and b.d >= a.d - 4 and b.d < a.d group by a.cx, a.cy, a.d)
select event_id, round(snowcover, 6) as snowcover from {{climate}} join s using (cx, cy, d)""",
)
def _(v: Views) -> DataFrame:
    points = v.climate.select("event_id", "cx", "cy", "d")
    return composites.snowcover_4d(points, v.climate).select("event_id", _r("snowcover"))


@_query(
    "static_layers",
    """with g as (select p.cx, p.cy, p.elevation, p.aspect as b1, p.chm, p.phh2o, (e.elevation-w.elevation)/cast(200 as double) as dx,
    (n.elevation-s.elevation)/cast(200 as double) as dy from {pixel} p
  left join {pixel} w on w.cx=p.cx-1 and w.cy=p.cy left join {pixel} e on e.cx=p.cx+1 and e.cy=p.cy
  left join {pixel} s on s.cx=p.cx and s.cy=p.cy-1 left join {pixel} n on n.cx=p.cx and n.cy=p.cy+1),
a as (select *, degrees(atan(sqrt(dx*dx+dy*dy))) as sl, atan2(0.0-dx, 0.0-dy) as az from g)
select cx, cy, elevation, round(sl, 6) as slope, round(case when sl is not null then cos(az) end, 6) as northness,
  round(case when sl is not null then sin(az) end, 6) as eastness, chm as "CHM", case when chm >= 1 then chm end as "Trees",
  round(phh2o*0.1, 3) as soil_ph, b1 from a""",
)
def _(v: Views) -> DataFrame:
    p = v.pixel
    out = layers.static_layers(
        dem=p,
        canopy=p.select("cx", "cy", F.col("chm").alias("height"), F.col("pixel_id").alias("ts")),
        soil=p.select("cx", "cy", F.col("phh2o").alias("soil_ph")),
        rasters={"b1": p.select("cx", "cy", "aspect")},
        spacing=100.0,
    )
    return out.select(
        "cx", "cy", "elevation", _r("slope"), _r("northness"), _r("eastness"), "CHM", "Trees", _r("soil_ph", 3), "b1"
    )


@_query(
    "yearly_layers",
    f"""with n as (select *, cast(year(ts) as bigint) as yr, (1/b3-1/b5)/(1/b3+1/b5) as nari, (1/b5-1/b7)/(1/b5+1/b7) as ncri from {{scene}}),
y as (select cx, cy, yr, avg((b7-b3)/(b7+b3)) as ndvi from n where yr in (1997, 1999) group by 1, 2, 3),
m as (select cx, cy, yr, median(nari) as nari, median(ncri) as ncri from n
  where {_CLEAR} and cloudy_pct < 65 and yr in (1997, 1999) and month(ts) in (9, 10) group by 1, 2, 3)
select cx, cy, yr, round(ndvi, 6) as "NDVI", round(nari, 6) as "NARI", round(ncri, 6) as "NCRI" from y left join m using (cx, cy, yr)""",
)
def _(v: Views) -> DataFrame:
    greenness = v.scene.select("ts", "cx", "cy", spectral.ndvi(F.col("b7"), F.col("b3")).alias("NDVI"))
    out = layers.yearly_layers([1997, 1999], greenness=greenness, scenes=v.scene)
    return out.select("cx", "cy", "yr", _r("NDVI"), _r("NARI"), _r("NCRI"))


# ---- samples --------------------------------------------------------------------------------

_STATIC = ["elevation", "aspect", "chm", "phh2o"]
_HUMAN = "basis = 'HUMAN_OBSERVATION'"


@_query(
    "sample_static",
    """select occ_id, elevation, aspect, chm, phh2o from {occurrence} join {layer_static} using (cx, cy)
where chm is not null""",
)
def _(v: Views) -> DataFrame:
    return sampling.sample_layers(v.occurrence, v.layer_static, _STATIC).select("occ_id", *_STATIC)


# the layers are stored by cell and stay where they are
@_query("sample_stored", """select occ_id, elevation, phh2o from {sighting} join {pixel} using (cx, cy)""")
def _(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "layers")
    name = "layers_" + path.rsplit("-", 1)[-1]
    save_layers(v.pixel.select("cx", "cy", "elevation", "phh2o"), name, int(v.spark.conf.get("spark.sql.shuffle.partitions")), path)
    features = ["elevation", "phh2o"]
    return sampling.sample_stored(v.sighting, v.spark.table(name), features).select("occ_id", *features)


@_query(
    "sample_temporal",
    f"""select occ_id, yr, ndvi, elevation from {{occurrence}} join {{layer_year}} using (cx, cy, yr)
join {{layer_static}} using (cx, cy) where {_HUMAN} and ndvi is not null""",
)
def _(v: Views) -> DataFrame:
    out = sampling.sample_by_year(
        v.occurrence.where(_HUMAN), v.layer_static, v.layer_year, ["ndvi"], ["elevation"]
    )
    return out.select("occ_id", "yr", "ndvi", "elevation")


@_query(
    "excluded_count",
    f"""with p as (select * from {{occurrence}} where {_HUMAN}),
s as (select count(*) as n from p join {{layer_year}} using (cx, cy, yr) where ndvi is not null)
select (select count(*) from p) as n_presence, n as n_sampled, (select count(*) from p) - n as excluded from s""",
)
def _(v: Views) -> DataFrame:
    return sampling.excluded_count(v.occurrence.where(_HUMAN), None, v.layer_year, ["ndvi"])


@_query(
    "background",
    """select cx, cy, elevation from {pixel} order by md5(concat_ws('|', cx, cy, '42')), cx, cy limit 500""",
)
def _(v: Views) -> DataFrame:
    return sampling.background_cells(v.pixel.select("cx", "cy", "elevation"), 500)


@_query(
    "presabs",
    """select occ_id, elevation as "Site_Elevation", aspect, 1 as "PresAbs" from {sighting} join {pixel} using (cx, cy)
union all select pixel_id, elevation, aspect, 0 from {pixel}""",
)
def _(v: Views) -> DataFrame:
    named = v.pixel.withColumnRenamed("elevation", "Site Elevation")
    features = ["Site Elevation", "aspect"]
    presence = sampling.sample_layers(v.sighting, named, features)
    return sampling.presence_background(
        presence, named.withColumnRenamed("pixel_id", "occ_id"), features, ["occ_id"]
    )


@_query(
    "thin_per_cell",
    f"""with c as ({_CLIP}), r as (select occ_id, nuts_name, species, cx, cy,
  row_number() over (partition by species, cx, cy order by occ_id, nuts_name) as rn from c join {{occurrence}} using (occ_id))
select occ_id, nuts_name, species, cx, cy from r where rn = 1""",
)
def _(v: Views) -> DataFrame:
    inside = _clipped(v).select("occ_id", "nuts_name", "species", "cx", "cy")
    return sampling.thin(inside, "occ_id", by=["species"])


_U = "cast(('0x' || substr(md5(cast({0} as varchar)),1,8)) as bigint)/4294967296.0"


@_query(
    "split",
    f"""select o_orderkey, round({_U.format("o_orderkey")}, 6) as random, {_U.format("o_orderkey")} < 0.75 as is_train from {{orders}}""",
)
def _(v: Views) -> DataFrame:
    return sampling.with_split(v.orders.select("o_orderkey"), ["o_orderkey"], 0.75).select(
        "o_orderkey", _r("random"), "is_train"
    )


@_query(
    "eval_sample",
    f"""select vec_id from {{embeddings}} where label = 0 order by {_U.format("vec_id")}, vec_id limit 100""",
)
def _(v: Views) -> DataFrame:
    return sampling.evaluation_sample(v.embeddings.where("label = 0"), ["vec_id"], 100).select("vec_id")


@_query(
    "balanced",
    """with s as (select o_orderkey, case when o_orderstatus = 'F' then 1 else 0 end as "PresAbs" from {orders}),
r as (select *, row_number() over (partition by "PresAbs" order by md5(o_orderkey || '|42'), o_orderkey) as rn from s)
select o_orderkey, "PresAbs" from r where "PresAbs" = 1 or rn <= (select count(*) from s where "PresAbs" = 1)""",
)
def _(v: Views) -> DataFrame:
    sample = v.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("PresAbs"))
    return sampling.balanced(sample, ["o_orderkey"])


# ---- embeddings -----------------------------------------------------------------------------

_SCORED = """p as (select unnest(embedding)::double x, generate_subscripts(embedding,1) i from {embeddings} where label=0),
m as (select i, avg(x) m from p group by 1),
e as (select vec_id, label, unnest(embedding)::double x, generate_subscripts(embedding,1) i from {embeddings}),
s as (select vec_id, any_value(label) as label, sum(x*m)/greatest(sqrt(sum(x*x)),1e-9) as score from e join m using(i) group by 1)"""
_AUC = """g as (select round(score, 9) as s, sum(y) p, sum(1-y) n from t group by 1),
c as (select *, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding),0) cn from g)
select round(sum(p*(cn+n/2.0))/(sum(p)*sum(n)), 6) as roc_auc from c"""


@_query("embedding_year", "select vec_id, cx, cy, year from {mosaic} where year = 2023")
def _(v: Views) -> DataFrame:
    return surfaces.embedding_for_year(v.mosaic, 2025).select("vec_id", "cx", "cy", "year")


@_query(
    "mean_embedding",
    """with p as (select unnest(embedding)::double x, generate_subscripts(embedding,1) i from {embeddings} where label=0)
select cast(i - 1 as bigint) as band, round(avg(x), 6) as mean from p group by i""",
)
def _(v: Views) -> DataFrame:
    mean = vectors.mean_vector(v.embeddings.where("label = 0"))
    return mean.select(F.posexplode("mean").alias("band", "mean")).select(
        F.col("band").cast("long").alias("band"), _r("mean")
    )


def _similarity(v: Views) -> DataFrame:
    return embedding.score_by_similarity(v.embeddings, v.embeddings.where("label = 0"))


@_query("embedding_score", f"with {_SCORED} select vec_id, label, round(score, 6) as score from s")
def _(v: Views) -> DataFrame:
    return _similarity(v).select("vec_id", "label", _r("score"))


@_query("auc", f"with {_SCORED}, t as (select score, case when label = 0 then 1 else 0 end as y from s), {_AUC}")
def _(v: Views) -> DataFrame:
    labelled = _similarity(v).select(
        F.round("score", 9).alias("score"), F.when(F.col("label") == 0, 1).otherwise(0).alias("PresAbs")
    )
    return metrics.roc_auc(labelled).select(_r("roc_auc"))


@_query(
    "embedding_pipeline",
    f"""with {_SCORED}, k as (select count(*) as k from s where label = 0),
a as (select score, row_number() over (order by {_U.format("vec_id")}, vec_id) as rn from s where label = 0),
b as (select score, row_number() over (order by md5(vec_id || '|42'), vec_id) as rn from s),
t as (select score, 1 as y from a, k where rn <= k union all select score, 0 from b, k where rn <= k), {_AUC}""",
)
def _(v: Views) -> DataFrame:
    scored = _similarity(v).withColumn("score", F.round("score", 9)).drop("embedding")
    presences = sampling.evaluation_sample(scored.where("label = 0"), ["vec_id"]).drop("random")
    n = presences.count()
    background = sampling.background_cells(scored, n, keys=["vec_id"])
    return metrics.roc_auc(embedding.evaluation_rows(presences, background)).select(_r("roc_auc"))


# the whole run: presences sampled on the mosaic of a year, background, AUC, surface clipped to the area
_MOSAIC_STEP, _MOSAIC_YEAR = 10.0, 2021


def _embedding_run(v: Views) -> pipeline.Run:
    config = RunConfig(model_type="embedding", year_start=_MOSAIC_YEAR)
    return pipeline.run_embedding(
        config, v.sighting, v.boundary_edge, v.mosaic, _MOSAIC_STEP, tile=40.0, projected=True
    )


@_query(
    "embedding_run",
    f"""with y as (select cx, cy, embedding from {{mosaic}} where year = {_MOSAIC_YEAR}),
a as (select embedding from {{sighting}} s join y on y.cx = floor(s.lon/10) and y.cy = floor(s.lat/10)),
p as (select unnest(embedding)::double x, generate_subscripts(embedding,1) i from a),
m as (select i, avg(x) m from p group by 1),
e as (select cx, cy, unnest(embedding)::double x, generate_subscripts(embedding,1) i from y),
s as (select cx, cy, sum(x*m)/greatest(sqrt(sum(x*x)),1e-9) as score from e join m using(i) group by 1, 2),
c as (select cx, cy from y join {{boundary_edge}}
  on (y1>(cy+0.5)*10)<>(y2>(cy+0.5)*10) and (cx+0.5)*10 < (x2-x1)*((cy+0.5)*10-y1)/(y2-y1)+x1
  group by cx, cy, cntr_code, nuts_name having count(*)%2=1)
select cx, cy, round(score, 6) as score from s join (select distinct cx, cy from c) using (cx, cy)""",
)
def _(v: Views) -> DataFrame:
    return _embedding_run(v).surface.select("cx", "cy", _r("score"))


# background points are drawn by hash in the area, so there is no SQL for it
@_query("embedding_run_auc")
def _(v: Views) -> DataFrame:
    return _embedding_run(v).results


# ---- quality and summaries ------------------------------------------------------------------

_JUDGED = """select case when o_orderstatus = 'F' then 1 else 0 end as y,
  case when cast(o_custkey % 1000 as double)/1000 >= 0.5 then 1 else 0 end as c from {orders}"""


def _judged(v: Views) -> DataFrame:
    scored = v.orders.select(
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("PresAbs"),
        ((F.col("o_custkey") % 1000) / 1000).alias("score"),
    )
    return metrics.cut_probability(scored)


@_query("accuracy", f"select round(avg(case when y = c then 1.0 else 0.0 end), 6) as overall_accuracy, count(*) as n from ({_JUDGED})")
def _(v: Views) -> DataFrame:
    return metrics.accuracy(_judged(v)).select(_r("overall_accuracy"), "n")


@_query("error_matrix", f"""select y as "PresAbs", c as classification, count(*) as n from ({_JUDGED}) group by 1, 2""")
def _(v: Views) -> DataFrame:
    return metrics.error_matrix(_judged(v))


@_query(
    "importance_rank",
    """with m as (select avg(elevation) as elevation, avg(slope) as slope, avg(aspect) as aspect from {run_result})
select 'elevation' as feature, round(elevation, 8) as importance from m
union all select 'slope', round(slope, 8) from m union all select 'aspect', round(aspect, 8) from m""",
)
def _(v: Views) -> DataFrame:
    return metrics.importance_rank(v.run_result).select("feature", _r("importance", 8))


@_query(
    "metric_flags",
    """select round(avg(roc_auc), 8) as roc_auc, round(avg(overall_accuracy), 8) as overall_accuracy,
  case when max(excluded_presence_count) > 0 then max(excluded_presence_count) end as excluded_presence_count,
  avg(roc_auc) < 0.7 as roc_auc_low, avg(overall_accuracy) < 0.7 as overall_accuracy_low from {run_result}""",
)
def _(v: Views) -> DataFrame:
    return metrics.metric_flags(v.run_result).select(
        _r("roc_auc", 8), _r("overall_accuracy", 8), "excluded_presence_count", "roc_auc_low", "overall_accuracy_low"
    )


_FEATURES = ["elevation", "aspect", "chm", "phh2o"]
_RANKED = ", ".join(
    f"rank() over (order by {f}) + (count(*) over (partition by {f})-1)/cast(2 as double) as {f}" for f in _FEATURES
)
_PAIRS = [(a, b) for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1 :]]


@_query(
    "spearman",
    f"with r as (select {_RANKED} from {{pixel}} where chm is not null) "
    + " union all ".join(
        f"select '{a}' as feature_a, '{b}' as feature_b, round(corr({a}, {b}), 6) as rho from r" for a, b in _PAIRS
    ),
)
def _(v: Views) -> DataFrame:
    out = correlation.spearman(v.pixel, ["pixel_id"], _FEATURES)
    return out.select("feature_a", "feature_b", _r("rho"))


# ground that a sensor does not see: each feature is missing on rows of its own
_GAPS = {
    "elevation": "phh2o is null or phh2o < 70",
    "aspect": "bdod < 120",
    "chm": "chm is not null",
    "phh2o": "elevation >= 500",
}
_GAPPY = "select pixel_id, " + ", ".join(f"case when {seen} then {f} end as {f}" for f, seen in _GAPS.items())


def _complete_pair(a: str, b: str) -> str:
    ranks = ", ".join(
        f"rank() over (order by {f}) + (count(*) over (partition by {f})-1)/cast(2 as double) as r{i}"
        for i, f in enumerate((a, b))
    )
    return (
        f"select '{a}' as feature_a, '{b}' as feature_b, round(corr(r0, r1), 6) as rho "
        f"from (select {ranks} from g where {a} is not null and {b} is not null)"
    )


@_query(
    "spearman_pairwise",
    f"with g as ({_GAPPY} from {{pixel}}) " + " union all ".join(_complete_pair(a, b) for a, b in _PAIRS),
)
def _(v: Views) -> DataFrame:
    gappy = v.pixel.select(
        "pixel_id", *[F.expr(f"case when {seen} then {f} end").alias(f) for f, seen in _GAPS.items()]
    )
    out = correlation.spearman(gappy, ["pixel_id"], _FEATURES, pairwise=True)
    return out.select("feature_a", "feature_b", _r("rho"))


@_query("prune_features")
def _(v: Views) -> DataFrame:
    features = ["b3", "b5", "b7", "cloudy_pct"]
    keyed = v.scene.groupBy("scene_id").agg(*[F.sum(f).alias(f) for f in features])
    return correlation.prune_features(keyed, ["scene_id"], features)


@_query("obs_years", "select distinct yr from {occurrence} where yr is not null")
def _(v: Views) -> DataFrame:
    return zonal.observation_years(v.occurrence)


@_query(
    "bounds",
    """select round(min(lon), 6) as west, round(max(lon), 6) as east, round(min(lat), 6) as south, round(max(lat), 6) as north,
  round((min(lon)+max(lon))/2, 6) as center_x, round((min(lat)+max(lat))/2, 6) as center_y from {occurrence}""",
)
def _(v: Views) -> DataFrame:
    out = zonal.bounds(v.occurrence)
    return out.select(*[_r(c) for c in out.columns])


@_query(
    "threshold_p10",
    """select round(quantile_cont(score, 0.1), 6) as threshold from {sighting} join {pixel} using (cx, cy) where score is not null""",
)
def _(v: Views) -> DataFrame:
    scored = sampling.sample_layers(v.sighting, v.pixel, ["score"])
    return zonal.suitability_threshold(scored).select(_r("threshold"))


@_query(
    "suitable_share",
    f"""with c as ({_CLIP_PIXELS}) select nuts_name, round(avg(case when score is null then null when score >= 0.4 then 1.0 else 0.0 end), 6) as suitable_share
from c join {{pixel}} using (pixel_id) group by nuts_name""",
)
def _(v: Views) -> DataFrame:
    return zonal.suitable_share(_clipped_pixels(v), 0.4, ["nuts_name"]).select("nuts_name", _r("suitable_share"))


@_query(
    "zonal",
    f"""with c as ({_CLIP_PIXELS}) select nuts_name, median(chm) as median_chm,
  round(avg(case when score >= 0.4 then elevation end), 6) as mean_elevation
from c join {{pixel}} using (pixel_id) group by nuts_name""",
)
def _(v: Views) -> DataFrame:
    inside = _clipped_pixels(v).persist()
    medians = zonal.zonal_median(inside, "chm", ["nuts_name"])
    means = zonal.zonal_mean_where(inside, "elevation", 0.4, ["nuts_name"])
    return means.join(medians, ["nuts_name"], "left").select("nuts_name", "median_chm", _r("mean_elevation"))


@_query(
    "export_surface",
    """with t as (select distinct cast(floor((2*cx+1)*100/600) as bigint) as cx, cast(floor((2*cy+1)*100/600) as bigint) as cy from {pixel}),
g as (select t.cx, t.cy, p.score from t join {pixel} p on p.cx = 3*t.cx+1 and p.cy = 3*t.cy+1),
c as (select cx, cy, nuts_name from g join {boundary_edge}
  on (y1>(cy+0.5)*3)<>(y2>(cy+0.5)*3) and (cx+0.5)*3 < (x2-x1)*((cy+0.5)*3-y1)/(y2-y1)+x1
  group by cx, cy, nuts_name having count(*)%2=1)
select cx, cy, coalesce(score, 0) as score, cast(floor(cx/1024) as bigint) as tile_x, cast(floor(cy/1024) as bigint) as tile_y
from c join g using (cx, cy)""",
)
def _(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "surface")
    edges = v.boundary_edge.withColumnRenamed("nuts_name", "region")
    surfaces.export_surface(v.pixel, path, 100, 300, edges, step=3.0)
    stored = v.spark.read.parquet(path)
    return stored.withColumns({c: F.col(c).cast("long") for c in ("tile_x", "tile_y")})


# ---- runs from their configuration ------------------------------------------------------------

# one unit of the raster is 100 m; the layers lie on grids of 30, 100 and 300 m, the mosaic on one of 1000 m
_CHOICES = {
    "species": "BUILDING", "country_code": "C1", "data_mode": "deepdive",
    "year_start": 1996, "year_end": 2000, "selected_layers": ("elevation", "bdod", "phh2o", "NDVI"),
}
_CHOSEN = """species = 'BUILDING' and countryCode = 'C1' and hasCoordinate
  and basisOfRecord = 'HUMAN_OBSERVATION' and year between 1996 and 2000"""


def _tables(v: Views) -> runs.Tables:
    return runs.Tables(
        records=v.survey, countries=v.country_edge, counties=v.country_edge,
        layers=(Layer(v.pixel.select("cx", "cy", "elevation"), 100), Layer(v.coarse, 300), Layer(v.fine, 30),
                Layer(pixel_years(v), 100)),
        mosaic=Layer(v.mosaic.select("cx", "cy", "year", "embedding"), 1000),
        datasets={"survey": v.survey.drop("key")}, metres_per_unit=100.0, projected=True,
    )


def _at(cell: str, target: int, source: int) -> str:
    """The source cell under the centre of a target cell."""
    return f"cast(floor((2*{cell}+1)*{target}/{2 * source}.0) as bigint)"


def _layers_sql(metres: int, cells: str, year: str, join: str) -> str:
    """Layer values for ``cells`` (cx, cy), the yearly ones of ``year``."""
    ndvi = f"case when (q.pixel_id + {year}) % 11 <> 0 then ((q.pixel_id*7 + {year}*13) % 200 - 100)/100.0 end"
    return f"""select s.*, q.elevation, c.bdod, f.phh2o, round({ndvi}, 6) as "NDVI" from {cells} s
{join} {{pixel}} q on q.cx = {_at("s.cx", metres, 100)} and q.cy = {_at("s.cy", metres, 100)}
{join} {{coarse}} c on c.cx = {_at("s.cx", metres, 300)} and c.cy = {_at("s.cy", metres, 300)}
{join} {{fine}} f on f.cx = {_at("s.cx", metres, 30)} and f.cy = {_at("s.cy", metres, 30)}"""


def _cells_sql(metres: int) -> str:
    """Cells of a grid, where the raster has any, with their centre in the chosen country."""
    unit = metres / 100
    return f"""select distinct t.cx, t.cy from
  (select distinct cast(floor((cx+0.5)/{unit}) as bigint) as cx, cast(floor((cy+0.5)/{unit}) as bigint) as cy from {{pixel}}) t
  join {{country_edge}} on cntr_code = 'C1' and (y1>(cy+0.5)*{unit})<>(y2>(cy+0.5)*{unit})
    and (cx+0.5)*{unit} < (x2-x1)*((cy+0.5)*{unit}-y1)/(y2-y1)+x1
  group by t.cx, t.cy, nuts_name having count(*)%2=1"""


def _register_run(metres: int) -> None:
    config = RunConfig(**_CHOICES, resolution=metres)
    features = config.selected_layers
    at = f"""select 'p' || key as sample_id, year, cast(floor(decimalLongitude*100/{metres}) as bigint) as cx,
  cast(floor(decimalLatitude*100/{metres}) as bigint) as cy from {{survey}} where {_CHOSEN}"""

    @_query(f"run_sample_{metres}", f"""select sample_id, cx, cy, elevation, bdod, phh2o, "NDVI"
from ({_layers_sql(metres, f"({at})", "s.year", "left join")})""")
    def _(v: Views) -> DataFrame:
        tables = _tables(v)
        found = runs.presences(config, tables)
        marked = pipeline.sampled_presences(config, found, runs.landscape(config, tables))
        return marked.withColumn("NDVI", F.round("NDVI", 6))

    cells = _cells_sql(metres)

    @_query(f"run_map_{metres}", f"""select cx, cy, elevation, bdod, phh2o, "NDVI"
from ({_layers_sql(metres, f"({cells})", str(config.year_start), "join")}) where "NDVI" is not null""")
    def _(v: Views) -> DataFrame:
        tables = _tables(v)
        area = index_area(pipeline.one_area(runs.area(config, tables)), pipeline.AREA, 4.0)
        land = runs.landscape(config, tables)
        inside = lambda cells: pipeline.cells_inside(cells, area, land.step)
        return land.map(features, config.year_start, inside).dropna().withColumn("NDVI", F.round("NDVI", 6))


for _metres in (30, 100, 300):
    _register_run(_metres)


# the county wins over its country
@_query(
    "run_county",
    """select cx, cy, elevation from {pixel} join {boundary_edge} on nuts_name = 'Supplier#000000004'
  and (y1>cy+0.5)<>(y2>cy+0.5) and cx+0.5 < (x2-x1)*(cy+0.5-y1)/(y2-y1)+x1
group by cx, cy, elevation having count(*)%2=1""",
)
def _(v: Views) -> DataFrame:
    config = RunConfig(**{**_CHOICES, "county_name": "Supplier#000000004", "selected_layers": ("elevation",)})
    tables = _tables(v)
    area = index_area(pipeline.one_area(runs.area(config, tables)), pipeline.AREA, 4.0)
    return runs.landscape(config, tables).map(["elevation"], 1996, lambda cells: pipeline.cells_inside(cells, area, 1.0))


# a whole run; its sample and map are compared above, trees and random background have no SQL
@_query("run_forest_300")
def _(v: Views) -> DataFrame:
    return runs.run(RunConfig(**_CHOICES, resolution=300), _tables(v), tile=4.0).results


# the records of an own dataset have no key: the sample is numbered by their content
@_query(
    "run_own",
    """select species, year as yr, decimalLongitude as lon, decimalLatitude as lat, cast(1 as bigint) as ids
from {survey} where lower(species) like '%build%' and year between 1996 and 2000""",
)
def _(v: Views) -> DataFrame:
    own = {"data_mode": "own", "dataset_key": "survey", "species": "Build"}
    found = runs.presences(RunConfig(**{**_CHOICES, **own}), _tables(v))
    return found.groupBy("occ_id", "species", "yr", "lon", "lat").agg(F.count("*").alias("ids")).drop("occ_id")


# an embedding run keeps to 30 m whatever its configuration says; the mosaic has cells of 1000 m
_MOSAIC_30 = f"""with y as (select cx, cy, embedding from {{mosaic}} where year = 2023),
a as (select embedding from (select cast(floor(decimalLongitude*100/30) as bigint) as cx, cast(floor(decimalLatitude*100/30) as bigint) as cy
    from {{survey}} where lower(species) like '%u%' and year between 1990 and 2000) s
  join y on y.cx = {_at("s.cx", 30, 1000)} and y.cy = {_at("s.cy", 30, 1000)}),
p as (select unnest(embedding)::double x, generate_subscripts(embedding,1) i from a),
m as (select i, avg(x) m from p group by 1),
e as (select cx, cy, unnest(embedding)::double x, generate_subscripts(embedding,1) i from y),
s as (select cx, cy, sum(x*m)/greatest(sqrt(sum(x*x)),1e-9) as score from e join m using(i) group by 1, 2),
f as (select tx, cy, score from (select cx, cy, score,
  unnest(range(cast(ceil((1000*cx-15)/30.0) as bigint), cast(ceil((1000*cx+985)/30.0) as bigint))) as tx from s)),
t as (select tx as cx, ty as cy, score from (select tx, score,
  unnest(range(cast(ceil((1000*cy-15)/30.0) as bigint), cast(ceil((1000*cy+985)/30.0) as bigint))) as ty from f)),
c as (select cx, cy from t join {{country_edge}}
  on cntr_code = 'C1' and (y1>(cy+0.5)*0.3)<>(y2>(cy+0.5)*0.3) and (cx+0.5)*0.3 < (x2-x1)*((cy+0.5)*0.3-y1)/(y2-y1)+x1
  group by cx, cy, nuts_name having count(*)%2=1)
select cx, cy, round(score, 6) as score from t join (select distinct cx, cy from c) using (cx, cy)"""


@_query("run_embedding_30", _MOSAIC_30)
def _(v: Views) -> DataFrame:
    own = {"data_mode": "own", "dataset_key": "survey", "species": "U"}
    config = RunConfig(**{**_CHOICES, **own, "model_type": "embedding", "resolution": 300, "year_start": 1990})
    return runs.run(config, _tables(v), tile=4.0).surface.select("cx", "cy", _r("score"))


# the notebook's maps: which cells are scored, and that scores are shares
@_query("notebook_area", f"""select cx, cy, true as is_share
from ({_layers_sql(30, f"({_cells_sql(30)})", "1996", "join")}) where "NDVI" is not null""")
def _(v: Views) -> DataFrame:
    config = RunConfig(**_CHOICES, n_trees=20, max_depth=5)
    surface = notebook.forest_area(config, _tables(v), tile=4.0)
    return surface.select("cx", "cy", F.col("score").between(0, 1).alias("is_share"))


@_query(
    "embedding_area",
    """select distinct cx, cy, true as is_share from (
  select cx, cy from {mosaic} join {country_edge} on year = 2023 and cntr_code = 'C1'
    and (y1>(cy+0.5)*10)<>(y2>(cy+0.5)*10) and (cx+0.5)*10 < (x2-x1)*((cy+0.5)*10-y1)/(y2-y1)+x1
  group by cx, cy, nuts_name having count(*)%2=1)""",
)
def _(v: Views) -> DataFrame:
    own = {"data_mode": "own", "dataset_key": "survey", "species": "U"}
    config = RunConfig(**{**_CHOICES, **own, "model_type": "embedding", "year_start": 1990})
    surface = notebook.embedding_area(config, _tables(v), tile=4.0)
    return surface.select("cx", "cy", F.col("score").between(0, 1).alias("is_share"))


# ---- models (no oracle: trained) ------------------------------------------------------------

_LAYERS = ("elevation", "aspect", "phh2o")


def _run(v: Views, model_type: str, layers: tuple[str, ...] = _LAYERS) -> pipeline.Run:
    config = RunConfig(
        species="HOUSEHOLD", selected_layers=layers, model_type=model_type, n_trees=100, max_depth=5, year_start=1998
    )
    return pipeline.run_model(
        config, surveyed(v), v.boundary_edge, v.pixel, pixel_years(v), step=1.0, tile=4.0, projected=True
    )


@_query("rf_score")
def _(v: Views) -> DataFrame:
    return _run(v, "rf", (*_LAYERS, "NDVI")).results


@_query("maxent_score")
def _(v: Views) -> DataFrame:
    return _run(v, "maxent").surface


@_query("classify_aoi")
def _(v: Views) -> DataFrame:
    return _run(v, "rf").surface


@_query("whatif")
def _(v: Views) -> DataFrame:
    return pipeline.what_if(_run(v, "rf"), {"elevation": 500.0})


# what does not depend on the trees: which cells are scored, scores are shares, no shift changes nothing
@_query(
    "whatif_zero",
    f"""select distinct cx, cy, cast(0 as double) as delta, true as is_share
from ({_CLIP_PIXELS}) join {{pixel}} using (pixel_id)""",
)
def _(v: Views) -> DataFrame:
    same = pipeline.what_if(_run(v, "rf"), {"elevation": 0.0})
    return same.select("cx", "cy", "delta", F.col("score").between(0, 1).alias("is_share"))


def _sample(v: Views) -> DataFrame:
    presence = sampling.sample_layers(cut_lineage(surveyed(v)), v.pixel, _LAYERS).withColumn(
        "sample_id", F.concat(F.lit("p"), F.col("occ_id").cast("string"))
    )
    background = v.pixel.withColumn("sample_id", F.concat(F.lit("b"), F.col("pixel_id").cast("string")))
    labelled = sampling.presence_background(presence, background, _LAYERS, ["sample_id"])
    return cut_lineage(sampling.balanced(labelled, ["sample_id"]))


def _evaluated(v: Views):
    return evaluation.repeated_evaluation(
        _sample(v), ["sample_id"], list(_LAYERS), n_trees=100, max_depth=5, train_size=0.85
    )


@_query("repeat_eval")
def _(v: Views) -> DataFrame:
    return _evaluated(v)[0]


@_query("rf_notebook")
def _(v: Views) -> DataFrame:
    sample = _sample(v)
    vector = forest.feature_vector(_LAYERS)
    split = evaluation.stratified_split(sample, ["sample_id"], 0.85, 42)
    model = forest.fit(
        split.where("is_train"), vector, ["sample_id"], 500, 5, balanced=True, leaf_share=forest.LEAF_SHARE
    )
    return forest.score(model, v.pixel, vector).select("cx", "cy", _r("score"))


@_query("perm_importance")
def _(v: Views) -> DataFrame:
    sample = _sample(v)
    vector = forest.feature_vector(_LAYERS)
    split = evaluation.stratified_split(sample, ["sample_id"], 0.85, 42)
    model = forest.fit(split.where("is_train"), vector, ["sample_id"], 100, 5, balanced=True)
    return evaluation.permutation_importance(model, split.where("not is_train"), ["sample_id"], list(_LAYERS))


@_query("embedding_rf")
def _(v: Views) -> DataFrame:
    rows = v.embeddings.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("bands"),
        F.when(F.col("label") == 0, 1).otherwise(0).alias("PresAbs"),
    )
    sample = sampling.balanced(rows, ["vec_id"])
    vector = array_to_vector(F.col("bands"))
    model = forest.fit(
        sample, vector, ["vec_id"], forest.EMBEDDING_TREES, forest.EMBEDDING_DEPTH, leaf_share=forest.LEAF_SHARE
    )
    return forest.score(model, rows, vector).select("vec_id", "PresAbs", _r("score"))
