"""Views that let the given tables stand in for occurrences, boundaries and rasters.

Each view is one SQL text that means the same in Spark and in the checking engine, so a query
and its oracle start from the same rows. ``{name}`` refers to a given table or another view.
All of them grow with the tables they are made from, but for ``aoi``/``edge`` and the 0.1 degree
layers, which are the small side of a join with growing points.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichegrid.operators.grid import cells_of_extent
from nichegrid.operators.joins import lookup_join

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    # points in milli-degrees (mx, my); 1 in 20 years and 1 in 10 coordinates missing
    "occurrence": """
select o_orderkey as occ_id, o_orderpriority as species,
  case when o_orderkey % 20 = 0 then null else cast(year(o_orderdate) as bigint) end as yr,
  cast(month(o_orderdate) as bigint) as mon,
  (o_orderkey*7919)%7700 as mx, (o_orderkey*104729)%2800 as my,
  cast(9.5 as double)+cast((o_orderkey*7919)%7700 as double)/cast(1000 as double) as lon,
  cast(46.3 as double)+cast((o_orderkey*104729)%2800 as double)/cast(1000 as double) as lat,
  cast(floor(((o_orderkey*7919)%7700)/100) as bigint) as cx,
  cast(floor(((o_orderkey*104729)%2800)/100) as bigint) as cy,
  case when o_orderstatus='P' then 'PRESERVED_SPECIMEN' else 'HUMAN_OBSERVATION' end as basis,
  o_orderkey % 10 <> 3 as has_coord,
  'C' || cast(o_custkey % 5 as string) as country
from {orders}""",
    # the same as published records
    "records": """
select occ_id as key, species, species || ' L.' as scientificName, yr as year, mon as month,
  lon as decimalLongitude, lat as decimalLatitude, country as countryCode,
  has_coord as hasCoordinate, basis as basisOfRecord
from {occurrence}""",
    # 25 counties in 5 countries, a diamond each
    "aoi": """
select n_name as nuts_name, r_name as cntr_code,
  cast(n_nationkey%5 as double)*1540 as x0, cast(floor(n_nationkey/5) as double)*560 as y0
from {nation} join {region} on n_regionkey=r_regionkey""",
    "edge": """
select nuts_name, x0+770 as x1, y0 as y1, x0+1540 as x2, y0+280 as y2 from {aoi}
union all select nuts_name, x0+1540, y0+280, x0+770, y0+560 from {aoi}
union all select nuts_name, x0+770, y0+560, x0, y0+280 from {aoi}
union all select nuts_name, x0, y0+280, x0+770, y0 from {aoi}""",
    # a raster with one pixel per order, 250 columns wide and as many rows as it takes
    "pixel": """
select o_orderkey as pixel_id,
  cast(o_orderkey % 250 as bigint) as cx, cast(floor(o_orderkey/250) as bigint) as cy,
  cast(floor(o_totalprice/100) as double) - cast(500 as double) as elevation,
  cast((o_custkey*7) % 360 as double) as aspect,
  case when o_orderkey % 7 = 0 then null else cast(o_custkey % 30 as double) end as chm,
  cast(o_orderkey % 90 as double) as phh2o,
  cast(o_custkey % 160 as double) as bdod,
  case when o_orderkey % 11 = 0 then null else cast(o_custkey % 1000 as double)/cast(1000 as double) end as score
from {orders}""",
    # a diamond per supplier over the same raster, 10 across
    "boundary": """
select s_suppkey as area_id, s_name as nuts_name, 'C' || cast(s_nationkey as string) as cntr_code,
  cast(s_suppkey % 10 as double)*25 as x0, cast(floor(s_suppkey/10) as double)*6 as y0
from {supplier}""",
    "boundary_edge": """
select cntr_code, nuts_name, x0+12.5 as x1, y0 as y1, x0+25 as x2, y0+3 as y2 from {boundary}
union all select cntr_code, nuts_name, x0+25, y0+3, x0+12.5, y0+6 from {boundary}
union all select cntr_code, nuts_name, x0+12.5, y0+6, x0, y0+3 from {boundary}
union all select cntr_code, nuts_name, x0, y0+3, x0+12.5, y0 from {boundary}""",
    # the same parts as five countries
    "country_edge": """
select 'C' || cast(area_id % 5 as string) as cntr_code, b.nuts_name, x1, y1, x2, y2
from {boundary_edge} e join {boundary} b on b.nuts_name = e.nuts_name""",
    # one sighting per customer on the raster
    "sighting": """
select c_custkey as occ_id, c_mktsegment as species,
  cast(1995 + c_custkey % 7 as bigint) as yr,
  cast((c_custkey*10 + c_custkey%10) % 250 as bigint) as cx,
  cast(floor((c_custkey*10 + c_custkey%10)/250) as bigint) as cy,
  cast((c_custkey*10 + c_custkey%10) % 250 as double) + cast(0.5 as double) as lon,
  cast(floor((c_custkey*10 + c_custkey%10)/250) as double) + cast(0.5 as double) as lat
from {customer}""",
    # the sightings as published records
    "survey": """
select occ_id as key, species, species || ' L.' as scientificName, yr as year, cast(6 as bigint) as month,
  lon as decimalLongitude, lat as decimalLatitude, 'C' || cast(occ_id % 5 as string) as countryCode,
  occ_id % 10 <> 3 as hasCoordinate,
  case when occ_id % 9 = 0 then 'PRESERVED_SPECIMEN' else 'HUMAN_OBSERVATION' end as basisOfRecord
from {sighting}""",
    # layers on other grids than the raster, whose cells are 100 m: one of 300 m, one of 30 m that is sparse
    "coarse": """
select cast(floor(cx/3) as bigint) as cx, cast(floor(cy/3) as bigint) as cy, max(bdod) as bdod
from {pixel} group by cast(floor(cx/3) as bigint), cast(floor(cy/3) as bigint)""",
    "fine": """
select cast(floor((2*cx+1)*100/60) as bigint) as cx, cast(floor((2*cy+1)*100/60) as bigint) as cy, phh2o
from {pixel}""",
    # line items as image pixels
    "scene": """
select l_shipdate as ts, l_partkey%77 as cx, l_suppkey%28 as cy, l_orderkey as scene_id, l_linenumber as line_no,
  l_quantity as b3, l_extendedprice/cast(1000 as double) as b5,
  l_quantity+l_extendedprice/cast(2000 as double) as b7,
  cast(l_linenumber%4 as bigint)*1024 as qa60, l_discount*cast(1000 as double) as cloudy_pct
from {lineitem}""",
    # events as climate readings and as points that ask for the days before
    "climate": """
select event_id, user_id%77 as cx, user_id%28 as cy, cast(ts as date) as d,
  value as snowfall_sum, sqrt(value) as snow_cover
from {events}""",
    # embeddings as a mosaic per year, 25 columns wide
    "mosaic": """
select vec_id, vec_id%25 as cx, cast(floor(vec_id/25) as bigint) as cy, label,
  cast(2014 + label as bigint) as year, embedding
from {embeddings}""",
    # line items as result rows of many runs
    "run_result": """
select cast(0.6 as double)+l_discount as roc_auc, cast(0.55 as double)+l_tax as overall_accuracy,
  cast(l_linenumber - 1 as bigint) as excluded_presence_count,
  l_quantity/cast(100 as double) as elevation, l_discount as slope,
  l_extendedprice/cast(100000 as double) as aspect
from {lineitem}""",
}

# oracle side only: the Spark side builds the grid with explode instead of a cross join
ORACLE_VIEWS = {
    "cell": """
select a.cx, b.cy from (select distinct cx from {occurrence}) a cross join (select distinct cy from {occurrence}) b""",
    "layer_static": """
select cx, cy, cast(200+((cx*37+cy*101+cx*cy)%3000) as double) as elevation,
  cast((cx*13+cy*29)%360 as double) as aspect,
  case when (cx+cy)%7=0 then null else cast((cx*5+cy*3)%30 as double) end as chm,
  cast((cx*11+cy*17)%90 as double) as phh2o
from {cell}""",
    "layer_year": """
select cx, cy, yr,
  case when (cx*3+cy*5+yr)%11=0 then null
       else cast((cx*7+cy*11+yr*13)%200-100 as double)/cast(100 as double) end as ndvi
from {cell} cross join (select distinct yr from {occurrence} where yr is not null) y""",
}

_REFERENCE = re.compile(r"\{(\w+)\}")


class Views:
    """The views over one folder of parquet tables, each built once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._built = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name == "cell":
            return cells_of_extent(self.occurrence)
        if name == "layer_static":
            return self._select("layer_static", self.cell)
        if name == "layer_year":
            years = self.occurrence.agg(F.min("yr").alias("lo"), F.max("yr").alias("hi")).first()
            dated = self.cell.withColumn(
                "yr", F.explode(F.expr(f"sequence({years['lo']}L, {years['hi']}L)"))
            )
            sql = ORACLE_VIEWS["layer_year"]
            return self.spark.sql(sql[: sql.index("from {cell}")] + "from {cell}", cell=dated)
        sql = VIEWS[name]
        return self.spark.sql(sql, **{n: getattr(self, n) for n in set(_REFERENCE.findall(sql))})

    def _select(self, name: str, cell: DataFrame) -> DataFrame:
        return self.spark.sql(ORACLE_VIEWS[name], cell=cell)


def oracle(body: str) -> str:
    """``body`` with every ``{view}`` it needs in front, as one statement."""
    texts = {**VIEWS, **ORACLE_VIEWS}
    ordered: list[str] = []

    def need(sql: str) -> None:
        for name in _REFERENCE.findall(sql):
            if name in texts and name not in ordered:
                need(texts[name])
                ordered.append(name)

    need(body)
    plain = lambda sql: _REFERENCE.sub(r"\1", sql).strip()
    head = ",\n".join(f"{n} as ({plain(texts[n])})" for n in ordered)
    text = plain(body)
    if not head:
        return text
    if text.startswith("with "):
        return f"with {head},\n{text.removeprefix('with ')}"
    return f"with {head}\n{text}"


# ---- tables for the modelling queries (no oracle) -------------------------------------------


#: columns from its own to the cells that a sighting chooses among; the raster is 250 wide
_ROAMS = (0, 61, 122, 183)


def surveyed(views: Views) -> DataFrame:
    """Every sighting, in the highest of a few cells of its row, so that a model has something to learn.

    A cell without a pixel is the last choice, and of cells alike the nearest to its own wins.
    """
    near = views.sighting.select(
        "occ_id", "species", "yr", "cx", "cy", F.explode(F.array(*map(F.lit, _ROAMS))).alias("_shift")
    ).withColumn("cx", (F.col("cx") + F.col("_shift")) % 250)
    on_ground = lookup_join(near, views.pixel.select("cx", "cy", "elevation"), ["cx", "cy"], "left")
    choice = F.struct("elevation", (-F.col("_shift")).alias("_near"), "cx", "cy")  # null is the least
    chosen = on_ground.groupBy("occ_id", "species", "yr").agg(F.max(choice).alias("_at"))
    return chosen.select("occ_id", "species", "yr", "_at.cx", "_at.cy").withColumns(
        {"lon": F.col("cx") + 0.5, "lat": F.col("cy") + 0.5}
    )


def pixel_years(views: Views) -> DataFrame:
    """A yearly layer on the raster, masked on 1 pixel in 11."""
    dated = views.pixel.select(
        "cx", "cy", "pixel_id", F.explode(F.sequence(F.lit(1995).cast("long"), F.lit(2001).cast("long"))).alias("yr")
    )
    value = (F.pmod(F.col("pixel_id") * 7 + F.col("yr") * 13, F.lit(200)) - 100) / 100
    masked = (F.col("pixel_id") + F.col("yr")) % 11 == 0
    return dated.select("cx", "cy", "yr", F.when(~masked, value).alias("NDVI"))


# ---- containers made in Spark for the readers -------------------------------------------------


def _zip(members: dict[str, bytes]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return buffer.getvalue()


def zipped_tables(records: DataFrame, rows_per_archive: int = 2000) -> DataFrame:
    """Records as zipped tab-separated tables, a bounded number of rows each."""
    numbered = records.withColumn("_archive", F.floor(F.col("key") / rows_per_archive))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        text = pdf.drop(columns="_archive").to_csv(sep="\t", index=False)
        return pd.DataFrame({"content": [_zip({"occurrence.csv": text.encode()})]})

    return numbered.groupBy("_archive").applyInPandas(pack, "content binary")


def point_shapefile(x: list[float], y: list[float], columns: dict[str, list[object]]) -> dict[str, bytes]:
    """Members of a point shapefile with text attributes, in the public layout."""
    n = len(x)
    head = lambda size: (
        struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2)
        + struct.pack("<2i", 1000, 1)
        + struct.pack("<8d", min(x), min(y), max(x), max(y), 0, 0, 0, 0)
    )
    shp = b"".join(
        struct.pack(">2i", i + 1, 10) + struct.pack("<i2d", 1, a, b) for i, (a, b) in enumerate(zip(x, y))
    )
    shx = b"".join(struct.pack(">2i", (100 + 28 * i) // 2, 10) for i in range(n))
    texts = {k: ["" if v is None or v != v else str(v) for v in vs] for k, vs in columns.items()}
    width = {k: max([1, *(len(t.encode()) for t in ts)]) for k, ts in texts.items()}
    fields = b"".join(
        k.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([width[k]]) + bytes(15) for k in texts
    )
    rows = b"".join(
        b" " + b"".join(texts[k][i].encode().ljust(width[k]) for k in texts) for i in range(n)
    )
    dbf = (
        struct.pack("<4BIHH", 3, 95, 7, 26, n, 33 + len(fields), 1 + sum(width.values()))
        + bytes(20) + fields + b"\r" + rows + b"\x1a"
    )
    return {
        "points.shp": head(100 + len(shp)) + shp,
        "points.shx": head(100 + len(shx)) + shx,
        "points.dbf": dbf,
    }


def zipped_shapefiles(points: DataFrame, rows_per_bundle: int = 2000) -> DataFrame:
    """``occ_id, species, yr, lon, lat`` as zipped point shapefiles, a bounded number of rows each."""
    numbered = points.withColumn("_bundle", F.floor(F.col("occ_id") / rows_per_bundle))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        years = [None if pd.isna(v) else int(v) for v in pdf["yr"]]
        members = point_shapefile(
            pdf["lon"].tolist(), pdf["lat"].tolist(), {"species": pdf["species"].tolist(), "year": years}
        )
        return pd.DataFrame({"content": [_zip(members)]})

    return numbered.groupBy("_bundle").applyInPandas(pack, "content binary")
