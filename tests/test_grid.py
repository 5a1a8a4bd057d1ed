import math

import pytest
from pyspark.sql import functions as F

from nichegrid.functions import geo, surface
from nichegrid.operators import grid, sampling


@pytest.fixture(scope="module")
def raster(spark):
    rows = [(x, y, float(x * 100 + y)) for x in range(-12, 13) for y in range(-7, 9) if (x, y) != (3, 3)]
    return spark.createDataFrame(rows, "cx long, cy long, v double").persist()


@pytest.mark.parametrize("source, target", [(10, 30), (30, 10), (300, 1000), (1000, 300), (100, 100), (30, 100)])
def test_regrid_takes_the_pixel_under_the_centre(raster, source, target):
    known = {(r["cx"], r["cy"]): r["v"] for r in raster.collect()}
    got = {(r["cx"], r["cy"]): r["v"] for r in grid.regrid(raster, source, target).collect()}

    def under(t):
        return ((2 * t + 1) * target) // (2 * source)

    span = range(-12 * source // target - 2, 13 * source // target + 2)
    expected = {
        (x, y): known[under(x), under(y)] for x in span for y in span if (under(x), under(y)) in known
    }
    assert got == expected


def test_regrid_needs_no_shuffle(raster):
    plan = grid.regrid(raster, 300, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_regrid_mean(raster):
    got = {(r["cx"], r["cy"]): r["v"] for r in grid.regrid_mean(raster, 10, 30, ["v"]).collect()}
    inside = [r["v"] for r in raster.collect() if -3 <= r["cx"] < 0 and -3 <= r["cy"] < 0]
    assert got[(-1, -1)] == pytest.approx(sum(inside) / len(inside))


def test_cells_of_extent_fills_the_box(spark):
    df = spark.createDataFrame([(2, 5), (4, 7)], "cx long, cy long")
    assert {tuple(r) for r in grid.cells_of_extent(df).collect()} == {(x, y) for x in (2, 3, 4) for y in (5, 6, 7)}
    assert grid.cells_of_extent(df.limit(0)).count() == 0


def test_terrain_over_tile_borders(spark):
    # a plane rising to the east: slope is constant, it faces west, wherever tiles meet
    plane = spark.range(-300, 300).select(
        F.col("id").alias("cx"), F.explode(F.expr("sequence(-2L, 2L)")).alias("cy")
    ).withColumn("elevation", F.col("cx") * 10.0)
    got = grid.terrain(plane, spacing=10.0).toPandas()
    assert len(got) == 600 * 5
    inner = got[(got.cx > -300) & (got.cx < 299) & (got.cy.abs() < 2)]
    assert inner.slope.round(6).eq(45.0).all() and inner.aspect.round(6).eq(270.0).all()
    assert got.drop(inner.index).slope.isna().all()


def test_flat_ground_faces_nowhere_in_particular(spark):
    flat = spark.createDataFrame([(x, y, 5.0) for x in range(3) for y in range(3)], "cx long, cy long, elevation double")
    centre = grid.terrain(flat).where("cx = 1 and cy = 1").first()
    assert (centre["slope"], centre["aspect"]) == (0.0, 0.0)


@pytest.mark.parametrize("band, expected", [("second", 2.0), (None, 1.0), ("", 1.0)])
def test_custom_layer_band(spark, band, expected):
    asset = spark.createDataFrame([(0, 0, 1.0, 2.0)], "cx long, cy long, first double, second double")
    out = grid.custom_layer(asset, band, "mine")
    assert out.columns == ["cx", "cy", "mine"] and out.first()["mine"] == expected


def test_custom_layer_unknown_band(spark):
    asset = spark.createDataFrame([(0, 0, 1.0)], "cx long, cy long, first double")
    with pytest.raises(ValueError):
        grid.custom_layer(asset, "nope", "mine")


def test_stack_layers_is_one_shuffle(spark):
    long = spark.createDataFrame([(0, 0, "a", 1.0), (0, 0, "b", 2.0), (1, 0, "a", 3.0)], "cx long, cy long, layer string, value double")
    out = grid.stack_layers(long, ["a", "b"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {tuple(r) for r in out.collect()} == {(0, 0, 1.0, 2.0), (1, 0, 3.0, None)}


def test_shift_layers(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert tuple(surface.shift_layers(df, {"a": 0, "b": None}, ["a", "b"]).first()) == (1.0, 2.0)
    assert tuple(surface.shift_layers(df, {"a": "x", "b": "3", "c": 9}, ["a", "b", "c"]).first()) == (1.0, 5.0)
    there = surface.shift_layers(df, {"a": 7.0})
    assert tuple(surface.shift_layers(there, {"a": -7.0}).first()) == (1.0, 2.0)


def test_soil_scaling_rejects_other_layers(spark):
    df = spark.createDataFrame([(65,)], "soil_ph int")
    assert surface.scale_soil(df).first()["soil_ph"] == pytest.approx(6.5)
    with pytest.raises(ValueError):
        surface.scale_soil(df, {"elevation": "soil_ph"})


def test_mercator_round_trip(spark):
    df = spark.createDataFrame([(11.4, 47.2), (-70.0, -33.0)], "lon double, lat double")
    x, y = geo.to_web_mercator(F.col("lon"), F.col("lat"))
    lon, lat = geo.to_wgs84(F.col("x"), F.col("y"), 3857)
    for r in df.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r["a"] == pytest.approx(r["lon"]) and r["b"] == pytest.approx(r["lat"])
    with pytest.raises(ValueError):
        geo.to_wgs84(F.col("x"), F.col("y"), 31287)


def test_resolutions():
    assert geo.degrees_for(1000) == pytest.approx(0.008983, abs=1e-5)
    with pytest.raises(ValueError):
        geo.degrees_for(50)
    assert math.isclose(geo.degrees_for(300), 30 * geo.degrees_for(10))


def test_saved_layers_join_in_place(spark, tmp_path):
    from nichegrid.sources.layers import save_layers

    cells = spark.range(2000).select((F.col("id") % 50).alias("cx"), F.floor(F.col("id") / 50).alias("cy"))
    spark.sql(f"create database layout location '{tmp_path}/layout'")
    save_layers(cells.withColumn("elevation", F.col("cx") * 1.0), "layout.static", 4)
    yearly = cells.withColumn("NDVI", F.col("cy") * 1.0).withColumn("yr", F.explode(F.expr("sequence(2019, 2021)")))
    save_layers(yearly, "layout.yearly", 4)
    first = spark.table("layout.yearly").where("yr = 2020")
    joined = spark.table("layout.static").hint("merge").join(first, ["cx", "cy"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(yr" in plan
    assert joined.count() == 2000
    # points go to the layers, whatever the size of either, if these have as many buckets as a shuffle has partitions
    save_layers(cells.withColumn("elevation", F.col("cx") * 1.0), "layout.wide", 8)
    points = spark.range(300).select(F.col("id"), (F.col("id") % 60).alias("cx"), (F.col("id") % 30).alias("cy"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sampled = sampling.sample_stored(points, spark.table("layout.wide"), ["elevation"], how="left")
        plan = sampled._jdf.queryExecution().executedPlan().toString()
        scan = plan.index("FileScan parquet")
        above = plan[:scan].splitlines()[-4:]
        assert "Bucketed: true" in plan and not any("Exchange" in line for line in above)
        assert sampled.count() == 300 and sampled.where("elevation = cx").count() == 250
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("drop database layout cascade")
