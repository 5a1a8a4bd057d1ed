import datetime as dt

import pytest
from pyspark.sql import functions as F

from nichegrid.functions import spectral
from nichegrid.operators import composites

SCENE = "ts timestamp_ntz, cx long, cy long, b3 double, b5 double, b7 double, qa60 long, cloudy_pct double"


def scene(day, qa=0, cloud=10.0, b3=0.2, b5=0.4, b7=0.5):
    return (dt.datetime.fromisoformat(day), 0, 0, b3, b5, b7, qa, cloud)


@pytest.mark.parametrize("qa, clear", [(0, True), (1 << 10, False), (1 << 11, False), (3 << 10, False), (1 << 9, True)])
def test_cloud_bits(spark, qa, clear):
    df = spark.createDataFrame([(2000.0, qa)], "b3 double, qa60 long")
    assert spectral.mask_clouds(df, ["b3"]).first()["b3"] == (0.2 if clear else None)


def test_division_by_zero_masks(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, -1.0), (2.0, 4.0)], "a double, b double")
    out = [r[0] for r in df.select(spectral.nari(F.col("a"), F.col("b"))).collect()]
    assert out[:2] == [None, None] and out[2] == pytest.approx((1 / 2 - 1 / 4) / (1 / 2 + 1 / 4))


def test_index_median_season(spark):
    inside = [scene("2020-09-01", b3=1.0, b5=3.0), scene("2020-10-31T23:59:59", b3=1.0, b5=2.0)]
    outside = [
        scene("2020-08-31T23:59:59"), scene("2020-11-01"), scene("2021-09-05"),
        scene("2020-09-10", cloud=65.0), scene("2020-09-11", qa=1 << 10),
    ]
    df = spark.createDataFrame(inside + outside, SCENE)
    got = composites.index_median(df, "nari", 2020).collect()
    each = [(1 - 1 / 3) / (1 + 1 / 3), (1 - 1 / 2) / (1 + 1 / 2)]
    assert len(got) == 1 and got[0]["nari"] == pytest.approx(sum(each) / 2)
    with pytest.raises(ValueError):
        composites.index_median(df, "ndwi", 2020)


def test_season_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([scene("2020-09-01")], SCENE).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    pixels = df.where(composites.between(F.col("ts"), "2020-09-01", "2020-11-01")).select("cx")
    plan = pixels._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_mosaic_skips_masked_pixels(spark):
    rows = [(1, 0, 0, 5.0), (2, 0, 0, 6.0), (3, 0, 0, None)]
    df = spark.createDataFrame(rows, "ts int, cx long, cy long, v double")
    assert composites.mosaic(df, ["v"]).first()["v"] == 6.0
    assert composites.mosaic(df, ["v"], on_top="first").first()["v"] == 5.0
    with pytest.raises(ValueError):
        composites.mosaic(df, ["v"], on_top="middle")


@pytest.mark.parametrize("limit", [200_000, 0])
def test_trailing_days(spark, monkeypatch, limit):
    monkeypatch.setattr(composites, "BROADCAST_ROWS", limit)
    start = dt.date(2024, 1, 1)
    climate = [(0, 0, start + dt.timedelta(i), float(2**i), float(i)) for i in range(8) if i != 5]
    points = [(1, 0, 0, start + dt.timedelta(4)), (2, 0, 0, start + dt.timedelta(7)), (3, 0, 0, start),
              (4, 1, 1, start + dt.timedelta(4)), (5, 0, 0, start + dt.timedelta(10))]
    c = spark.createDataFrame(climate, "cx long, cy long, d date, snowfall_sum double, snow_cover double")
    p = spark.createDataFrame(points, "id int, cx long, cy long, d date")
    snow = {r["id"]: r["snowfall"] for r in composites.snowfall_4d(p, c).collect()}
    # days [d - 4, d): the date itself does not count, nor do missing days
    assert snow == {1: 15_000.0, 2: (8 + 16 + 64) * 1000.0, 5: (64 + 128) * 1000.0}
    cover = {r["id"]: r["snowcover"] for r in composites.snowcover_4d(p, c).collect()}
    assert cover[1] == 1.5 and cover[2] == pytest.approx((3 + 4 + 6) / 3)


def test_annual_mean(spark):
    rows = [(dt.datetime(2020, 1, 1), 0, 0, 1.0), (dt.datetime(2020, 12, 31), 0, 0, 3.0), (dt.datetime(2021, 1, 1), 0, 0, 9.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, cx long, cy long, v double")
    assert {r["yr"]: r["v"] for r in composites.annual_mean(df, ["v"]).collect()} == {2020: 2.0, 2021: 9.0}


def test_yearly_layers(spark):
    from nichegrid.plans import layers

    climate = [(dt.datetime(y, m, 1), 0, 0, float(y), None if m == 2 else 1.0) for y in (2019, 2020, 2021) for m in (1, 2)]
    df = spark.createDataFrame(climate, "ts timestamp_ntz, cx long, cy long, snow_depth_water_equivalent double, snow_cover double")
    scenes = spark.createDataFrame([scene("2020-09-05", b3=1.0, b5=3.0)], SCENE)
    out = layers.yearly_layers([2019, 2020], climate=df, scenes=scenes)
    assert out.columns == ["cx", "cy", "yr", "SWE", "snow_cover", "NARI", "NCRI"]
    got = {r["yr"]: (r["SWE"], r["snow_cover"], r["NARI"]) for r in out.collect()}
    assert got == {2019: (2019.0, 1.0, None), 2020: (2020.0, 1.0, pytest.approx(0.5))}
    with pytest.raises(ValueError):
        layers.yearly_layers([2019])
