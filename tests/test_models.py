import math
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichegrid.config import RunConfig
from nichegrid.functions import catalogue, vectors
from nichegrid.operators import clip, correlation, metrics, ordering, sampling, zonal
from nichegrid.operators.metrics import roc_auc
from nichegrid.plans import embedding, evaluation, forest, maxent, notebook, pipeline
from nichegrid.plans import run as run_plan
from nichegrid.plans.landscape import Landscape
from nichegrid.standins import Views, surveyed

STEP = 1.0


@pytest.fixture(scope="module")
def world(spark):
    """A 40 x 30 grid whose presences sit on the high, eastern side."""
    cells = spark.range(1200).select((F.col("id") % 40).alias("cx"), F.floor(F.col("id") / 40).alias("cy"))
    static = cells.select(
        "cx", "cy", (F.col("cx") * 50.0).alias("elevation"),
        F.when((F.col("cx") + F.col("cy")) % 17 != 0, (F.col("cy") * 7.0) % 11).alias("CHM"),
    ).persist()
    yearly = cells.withColumn("yr", F.explode(F.expr("sequence(2018L, 2022L)"))).select(
        "cx", "cy", "yr", F.when(F.col("yr") != 2021, (F.col("cy") + F.col("yr")) % 5 / 5.0).alias("NDVI")
    ).persist()
    points = spark.range(400).select(
        F.col("id").alias("occ_id"), F.lit("s").alias("species"),
        F.when(F.col("id") % 10 != 0, 2018 + F.col("id") % 5).alias("yr"),
        (20 + (F.col("id") * 7919) % 200 / 10.0).alias("lon"), ((F.col("id") * 104729) % 300 / 10.0).alias("lat"),
    ).persist()
    edges = spark.createDataFrame(
        [(0.0, 0.0, 40.0, 0.0), (40.0, 0.0, 40.0, 30.0), (40.0, 30.0, 0.0, 30.0), (0.0, 30.0, 0.0, 0.0)], "x1 double, y1 double, x2 double, y2 double"
    )
    return static, yearly, points, edges


def config(**changes):
    return RunConfig(**{"selected_layers": ("elevation",), "n_trees": 10, "year_start": 2018, **changes})


def run(world, **changes):
    static, yearly, points, edges = world
    return pipeline.run_model(config(**changes), points, edges, static, yearly, STEP, tile=4.0)


@pytest.fixture(scope="module")
def forest_run(world):
    return run(world, selected_layers=("elevation", "CHM"))


def test_forest_run(forest_run):
    row = forest_run.results.first().asDict()
    assert set(row) == {"overall_accuracy", "excluded_presence_count", "roc_auc", "elevation", "CHM"}
    assert row["excluded_presence_count"] == 0  # no temporal layer selected
    assert row["roc_auc"] > 0.65 and row["elevation"] > row["CHM"]
    assert row["elevation"] + row["CHM"] == pytest.approx(1)
    scores = forest_run.surface.agg(F.min("score"), F.max("score"), F.count("*"), F.count_distinct("cx", "cy")).first()
    assert 0 <= scores[0] < scores[1] <= 1 and scores[2] == scores[3]
    masked = sum((x + y) % 17 == 0 for x in range(40) for y in range(30))
    assert scores[2] == 1200 - masked


def test_forest_run_repeats_itself(world, forest_run):
    again = run(world, selected_layers=("elevation", "CHM"))
    assert again.results.first() == forest_run.results.first()
    assert again.surface.exceptAll(forest_run.surface).isEmpty()


@pytest.mark.parametrize("model_type", ["rf", "embedding"])
def test_figures_never_look_at_the_map(world, mosaic, monkeypatch, model_type):
    asked = []
    inside = pipeline.cells_inside
    monkeypatch.setattr(pipeline, "cells_inside", lambda *a: asked.append(1) or inside(*a))
    if model_type == "rf":
        out = run(world)
    else:
        settings = config(model_type="embedding", year_start=2019)
        out = pipeline.run_embedding(settings, world[2], world[3], mosaic, STEP, tile=4.0)
    assert out.results.first()["roc_auc"] > 0.5 and not asked
    assert not out.surface.isEmpty() and out.surface is out.surface and len(asked) == 1


def test_excluded_presences(world):
    out = run(world, selected_layers=("elevation", "NDVI"))
    # one in ten has no year; of the others those of 2021 have no NDVI
    ids = range(400)
    lost = sum(i % 10 == 0 or 2018 + i % 5 == 2021 for i in ids)
    assert out.results.first()["excluded_presence_count"] == lost


def test_maxent_run(world):
    out = run(world, model_type="maxent")
    row = out.results.first().asDict()
    assert set(row) == {"overall_accuracy", "excluded_presence_count", "roc_auc"} and row["roc_auc"] > 0.65
    means = {r[0]: r[1] for r in out.surface.groupBy(F.col("cx") >= 20).agg(F.avg("score")).collect()}
    assert means[True] > 2 * means[False]
    assert out.surface.where("score < 0 or score > 1").isEmpty()


def test_what_if(forest_run):
    same = pipeline.what_if(forest_run, {}).agg(F.max(F.abs("delta"))).first()[0]
    assert same == 0
    bad = pipeline.what_if(forest_run, {"elevation": "n/a", "unknown": 4}).agg(F.max(F.abs("delta"))).first()[0]
    assert bad == 0
    shifted = pipeline.what_if(forest_run, {"elevation": 1000.0})
    west = shifted.where("cx < 20").agg(F.avg("delta")).first()[0]
    assert west > 0.2
    # the second what-if starts from the original layers again
    assert pipeline.what_if(forest_run, {"elevation": 1000.0}).exceptAll(shifted).isEmpty()


@pytest.mark.parametrize(
    "changes, text",
    [({"model_type": "svm"}, "svm"), ({"max_depth": 31}, "max_depth"), ({"selected_layers": ()}, "layer"),
     ({"train_size": 1.0}, "train_size"), ({"model_type": "embedding"}, "embedding")],
)
def test_wrong_settings_fail_as_one_error(world, changes, text):
    with pytest.raises(RuntimeError, match=text):
        run(world, **changes)


def test_config():
    assert RunConfig().resolution == 100 and RunConfig().model_type == "rf" and RunConfig().max_depth == 3
    assert RunConfig().n_trees == 100 and RunConfig().train_size == 0.75
    assert (RunConfig().year_start, RunConfig().year_end) == (2018, 2025)
    for wrong in ({"data_mode": "upload"}, {"data_mode": "own"}, {"resolution": 50}):
        with pytest.raises(ValueError):
            RunConfig(**wrong).checked()
    assert RunConfig().with_offsets({"a": 1}).whatif_offsets == {"a": 1}


@pytest.fixture(scope="module")
def mosaic(spark, world):
    static, *_ = world
    angle = F.col("cx") / 40.0
    bands = F.array(F.cos(angle), F.sin(angle), F.lit(0.1)).cast("array<float>")
    one = static.select("cx", "cy", F.when(F.col("cx") != 5, bands).alias("embedding"))
    return one.withColumn("year", F.lit(2023)).unionByName(one.withColumn("year", F.lit(2019))).persist()


def test_embedding_run(world, mosaic):
    _, _, points, edges = world
    out = pipeline.run_embedding(config(year_start=2030, model_type="embedding"), points, edges, mosaic, STEP, 4.0)
    assert out.results.columns == ["roc_auc"] and out.results.first()["roc_auc"] > 0.6
    assert out.surface.count() == 1200
    assert out.surface.where("cx = 5 and score is not null").isEmpty()
    with pytest.raises(ValueError, match="embedding"):
        pipeline.what_if(out, {"elevation": 1})


def test_embedding_run_without_samples(world, mosaic):
    _, _, points, edges = world
    away = points.withColumn("lon", F.col("lon") + 1000)
    with pytest.raises(RuntimeError):
        pipeline.run_embedding(config(), away, edges, mosaic, STEP, 4.0)


def test_mosaic_year():
    assert [vectors.clamp_year(y) for y in (2014, 2015, 2020, 2023, 2024)] == [2023, 2015, 2020, 2023, 2023]


def test_similarity_both_ways(spark):
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=4).tolist()) for i in range(50)]
    data += [(50, None), (51, [1.0, None, 2.0, 3.0]), (52, [0.0] * 4), (53, [1.0, 2.0])]
    df = spark.createDataFrame(data, "id int, v array<float>")
    mean = vectors.mean_vector(df.where("id < 50 or id = 51"), "v").first()["mean"]
    assert mean == pytest.approx(np.mean([v for i, v in data[:50]], axis=0), abs=1e-6)
    literal = F.array(*[F.lit(x) for x in mean])
    for cosine in (False, True):
        rows = df.select(
            "id", F.when(F.size("v") == 4, F.when(vectors.complete(F.col("v")), vectors.similarity(F.col("v"), literal, cosine))).alias("a"),
            vectors.batch_similarity(F.col("v"), mean, cosine).alias("b"),
        ).collect()
        for r in rows:
            assert (r["a"] is None) == (r["b"] is None)
            if r["a"] is not None:
                assert r["a"] == pytest.approx(r["b"], abs=1e-9)
        assert {r["id"] for r in rows if r["b"] is None} == {50, 51, 53}


def labelled(spark, n=600):
    rng = np.random.default_rng(9)
    data = []
    for i in range(n):
        y = i % 2
        data.append((i, y, float(rng.normal(y, 0.7)), float(rng.normal())))
    return spark.createDataFrame(data, "sample_id long, PresAbs int, signal double, noise double").persist()


def test_repeated_evaluation_and_permutations(spark):
    sample = labelled(spark)
    results, model, test = evaluation.repeated_evaluation(
        sample, ["sample_id"], ["signal", "noise"], n_trees=10, max_depth=4, train_size=0.8, repeats=3
    )
    rows = results.collect()
    assert results.columns == ["repeat", "roc_auc", "signal", "noise"] and len(rows) == 3
    assert all(r["roc_auc"] > 0.7 and r["signal"] > r["noise"] for r in rows)
    assert test.count() == 120  # the train size is the share that trains
    drops = {r["feature"]: r for r in evaluation.permutation_importance(model, test, ["sample_id"], ["signal", "noise"], 10).collect()}
    assert drops["signal"]["importance_mean"] > 0.15 > abs(drops["noise"]["importance_mean"])
    ranked = metrics.importance_rank(results)
    assert [r["feature"] for r in ranked.collect()] == ["signal", "noise"]


def test_permuted_rows_are_not_broadcast(spark, monkeypatch):
    """Beyond what may be broadcast neither side is, and the drops are the same."""
    _, model, test = evaluation.repeated_evaluation(
        labelled(spark), ["sample_id"], ["signal", "noise"], n_trees=3, max_depth=3, train_size=0.8, repeats=1
    )

    def drops():
        return evaluation.permutation_importance(model, test, ["sample_id"], ["signal", "noise"], 5)

    small = sorted(drops().select("feature", "q25", "q50", "q75").collect())
    monkeypatch.setattr("nichegrid.operators.joins.BROADCAST_ROWS", 10)
    large = drops()
    assert sorted(large.select("feature", "q25", "q50", "q75").collect()) == small
    assert "BroadcastHashJoin" not in large._jdf.queryExecution().toString()


def test_shuffles_are_permutations():
    for n in (1, 2, 12, 97, 360):
        for _, a, c in evaluation._shuffles(n, 20, 42):
            assert sorted((a * i + c) % n for i in range(n)) == list(range(n))


def test_stratified_split(spark):
    sample = labelled(spark).where("PresAbs = 1 or sample_id < 100")
    counts = evaluation.stratified_split(sample, ["sample_id"], 0.75, 1).groupBy("PresAbs", "is_train").count().collect()
    assert {(r[0], r[1]): r[2] for r in counts} == {(1, True): 225, (1, False): 75, (0, True): 38, (0, False): 12}
    with pytest.raises(ValueError):
        evaluation.stratified_split(sample.where("sample_id < 3"), ["sample_id"], 0.7, 1)


def test_forest_needs_both_classes(spark):
    with pytest.raises(ValueError):
        forest.fit(labelled(spark).where("PresAbs = 1"), forest.feature_vector(["signal"]), ["sample_id"], 2, 2)


def test_maxent_recovers_a_hump(spark):
    rng = np.random.default_rng(2)
    data = [(1, float(x)) for x in rng.normal(0.5, 0.08, 300)] + [(0, float(x)) for x in rng.random(1000)]
    df = spark.createDataFrame(data, "PresAbs int, x double")
    model = maxent.fit(df, ["x"], max_iter=60)
    grid = spark.createDataFrame([(0.05,), (0.5,), (0.95,), (7.0,)], "x double")
    low, mid, high, beyond = [r["score"] for r in model.score(grid).collect()]
    assert mid > 0.6 > 0.2 > max(low, high)
    assert beyond == pytest.approx(model.score(spark.createDataFrame([(max(x for _, x in data),)], "x double")).first()["score"])


def test_sample_layers_keeps_or_drops(spark):
    points = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 9, 9), (5, None, 0)], "id int, cx long, cy long")
    layers = spark.createDataFrame([(0, 0, 1.0, 2.0), (1, 0, None, 2.0)], "cx long, cy long, a double, b double")
    assert {r["id"] for r in sampling.sample_layers(points, layers).collect()} == {1, 2}
    assert {r["id"] for r in sampling.sample_layers(points, layers, ["b"]).collect()} == {1, 2, 3}
    left = sampling.sample_layers(points, layers, how="left")
    assert left.count() == 5 and left.where("a is null").count() == 3


def test_sample_layers_without_broadcast(spark, monkeypatch):
    points = spark.range(500).select("id", (F.col("id") % 7).alias("cx"), F.lit(0).cast("long").alias("cy"))
    layers = spark.range(6).select(F.col("id").alias("cx"), F.lit(0).cast("long").alias("cy"), (F.col("id") * 1.0).alias("a"))
    expected = sampling.sample_layers(points, layers)
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 0)
    got = sampling.sample_layers(points, layers)
    assert got.count() == 500 - 500 // 7 - (1 if 500 % 7 > 6 else 0) and got.exceptAll(expected).isEmpty()


def test_thin(spark):
    df = spark.createDataFrame([(3, "a", 0, 0), (1, "a", 0, 0), (2, "b", 0, 0), (4, "a", 1, 0)], "id int, species string, cx long, cy long")
    assert {r["id"] for r in sampling.thin(df, "id").collect()} == {1, 4}
    assert {r["id"] for r in sampling.thin(df, "id", ["species"]).collect()} == {1, 2, 4}


@pytest.mark.parametrize("projected", [False, True])
def test_background_points(spark, projected):
    triangle = [(0.0, 0.0, 10.0, 0.0), (10.0, 0.0, 0.0, 60.0), (0.0, 60.0, 0.0, 0.0)]
    edges = spark.createDataFrame([("t", *e) for e in triangle], "region string, x1 double, y1 double, x2 double, y2 double")
    points = sampling.background_points(edges, 800, tile=5.0, seed=1, projected=projected).toPandas()
    assert len(points) == 800 and points.draw.is_unique
    assert (points.lat / 60 + points.lon / 10 < 1).all() and (points.lon >= 0).all()
    assert points.equals(sampling.background_points(edges, 800, tile=5.0, seed=1, projected=projected).toPandas())


def test_background_is_clipped_once_by_a_written_index(spark, monkeypatch):
    rows = [(0.0, 0.0, 40.0, 0.0), (40.0, 0.0, 40.0, 30.0), (40.0, 30.0, 0.0, 30.0), (0.0, 30.0, 0.0, 0.0)]
    edges = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double").withColumn("region", F.lit("a"))
    area = clip.index_area(edges, "region", 4.0)
    assert "CTE" not in area.frame._jdf.queryExecution().analyzed().toString()
    clips = []
    monkeypatch.setattr(sampling, "clip", lambda *a: clips.append(1) or clip.clip(*a))
    drawn = sampling.background_points(edges, 3000, "region", projected=True, area=area)
    assert drawn.count() == 3000 and drawn.distinct().count() == 3000 and len(clips) == 1


def test_background_of_opposite_rings_and_of_nothing(spark):
    schema = "region string, x1 double, y1 double, x2 double, y2 double"
    corners = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]
    ring = lambda c: [("t", *a, *b) for a, b in zip(c, c[1:] + c[:1])]
    edges = spark.createDataFrame(ring(corners(0.0)) + ring(corners(3.0)[::-1]), schema)
    points = sampling.background_points(edges, 100, tile=1.0, projected=True).toPandas()
    assert len(points) == 100 and {0, 3} == set(points.lon.astype(int))
    flat = spark.createDataFrame([("t", 0.0, 0.0, 1.0, 0.0), ("t", 1.0, 0.0, 0.0, 0.0)], schema)
    with pytest.raises(ValueError, match="empty"):
        sampling.background_points(flat, 1, projected=True)


def test_overlapping_parts_are_one_area(spark):
    from nichegrid.operators.clip import index_area
    from nichegrid.plans import pipeline

    schema = "nuts_name string, x1 double, y1 double, x2 double, y2 double"
    square = [(0.0, 0.0, 10.0, 0.0), (10.0, 0.0, 10.0, 10.0), (10.0, 10.0, 0.0, 10.0), (0.0, 10.0, 0.0, 0.0)]
    edges = spark.createDataFrame([(name, *e) for name in ("a", "b") for e in square], schema)
    cells = spark.range(144).selectExpr("id % 12 as cx", "id div 12 as cy", "0.5D as score")
    area = index_area(pipeline.one_area(edges), pipeline.AREA)
    assert pipeline.cells_inside(cells, area, 1.0).count() == 100


def test_presence_background_names(spark):
    presence = spark.createDataFrame([(1.0, 2.0, "x")], "`b 1` double, a double, extra string")
    background = spark.createDataFrame([(3.0, 4.0)], "a double, `b 1` double")
    out = sampling.presence_background(presence, background, ["a", "b 1"])
    assert out.columns == ["a", "b_1", "PresAbs"] == [*sampling.clean_names(["a", "b 1"]), "PresAbs"]
    assert {tuple(r) for r in out.collect()} == {(2.0, 1.0, 1), (3.0, 4.0, 0)}


def test_balanced_needs_enough_background(spark):
    df = labelled(spark)
    assert sampling.balanced(df.where("PresAbs = 0 or sample_id < 100"), ["sample_id"]).count() == 100
    with pytest.raises(ValueError):
        sampling.balanced(df.where("PresAbs = 1 or sample_id < 100"), ["sample_id"])


def test_metric_flags(spark):
    df = spark.createDataFrame([(0.6, 0.9, 0), (0.7, 0.8, 0)], "roc_auc double, overall_accuracy double, excluded_presence_count int")
    row = metrics.metric_flags(df).first()
    assert row["roc_auc_low"] and not row["overall_accuracy_low"] and row["excluded_presence_count"] is None


def test_ward_clusters_by_hand():
    # 0-1 at .1, 2 near both at .3/.3, 3 far from all
    d = np.array([[0, 0.1, 0.3, 0.9], [0.1, 0, 0.3, 0.9], [0.3, 0.3, 0, 0.9], [0.9, 0.9, 0.9, 0]])
    # second merge height: sqrt((2 * .09 + 2 * .09 - .01) / 3) = .3416
    assert correlation.ward_clusters(d, 0.35) == [0, 0, 0, 1]
    assert correlation.ward_clusters(d, 0.34) == [0, 0, 1, 2]
    assert correlation.ward_clusters(d, 0.05) == [0, 1, 2, 3]
    rho = {(a, b): 1 - d[i, j] for i, a in enumerate("wxyz") for j, b in enumerate("wxyz") if i < j}
    assert correlation.keep_one_per_cluster(rho, list("wxyz")) == ["w", "z"]


def test_spearman_with_gaps(spark):
    rng = np.random.default_rng(4)
    a, b, c = rng.integers(0, 9, (3, 200)).astype(float)
    b = b + a
    gaps = rng.random(200) < 0.3
    rows = [(i, a[i], b[i], None if gaps[i] else c[i]) for i in range(200)]
    df = spark.createDataFrame([(i, float(x), float(y), None if z is None else float(z)) for i, x, y, z in rows], "id long, a double, b double, c double")
    import pandas as pd

    pandas = pd.DataFrame(rows, columns=["id", "a", "b", "c"]).drop(columns="id").astype(float)
    rank = lambda s: s.rank(method="average")

    def expected(x, y, whole):
        rows = pandas.dropna() if whole else pandas[[x, y]].dropna()
        return rank(rows[x]).corr(rank(rows[y]))

    for whole in (True, False):
        for r in correlation.spearman(df, ["id"], ["a", "b", "c"], pairwise=not whole).collect():
            assert r["rho"] == pytest.approx(expected(r["feature_a"], r["feature_b"], whole))


@pytest.mark.parametrize("pairwise", [False, True])
def test_ranking_reads_its_rows_once(spark, pairwise):
    """Rows that came out otherwise when they were made again lost their ranks."""
    df = spark.range(40).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"))
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: read.add(1) or v, "long").asNondeterministic()
    rows = correlation.spearman(df.select("id", seen("a").alias("a"), "b"), ["id"], ["a", "b"], pairwise).collect()
    assert rows[0]["rho"] is not None and read.value == 40


@pytest.mark.parametrize("window_rows", [0, 100_000])
def test_pairwise_ranks_are_one_plan(spark, monkeypatch, window_rows):
    import pandas as pd

    monkeypatch.setattr(ordering.running_totals, "__defaults__", (*ordering.running_totals.__defaults__[:-1], window_rows))
    rng = np.random.default_rng(5)
    values = rng.integers(0, 7, (300, 5)).astype(float)
    values[:, 1] += values[:, 0]
    values[rng.random(values.shape) < 0.25] = np.nan
    values[:, 4] = np.nan  # a feature that nobody has
    names = ["feature", "value", "c", "d", "e"]  # names that the long form could clash with
    rows = [(i, *[None if np.isnan(x) and i % 2 else float(x) for x in row]) for i, row in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    got = correlation.spearman(df, ["id"], names, pairwise=True)
    frame = pd.DataFrame(values, columns=names)
    for r in got.collect():
        both = frame[[r["feature_a"], r["feature_b"]]].dropna().rank()
        if both.empty:
            assert r["rho"] is None
        else:
            assert r["rho"] == pytest.approx(both.iloc[:, 0].corr(both.iloc[:, 1]))
    # the number of joins does not grow with the number of pairs
    plan = lambda f: correlation.spearman(df, ["id"], f, pairwise=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(names).count("Join ") == plan(names[:2]).count("Join ")


def test_suitable_share_weight(spark):
    df = spark.createDataFrame([(0.9, 0.0), (0.1, 60.0), (None, 0.0)], "score double, lat double")
    assert zonal.suitable_share(df, 0.5).first()[0] == 0.5
    weighted = zonal.suitable_share(df, 0.5, weight=F.cos(F.radians("lat"))).first()[0]
    assert weighted == pytest.approx(1 / 1.5)


def test_catalogue(spark):
    assert len(catalogue.LAYERS) == 41 and len({x.name for x in catalogue.LAYERS}) == 41
    assert catalogue.TEMPORAL_LAYERS == {"SWE", "snow_depth", "snow_cover", "snow_albedo", "NDVI", "NARI", "NCRI"}
    assert catalogue.split_temporal(["NDVI", "elevation", "mine"]) == (["NDVI"], ["elevation", "mine"])
    soil = [x for x in catalogue.LAYERS if x.category == "Soil Properties"]
    assert {x.name: x.units for x in soil}["soil_bdod"] == "g/cm³" and len(soil) == 6
    table = catalogue.layer_table(spark)
    assert table.select("category").distinct().count() == 6
    assert all(x.category in catalogue.CATEGORIES for x in catalogue.LAYERS)


def test_evaluation_rows(spark):
    df = spark.createDataFrame([(0.8,), (None,)], "score double")
    rows = embedding.evaluation_rows(df, spark.createDataFrame([(0.6,)], "score double"))
    assert {tuple(r) for r in rows.collect()} == {(0.8, 1), (0.6, 0)}
    assert roc_auc(rows).first()["roc_auc"] == 1.0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables not present")
def test_surveyed_keeps_every_sighting(spark):
    views = Views(spark, "/root/testdata/sf0.001")
    kept = surveyed(views)
    assert kept.select("occ_id", "species", "yr").exceptAll(views.sighting.select("occ_id", "species", "yr")).isEmpty()
    assert kept.count() == views.sighting.count()
    cells = views.pixel.select("cx", "cy", "elevation")
    high, all_over = (d.agg(F.avg("elevation")).first()[0] for d in (kept.join(cells, ["cx", "cy"]), cells))
    assert high > all_over + 300
    assert kept.where((F.floor("lon") != F.col("cx")) | (F.floor("lat") != F.col("cy"))).isEmpty()


@pytest.fixture(scope="module")
def choices(spark, world):
    """Tables for configured runs: layers on grids of 30, 100 and 300 m; one unit of coordinates is 100 m."""
    static, yearly, points, edges = world
    named = edges.withColumns({"cntr_code": F.lit("AT"), "nuts_name": F.lit("Tirol")})
    west = F.least("x1", F.lit(20.0)), F.least("x2", F.lit(20.0))
    county = named.select(west[0].alias("x1"), "y1", west[1].alias("x2"), "y2", "cntr_code", F.lit("West").alias("nuts_name"))
    coarse = spark.range(140).select((F.col("id") % 14).alias("cx"), F.floor(F.col("id") / 14).alias("cy"), F.col("id").cast("double").alias("soil"))
    records = points.select(
        F.col("occ_id").alias("key"), "species", F.col("yr").alias("year"), F.col("lon").alias("decimalLongitude"),
        F.col("lat").alias("decimalLatitude"), F.lit("AT").alias("countryCode"), F.lit(True).alias("hasCoordinate"),
        F.lit("HUMAN_OBSERVATION").alias("basisOfRecord"),
    )
    layers = (run_plan.Layer(static, 100), run_plan.Layer(coarse, 300), run_plan.Layer(yearly, 100))
    return run_plan.Tables(
        records, named, county, layers, datasets={"mine": records.drop("key")}, metres_per_unit=100.0, projected=True
    )


def chosen(**changes):
    return config(**{"species": "s", "country_code": "AT", "data_mode": "deepdive", "year_end": 2022, **changes})


@pytest.mark.parametrize("resolution", [30, 100, 300, 1000])
def test_run_reads_layers_at_its_resolution(choices, resolution):
    picked = chosen(resolution=resolution, selected_layers=("elevation", "soil", "NDVI"))
    found = run_plan.presences(picked, choices)
    land = run_plan.landscape(picked, choices)
    got = {r.sample_id: r for r in pipeline.sampled_presences(picked, found, land).collect()}
    for p in found.collect():
        cx, cy = (math.floor(x / (resolution / 100)) for x in (p.lon, p.lat))
        middle = (2 * cx + 1) * resolution / 2, (2 * cy + 1) * resolution / 2
        x, y = int(middle[0] // 100), int(middle[1] // 100)
        r = got[f"p{p.occ_id}"]
        assert (r.cx, r.cy) == (cx, cy)
        inside = x < 40 and y < 30
        assert r.elevation == (x * 50.0 if inside else None)
        assert r.soil == (int(middle[0] // 300) + 14 * int(middle[1] // 300) if middle[1] < 3000 and middle[0] < 4200 else None)
        dated = inside and p.yr is not None and p.yr != 2021
        assert (r.NDVI is None) == (not dated) and (not dated or r.NDVI == pytest.approx((y + p.yr) % 5 / 5))
    cells = land.map(picked.selected_layers, 2018).dropna().collect()
    assert len({(r.cx, r.cy) for r in cells}) == len(cells) > 0
    assert all(r.elevation == (2 * r.cx + 1) * resolution // 200 * 50.0 for r in cells)


def test_sampling_does_not_move_the_layers(choices):
    picked = chosen(resolution=300, selected_layers=("elevation", "soil"))
    land = run_plan.landscape(picked, choices)
    plan = land.at_points(land.placed(run_plan.presences(picked, choices)).persist(), picked.selected_layers)
    assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()


def test_plans_do_not_grow_with_the_layers(spark):
    """The text of a plan that held the layers before it several times each filled the driver's memory."""
    cells = spark.range(100).selectExpr("id % 10 as cx", "id div 10 as cy")
    layers = tuple(run_plan.Layer(cells.withColumn(f"f{i}", F.col("cx") + i * F.col("cy")), 100) for i in range(4))
    land = Landscape(layers, 100, 1.0)
    points = land.placed(spark.range(70).selectExpr("id as occ_id", "id % 11 + 0.5D as lon", "id % 7 + 0.5D as lat"))
    few, all_of_them = ([f"f{i}" for i in range(n)] for n in (2, 4))
    size = lambda df: len(df._jdf.queryExecution().toString())
    sampled = land.at_points(points, all_of_them)
    assert size(sampled) < 1.5 * size(land.at_points(points, few))
    rows = sampled.collect()
    assert sorted(r.occ_id for r in rows) == list(range(70))
    for r in rows:
        x, y = r.occ_id % 11, r.occ_id % 7
        assert [r[f] for f in all_of_them] == [x + i * y if x < 10 else None for i in range(4)]


def test_configured_run(choices):
    one = run_plan.run(chosen(resolution=300, selected_layers=("elevation", "soil"), whatif_offsets={"elevation": 500.0}), choices, 4.0)
    row = one.results.first().asDict()
    assert {"overall_accuracy", "roc_auc", "elevation", "soil"} <= set(row)
    assert one.surface.agg(F.max("cx")).first()[0] == 12  # 300 m
    assert pipeline.what_if(one).where("delta <> 0").count() > 0  # shifted as the configuration says
    west = run_plan.run(chosen(county_name="West"), choices, 4.0)
    assert west.surface.agg(F.max("cx")).first()[0] == 19  # the county wins, 100 m


def test_configured_run_fails_early(choices):
    for changes, text in (
        ({"country_code": "XX"}, "XX"), ({"county_name": "Nowhere"}, "Nowhere"), ({"selected_layers": ("gone",)}, "gone"),
        ({"data_mode": "own", "dataset_key": "other"}, "other"), ({"model_type": "embedding"}, "mosaic"),
        ({"species": "nobody"}, "no presence"),
    ):
        with pytest.raises(RuntimeError, match=text):
            run_plan.run(chosen(**changes), choices, 4.0)


def test_own_records_without_key_are_numbered(choices):
    picked = chosen(data_mode="own", dataset_key="mine")
    once = run_plan.presences(picked, choices)
    doubled = replace(choices, datasets={"mine": choices.datasets["mine"].unionAll(choices.datasets["mine"])})
    twice = run_plan.presences(picked, doubled)
    assert twice.select("occ_id").distinct().count() == twice.count() == 2 * once.count()
    assert once.select("occ_id").exceptAll(twice.select("occ_id")).isEmpty()


def test_embedding_run_keeps_its_resolution(choices, mosaic):
    # mosaic cells of 100 m: what the configuration asks for makes no difference
    tables = replace(choices, mosaic=run_plan.Layer(mosaic, 100))
    surfaces = [
        run_plan.run(chosen(model_type="embedding", resolution=r, year_start=2019, year_end=2022, county_name="West"), tables, 4.0).surface
        for r in (100, 1000)
    ]
    assert surfaces[0].exceptAll(surfaces[1]).isEmpty()
    assert surfaces[0].count() == 67 * 100  # 30 m cells whose centre lies in 2000 m x 3000 m


def test_notebook_maps(choices, mosaic):
    tables = replace(choices, mosaic=run_plan.Layer(mosaic, 100))
    picked = chosen(selected_layers=("elevation", "soil"), max_depth=3, county_name="West")
    surface = notebook.forest_area(picked, tables, 4.0)
    cells = surface.agg(F.count("*"), F.count_distinct("cx", "cy"), F.min("score"), F.max("score"), F.max("cx")).first()
    assert cells[0] == cells[1] == 67 * 100 and 0 <= cells[2] <= cells[3] <= 1 and cells[4] == 66  # 30 m
    one = notebook.embedding_area(chosen(model_type="embedding", year_start=2019, year_end=2022), tables, 4.0, n_trees=10)
    east = {r[0]: r[1] for r in one.groupBy(F.col("cx") >= 20).agg(F.avg("score")).collect()}
    assert east[True] > east[False] and one.count() == 1200 - 30  # the mosaic's own cells, less a masked column
    with pytest.raises(ValueError, match="embedding"):
        notebook.embedding_area(chosen(model_type="embedding", year_start=2018, year_end=2018, species="nobody"), tables, 4.0)
