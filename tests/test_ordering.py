import numpy as np
import pytest
from pyspark.sql import functions as F

from nichegrid.functions.hashing import uniform
from nichegrid.operators import ordering
from nichegrid.operators.metrics import roc_auc
from nichegrid.operators.ordering import (
    exact_quantile,
    group_median,
    hash_positions,
    hash_sample,
    running_totals,
)


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n in (("a", 3000), ("b", 501), ("c", 1)) for v in rng.normal(size=n).round(2)]
    rows += [("a", 0.5)] * 1500 + [("b", None)]  # a third of a group on one value
    return rows, spark.createDataFrame(rows, "g string, v double")


@pytest.fixture(params=[0, 100_000], ids=["buckets", "window"])
def window_rows(request, monkeypatch):
    original = running_totals.__defaults__
    monkeypatch.setattr(running_totals, "__defaults__", (*original[:-1], request.param))
    return request.param


def test_running_totals(values, window_rows):
    _, df = values
    counted = df.dropna().groupBy("g", "v").agg(F.count("*").alias("n"))
    got = running_totals(counted, "v", ["n"], ["g"], 64).toPandas()
    for _, group in got.groupby("g"):
        group = group.sort_values("v")
        assert (group["n_before"] == group["n"].cumsum() - group["n"]).all()
        assert (group["n_total"] == group["n"].sum()).all()


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 1.0])
def test_exact_quantile(values, window_rows, q):
    rows, df = values
    got = {r["g"]: r["quantile"] for r in exact_quantile(df, "v", q, ["g"], window_rows=window_rows).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(np.quantile([v for h, v in rows if h == g and v is not None], q))


def test_ungrouped_quantile(values, window_rows):
    rows, df = values
    got = exact_quantile(df, "v", 0.1, window_rows=window_rows).first()["quantile"]
    assert got == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.1))


@pytest.mark.parametrize("rows", [0, 50, 100_000])
def test_quantile_narrowed_by_bits(spark, rows):
    """Signs, zeros, extremes, neighbours in the last bit, a null key and a value that fills a third."""
    near = [float(x) for x in np.nextafter(1.0, 2.0) + np.arange(300) * np.finfo(float).eps]
    wide = [s * 10.0**e for e in range(-300, 300, 7) for s in (-1.0, 1.0)] + [0.0, -0.0, 5e-324, -5e-324]
    rows_of = {"near": near, "wide": wide, None: [2.0] * 200 + near + [-x for x in near[:90]], "one": [7.0]}
    df = spark.createDataFrame([(g, x) for g, xs in rows_of.items() for x in [*xs, None]], "_v string, v double")
    for q in (0.0, 0.31, 0.5, 1.0):
        got = {r["_v"]: r["quantile"] for r in exact_quantile(df, "v", q, ["_v"], window_rows=rows).collect()}
        assert got == {g: pytest.approx(np.quantile(xs, q), rel=1e-15, abs=0) for g, xs in rows_of.items()}
    assert exact_quantile(df.where("v is null"), "v", 0.5, ["_v"], window_rows=rows).isEmpty()


@pytest.mark.parametrize("large_group", [100, 10_000_000])
def test_group_median_large_and_small_groups(values, large_group):
    rows, df = values
    got = {r["g"]: r["m"] for r in group_median(df, "v", ["g"], "m", large_group).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(np.median([v for h, v in rows if h == g and v is not None]))


def test_hash_positions_number_every_group(spark):
    df = spark.range(3000).withColumn("k", F.when(F.col("id") < 2500, "hot").otherwise("cold"))
    got = hash_positions(df, ["id"], 1, ["k"]).toPandas()
    for _, group in got.groupby("k"):
        assert sorted(group["position"]) == list(range(len(group)))
    again = hash_positions(df.repartition(13), ["id"], 1, ["k"]).toPandas()
    assert got.sort_values("id").reset_index(drop=True).equals(again.sort_values("id").reset_index(drop=True))


def test_hash_sample_is_whole_and_stable(spark):
    df = spark.range(1000)
    first = {r["id"] for r in hash_sample(df, 300, ["id"], 3).collect()}
    assert len(first) == 300
    assert first == {r["id"] for r in hash_sample(df.repartition(7), 300, ["id"], 3).collect()}
    assert hash_sample(df, 5000, ["id"], 3).count() == 1000


def test_uniform_survives_repartition(spark):
    df = spark.range(200).withColumn("u", uniform(["id"], 42))
    other = spark.range(200).repartition(9).withColumn("u", uniform(["id"], 42))
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in other.collect()}
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and 0.4 < mean < 0.6


def auc_of(spark, rows):
    return roc_auc(spark.createDataFrame(rows, "PresAbs int, score double")).first()["roc_auc"]


def test_auc_of_known_orders(spark, window_rows):
    perfect = [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)]
    assert auc_of(spark, perfect) == 1.0
    assert auc_of(spark, [(1 - y, s) for y, s in perfect]) == 0.0
    assert auc_of(spark, [(y, 0.5) for y, _ in perfect]) == 0.5
    assert auc_of(spark, [(1, 0.5)]) is None


def test_auc_equals_pair_count_and_library(spark, window_rows):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(3)
    rows = [(int(rng.random() < s), float(s)) for s in rng.random(1200).round(2)]
    pos = np.array([s for y, s in rows if y]); neg = np.array([s for y, s in rows if not y])  # noqa: E702
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert auc_of(spark, rows) == pytest.approx(wins / (len(pos) * len(neg)))
    df = spark.createDataFrame(rows, "label int, score double").withColumn("label", F.col("label").cast("double"))
    library = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert auc_of(spark, rows) == pytest.approx(library)


def test_grouped_auc(spark, window_rows):
    rows = [("x", 1, 0.9), ("x", 0, 0.1), ("y", 1, 0.1), ("y", 0, 0.9)]
    df = spark.createDataFrame(rows, "g string, PresAbs int, score double")
    assert {tuple(r) for r in roc_auc(df, by=["g"]).collect()} == {("x", 1.0), ("y", 0.0)}


def test_bucket_numbers_follow_the_bounds(spark):
    bounds = [float(i) for i in range(0, 200, 2)]
    df = spark.createDataFrame([(float(v), bounds) for v in range(-3, 205)], "v double, _bounds array<double>")
    got = df.select("v", ordering._bucket_of(F.col("v"), F.col("_bounds")).alias("b")).collect()
    for r in got:
        assert r["b"] == sum(b <= r["v"] for b in bounds)
