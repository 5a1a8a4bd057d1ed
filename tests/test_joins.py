import pytest
from pyspark.sql import functions as F

from nichegrid.operators import joins, sampling
from nichegrid.operators.joins import has_at_most, lookup_join


@pytest.fixture(scope="module")
def tables(spark):
    facts = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k")
    ).withColumn("k", F.when(F.col("id") == 7, None).otherwise(F.col("k")))
    dim = spark.range(450).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return facts, dim


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize(
    "limits", [{}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "hot_rows": 100}], ids=["small", "even", "salted"]
)
def test_lookup_join_keeps_every_row(tables, how, limits):
    facts, dim = tables
    expected = facts.join(dim, "k", how)
    got = lookup_join(facts, dim, ["k"], how, **limits).select(*expected.columns)
    assert got.count() == expected.count()
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def test_many_hot_keys(tables, monkeypatch):
    facts, dim = tables
    monkeypatch.setattr(joins, "MAX_HOT_KEYS", 3)
    expected = facts.join(dim, "k", "left")
    got = lookup_join(facts, dim, ["k"], "left", broadcast_rows=0, hot_rows=1).select(*expected.columns)
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def test_hot_key_is_spread(spark):
    facts = spark.range(4000).select("id", F.lit(1).alias("k"))
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = lookup_join(facts, dim, ["k"], broadcast_rows=0, hot_rows=100)
    assert "_salt" in out._jdf.queryExecution().analyzed().toString()
    assert out.count() == 4000


def test_has_at_most(spark):
    assert has_at_most(spark.range(5), 5)
    assert not has_at_most(spark.range(6), 5)


def test_a_side_counted_as_large_is_not_broadcast(spark):
    """Spark takes a cache for as small as it is packed; millions of rows of it went to the driver."""
    facts = spark.range(1000).select(F.col("id").alias("k"))
    dim = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v")).persist()
    assert dim.count() == 1000
    for limits in ({"hot_rows": 100}, {"hot_rows": 0}):
        out = lookup_join(facts, dim, ["k"], broadcast_rows=10, **limits)
        assert out.count() == 1000
        hot = "_salt" in out._jdf.queryExecution().analyzed().toString()
        assert hot == (limits["hot_rows"] == 0)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan


def test_layers_and_sightings_are_not_broadcast_beyond_the_count(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 10)
    cells = spark.range(500).select(F.col("id").alias("cx"), F.lit(0).cast("long").alias("cy"))
    rows, small = sampling._hits(cells, cells.withColumn("elevation", F.lit(1.0)), ["elevation"], ["cx", "cy"])
    assert not small and rows.count() == 500
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
