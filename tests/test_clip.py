import numpy as np
import pytest

from nichegrid.operators import clip as clip_module
from nichegrid.operators.clip import clip, rings_to_edges


def star(rng, cx, cy, r, n):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    radius = r * rng.uniform(0.4, 1, n)
    return list(zip((cx + radius * np.cos(angle)).tolist(), (cy + radius * np.sin(angle)).tolist()))


def edges_of(name, ring):
    return [(name, *map(float, p), *map(float, q)) for p, q in zip(ring, ring[1:] + ring[:1])]


def brute_force(points, edges):
    out = set()
    for name in {e[0] for e in edges}:
        e = np.array([r[1:] for r in edges if r[0] == name])
        for i, (px, py) in enumerate(points):
            s = e[(e[:, 1] > py) != (e[:, 3] > py)]
            at = (s[:, 2] - s[:, 0]) * (py - s[:, 1]) / (s[:, 3] - s[:, 1]) + s[:, 0]
            if (px < at).sum() % 2:
                out.add((i, name))
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(7)
    stairs = [(20, 0), (24, 0), (24, 2), (22, 2), (22, 4), (20, 4)]
    edges = (
        edges_of("a", star(rng, 0, 0, 5, 300))
        + edges_of("a", star(rng, 12, 0, 3, 40))  # second part
        + edges_of("a", [(11.5, -0.5), (12.5, -0.5), (12.5, 0.5), (11.5, 0.5)])  # hole
        + edges_of("b", star(rng, 3, 1, 4, 30))  # overlaps the first
        + edges_of("r", stairs)  # corners on tile borders
    )
    points = np.vstack([rng.uniform([-6, -6], [26, 6], (4000, 2)), rng.integers(-12, 52, (1500, 2)) / 2])
    schema = "region string, x1 double, y1 double, x2 double, y2 double"
    return (
        spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, lon double, lat double"),
        spark.createDataFrame(edges, schema),
        brute_force(points, edges),
    )


@pytest.mark.parametrize("tile, crowded", [(0.5, 256), (2.0, 4), (100.0, 8), (None, 256)])
def test_clip_equals_brute_force(world, tile, crowded):
    points, edges, expected = world
    got = clip(points, edges, tile=tile, crowded=crowded).select("id", "region").collect()
    assert len(got) == len(expected)
    assert {tuple(r) for r in got} == expected


def test_clip_without_broadcast(world, monkeypatch):
    points, edges, expected = world
    monkeypatch.setattr(clip_module, "INDEX_ROWS", 0)
    got = clip(points, edges, tile=1.0).select("id", "region").collect()
    assert {tuple(r) for r in got} == expected


@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_tiles_that_stay_crowded(world, monkeypatch, chunk):
    points, edges, expected = world
    monkeypatch.setattr(clip_module, "CHUNK_EDGES", chunk)
    twice = points.unionByName(points.where("id % 5 = 0"))
    got = clip(twice, edges, tile=4.0, crowded=10_000).select("id", "region").collect()
    assert {tuple(r) for r in got} == expected
    assert len(got) == len(expected) + sum(i % 5 == 0 for i, _ in expected)


@pytest.mark.parametrize("tile, decimals", [(0.07, 2), (0.05, 3), (0.01, 2), (0.3, 1)])
def test_points_on_tile_borders(spark, tile, decimals):
    rng = np.random.default_rng(3)
    steps = np.arange(0, 1, tile)
    border = np.stack([rng.choice(steps, 500), rng.choice(steps, 500)], 1)
    points = np.round(np.vstack([rng.uniform(0, 1, (1500, 2)), border]), decimals)
    square = edges_of("all", [(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0)])
    well = edges_of("part", [(0.07, 0.07), (0.63, 0.05), (0.7, 0.35), (0.14, 0.7)])
    schema = "region string, x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, lon double, lat double")
    got = clip(df, spark.createDataFrame(square + well, schema), tile=tile, crowded=2).select("id", "region").collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_force(points, square + well))
    assert sum(r["region"] == "all" for r in got) == len(points)


def test_clip_plan_has_no_nested_loop(world):
    points, edges, _ = world
    plan = clip(points, edges, tile=1.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_open_ring_is_closed(spark):
    ring = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]]
    df = spark.createDataFrame([("t", ring)], "name string, rings array<array<struct<x:double,y:double>>>")
    assert rings_to_edges(df, keep=("name",)).count() == 3
