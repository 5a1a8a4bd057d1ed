import random

import numpy as np
import pytest

from nichegrid.llm import near_dedup
from nichegrid.llm.components import components
from tests.llm.conftest import words


def shingles(text, size):
    own = (text or "").encode().lower().split()
    if len(own) < size:
        return frozenset([tuple(own)] if own else [])
    return frozenset(tuple(own[i : i + size]) for i in range(len(own) - size + 1))


def brute(pairs, size, percent):
    """{(doc_id, text): (n_shingles, component_id)}; ids are unique or missing once."""
    sets = {p: shingles(p[1], size) for p in set(pairs)}
    parent = {p: p for p in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets, key=lambda p: (p[0] is not None, p[0] or 0))
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                one, two = sorted((find(a), find(b)), key=keys.index)
                parent[two] = one
    return {p: (len(sets[p]), find(p)[0]) for p in sets}


def families():
    """Copies with a few to many changed words: some linked with the base, some with another copy only."""
    rng, out = random.Random(4), []
    for f in range(4):
        base = words(rng, 150, 5000)
        for k in range(40):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(150)] = f"new{f}-{rng.randrange(60)}"
            out.append((2000 + 100 * f + k, " ".join(copy)))
        for k in range(12):  # a chain: each differs a little from the one before
            copy[10 * k] = copy[10 * k + 1] = f"chain{k}"
            out.append((5000 + 100 * f + k, " ".join(copy)))
    return out


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, pairs, size, percent):
    rows = [*pairs, *families()]
    schema = "doc_id long, text string, node int, _key string, _doc int"
    df = spark.createDataFrame([(d, t, 1, "k", 2) for d, t in rows], schema).repartition(3)
    expected = brute(rows, size, percent)
    got = near_dedup.judge(df, size, percent).collect()
    assert len(got) == len(rows)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str)
    assert found == sorted(((d, *expected[d, t], d == expected[d, t][1]) for d, t in rows), key=str)
    assert len({c for _, c in expected.values()}) < len(expected) - 80
    kept = near_dedup.keep_one(df, size, percent)
    assert kept.schema == df.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in found if r[3]), key=str)


def test_densified_signatures_agree_as_often_as_the_sets():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(1, 1 << 62, 17, dtype=np.uint64), rng.integers(1, 1 << 62, 3, dtype=np.uint64)
    agree = []
    for seed in range(300):
        salt = np.uint64(rng.integers(1, 1 << 62))
        a, b = np.unique(shared ^ salt), np.unique(np.concatenate([shared, own]) ^ salt)
        agree.append((near_dedup.signature(a, 128) == near_dedup.signature(b, 128)).mean())
    assert np.mean(agree) == pytest.approx(17 / 20, abs=0.02)
    assert near_dedup.donors(np.array([True, False, True])).tolist() == [1, 1, 1]


def test_bands_follow_the_threshold():
    assert near_dedup.bands_for(85) < near_dedup.bands_for(80)
    assert (1 - 0.85**near_dedup.ROWS) ** near_dedup.bands_for(85) <= near_dedup.MISS


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98)] + [(500, 501 + i) for i in range(30)] + [(7, 7)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 98: 98, 99: 98, 100: 98, **dict.fromkeys(range(500, 531), 500)}
    assert components(links.limit(0)).isEmpty()


def test_empty_and_plain_tables(spark, nothing):
    assert near_dedup.judge(nothing).isEmpty() and near_dedup.keep_one(nothing).isEmpty()
    df = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(map(tuple, near_dedup.judge(df).collect()))
    assert got == [(1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
