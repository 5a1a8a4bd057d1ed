import random

import numpy as np
import pytest

from nichegrid.llm import jaccard_join
from tests.llm.conftest import words
from tests.llm.test_near_dedup import brute, families


@pytest.mark.parametrize("percent", [80, 85, 93])
def test_linked_sets_share_a_key(monkeypatch, percent):
    """Whatever the counts of the tokens: rare ones, pairs, triples and mixtures of them."""
    rng = np.random.default_rng(percent)
    seen = {False: 0, True: 0}
    for _ in range(3000):
        n = int(rng.integers(1, 120)) if rng.random() < 0.9 else int(rng.integers(120, 900))
        m = int(rng.integers(n, n * 100 // percent + 1))
        least = -(-percent * (n + m) // (100 + percent))
        common = min(n, least + int(rng.integers(0, 3)))
        if common < least or n == m == common:
            continue
        tokens = rng.integers(1, 1 << 63, n + m - common, dtype=np.uint64)
        kinds = rng.choice([2, 10, 16, 17, 100, 600, 5000], len(tokens), p=rng.dirichlet(np.full(7, 0.3)))
        kinds[rng.random(len(tokens)) < rng.random()] = rng.choice([20, 5000])
        alone = np.arange(len(tokens)) >= common
        kinds[alone & (rng.random(len(tokens)) < 0.5)] = 1

        def keys(own, size):
            held = own[kinds[own] > 1]
            order = held[np.lexsort((tokens[held].view(np.int64), kinds[held]))]
            return jaccard_join.keys_of(size, tokens[order], kinds[order], percent)

        small = keys(np.concatenate([np.arange(common), np.arange(common, n)]), n)
        large = keys(np.concatenate([np.arange(common), np.arange(n, n + m - common)]), m)
        lost = n - least, m - least
        index = np.concatenate([k[level <= lost[0]] for probe, k, level in small if not probe])
        probes = np.concatenate([k[level <= lost[1]] for probe, k, level in large if probe])
        assert len(np.intersect1d(index, probes)), (n, m, common)
        seen[bool((kinds[:common] > jaccard_join.RARE).all())] += 1
    assert min(seen.values()) > 100


def test_sketches_never_tell_more_than_the_sets_differ():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, shared = int(rng.integers(1, 800)), int(rng.integers(0, 800))
        one, two, both = (np.unique(rng.integers(1, 1 << 63, k, dtype=np.uint64)) for k in (n, n, shared))
        a, b = (jaccard_join.sketch(np.unique(np.concatenate([own, both]))) for own in (one, two))
        assert len(a) == jaccard_join.SKETCH
        assert np.unpackbits((a ^ b).view(np.uint8)).sum() <= 2 * n


def test_keys_grow_with_the_set_only():
    rng = np.random.default_rng(8)
    for n in (100, 1000, 20_000):
        tokens = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        for nodes in (100, 100_000):
            keys = jaccard_join.keys_of(n, tokens, np.full(n, nodes), 80)
            assert sum(len(k) for _, k, _ in keys) < 8 * n


def test_first_tokens_keep_every_node_with_a_partner():
    for n in range(1, 400):
        for m in range(n, n * 100 // 80 + 1):
            for one, two in ((n, m), (m, n)):
                first, needed = jaccard_join.looked_at(one, 80)
                extension = min(looked - jaccard_join.missing(s, jaccard_join.smallest(s, 80), 80) for s, looked in ((one, first), (two, jaccard_join.looked_at(two, 80)[0])))
                assert needed <= extension and first >= jaccard_join.missing(one, two, 80) + needed


def templates():
    """Pages of one template with own words: some kinds link, most do not."""
    rng, out = random.Random(9), []
    base = words(rng, 102, 5000)
    for i in range(150):
        page = list(base)
        for j in range(rng.choice((1, 2, 5, 9))):
            page[rng.randrange(102)] = f"own{i}-{j}"
        out.append((9000 + i, " ".join(page)))
    for i in range(30):  # short texts, a word at an end or inside changed
        out.append((9500 + i, " ".join(["tiny"] * (i % 3) + base[: 12 + i % 4] + [f"z{i % 5}"])))
    return out


@pytest.mark.parametrize("classes", [(16, 512), (1, 2), (2, 6)])
def test_equals_brute_force(spark, pairs, monkeypatch, classes):
    monkeypatch.setattr(jaccard_join, "RARE", classes[0])
    monkeypatch.setattr(jaccard_join, "OFTEN", classes[1])
    monkeypatch.setattr(jaccard_join, "COPIES_FOR", 7)
    rows = [*pairs, *families(), *templates()]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, id int, n int, key int")
    expected = brute(rows, 5, 80)
    got = jaccard_join.judge(df.repartition(3)).collect()
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)
    assert found == sorted(((d, *expected[d, t]) for d, t in rows), key=str)
    assert len({c for _, c in expected.values()}) < len(expected) - 80


def test_template_pages_are_not_paired(spark):
    """Pages that share a template but not enough of it: the keys grow with the pages, pairs do not."""
    rng = random.Random(2)
    base = words(rng, 102, 5000)
    counts = {}
    for n in (100, 400):
        pages = []
        for i in range(n):
            page = list(base)
            for j, at in enumerate(rng.sample(range(102), 9)):
                page[at] = f"own{i}-{j}"
            pages.append((i, " ".join(page)))
        df = spark.createDataFrame(pages, "doc_id long, text string")
        got = jaccard_join.judge(df).collect()
        assert len({r.component_id for r in got}) == n
        firsts = jaccard_join._firsts(df, 5, 80)
        nodes = firsts.select("doc", "n", "digest", "shared").withColumn("id", jaccard_join.F.monotonically_increasing_id())
        entries = jaccard_join._entries(jaccard_join._reread(df, nodes, 5), 80)
        counts[n] = entries.groupBy("key").count().selectExpr("sum(count * count)").first()[0] or 0
    assert counts[400] <= 6 * max(counts[100], 400)


def test_percent_is_checked(spark):
    with pytest.raises(ValueError, match="percent"):
        jaccard_join.judge(spark.createDataFrame([(1, "a")], "doc_id long, text string"), percent=50)


def test_empty_and_plain_tables(spark, nothing):
    assert jaccard_join.judge(nothing).isEmpty()
    df = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (4, "A b")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.judge(df).collect())) == [(1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4)]
