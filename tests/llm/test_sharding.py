from collections import Counter

import pytest

from nichegrid.llm import sharding


def test_shares_are_fair_and_stable():
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill(names, 1009)
    counts = Counter(table)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.15 * 1009  # few keys move between the shards that stay


@pytest.mark.parametrize("shards, size", [([], 7), (["a", "a"], 7), (["a"], 8), ([f"{i}" for i in range(9)], 7), (["a"], 1 << 21)])
def test_wrong_tables(shards, size):
    with pytest.raises(ValueError):
        sharding.fill(shards, size)


def test_placement(spark, documents, nothing, pairs):
    placed = sharding.place(documents.withColumn("slot", sharding.F.lit("old")))
    assert placed.columns == [*documents.columns, "slot", "shard"] and placed.count() == len(pairs)
    owners = sharding.fill(sharding.SHARDS)
    for r in placed.collect():
        key = str(r.doc_id) if r.doc_id is not None else f"text:{r.text or ''}"
        assert r.slot == sharding._number(key) % sharding.SIZE and r.shard == sharding.SHARDS[owners[r.slot]]
    assert sharding.place(nothing).isEmpty()
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
