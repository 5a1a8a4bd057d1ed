import os

import pytest

import corpus_pipeline
from nichegrid.llm.queries import PIECES_PATH
from tests.llm import test_decontaminate, test_line_dedup, test_near_dedup

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="needs the given tables")

@pytest.fixture(scope="module")
def steps(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test-" + name.replace(" ", "-"))
        out.append(docs)
    return out

def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]

def test_columns(steps):
    for step in steps[:-1]:
        assert step.dtypes == steps[0].dtypes
    assert steps[-1].columns == [*steps[0].columns, "ids"]
    assert [f.__name__ for _, f in corpus_pipeline.STAGES][0] == "quality" and len(corpus_pipeline.STAGES) == 5

def test_stages_equal_brute_force(spark, steps):
    before, after = texts(steps[0]), texts(steps[1])
    assert set(after) < set(before)
    brute = test_line_dedup.brute(after, 8)
    blank = [(d, t) for d, t, n, gone in brute if not (gone and gone == n)]
    assert sorted(texts(steps[2])) == sorted(blank)
    groups = test_near_dedup.brute(texts(steps[2]), 5, 80)
    assert sorted(texts(steps[3])) == sorted(p for p, (_, first) in groups.items() if p[0] == first)
    items = [(r.item_id, r.text) for r in corpus_pipeline.table(spark, SF, "benchmark").collect()]
    clean = {r[0] for r in test_decontaminate.brute(texts(steps[3]), items) if not r[5]}
    assert sorted(texts(steps[4])) == sorted(p for p in texts(steps[3]) if p[0] in clean)

def test_ids_give_the_texts_back(steps):
    from nichegrid.llm import pieces

    decode = pieces.decoder(pieces.load(PIECES_PATH))
    for r in steps[-1].collect():
        assert decode(r.ids).decode() == r.text
    assert sorted(texts(steps[-1])) == sorted(texts(steps[-2]))

def test_queries_are_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
