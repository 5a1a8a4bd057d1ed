"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

FOLDER = Path("/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def canonical(rows):
    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
        return str(x)

    return sorted(tuple(cell(x) for x in row) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    out = QUERIES[name](spark, str(FOLDER))
    columns = sorted(out.columns)
    wanted = duck.sql(ORACLES[name])
    assert columns == sorted(wanted.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    expected = duck.sql(f"select {listed} from ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in out.select(*columns).collect()]
    assert expected, "the oracle returns nothing to compare"
    assert canonical(got) == canonical(expected)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["roc_auc"]


def test_whole_embedding_run_is_registered():
    assert {"embedding_run", "embedding_run_auc"} <= set(QUERIES) and "embedding_run" in ORACLES


def test_evaluation_sample_stops_at_its_limit(spark, tmp_path):
    """More presences than the SQL asks for; the smallest tables have fewer."""
    vectors = spark.range(250).selectExpr("id as vec_id", "array(float(id)) as embedding", "int(id % 2) as label")
    vectors.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    wanted = con.sql(ORACLES["eval_sample"]).fetchall()
    got = QUERIES["eval_sample"](spark, str(tmp_path)).collect()
    assert len(wanted) == 100 and {r[0] for r in got} == {r[0] for r in wanted} and len(got) == 100
