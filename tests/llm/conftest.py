"""Small documents that hold every awkward case, shared by the tests of the text operators."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        T.StructField("doc", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("node", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def rows():
    """(doc_id, text) with nulls, empty and long texts, exact and near copies, repeated rows."""
    rng = random.Random(11)
    texts = [" ".join(words(rng, rng.randint(1, 90))) for _ in range(30)]
    base = words(rng, 120)
    texts.append(" ".join(base))
    for _ in range(4):  # near copies
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[3], texts[3], texts[30], "short", "Short", "two words", "a  b\tc", "é É ü\r\nß", "x" * 300]
    texts += ["ab " * 200, "\n".join(["same line here again and again for nothing much"] * 3)]
    texts.append("\n".join([" ".join(words(rng, 12)), "", " ".join(base[:20]), " lead and trail "]))
    texts.append(" ".join(words(rng, 20_000)))
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, (900, None), (901, ""), (902, " \n\t "), (None, "no id at all but words enough here"), out[2], out[2]]


def frame(spark, pairs):
    return spark.createDataFrame(
        [(d, t, "en", "s", len(t) if t is not None else None, "x", "y", 1, 0.5) for d, t in pairs], SCHEMA
    )


@pytest.fixture(scope="session")
def pairs():
    return rows()


@pytest.fixture(scope="session")
def documents(spark, pairs):
    return frame(spark, pairs).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
