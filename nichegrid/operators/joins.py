"""Joins that check sizes before broadcasting and split hot keys when they cannot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_VALUES = 8_000_000
_NESTED_VALUES = 256
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000
MAX_SALTS = 4096


def broadcast_limit(df: DataFrame) -> int:
    """How many rows of this width may be broadcast: BROADCAST_VALUES values in all."""
    width = sum(
        _NESTED_VALUES if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) else 1
        for f in df.schema.fields
    )
    return min(BROADCAST_ROWS, BROADCAST_VALUES // max(width, 1))


def has_at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` holds no more than ``rows`` rows. Only counts travel, never the rows."""
    return df.count() <= rows


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is not to be broadcast, whatever size Spark takes it for."""
    return df.hint("merge")


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    broadcast_rows: int | None = None,
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join of a large, possibly skewed ``facts`` with ``dim`` (``inner`` or ``left``).

    A counted, small ``dim`` is broadcast, so ``facts`` is not shuffled. Otherwise both sides are
    shuffled; a key that holds more than ``hot_rows`` facts is spread over salts, and only the
    ``dim`` rows of such keys are repeated. What was counted as large stays shuffled: Spark's own guess
    from the size of compressed files or caches would bring millions of rows to the driver. ``counts``
    are the facts per key in ``_rows``, where they are known.
    """
    keys = list(keys)
    if has_at_most(dim, broadcast_limit(dim) if broadcast_rows is None else broadcast_rows):
        return facts.join(F.broadcast(dim), keys, how)

    if counts is None:
        counts = facts.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_rows"))
    hot = counts.where(F.col("_rows") > hot_rows).persist()
    if has_at_most(hot, 0):
        return facts.join(shuffled(dim), keys, how)
    if not has_at_most(hot, MAX_HOT_KEYS):
        # no more than MAX_HOT_KEYS keys can each hold more than this share of the rows
        share = hot.agg(F.sum("_rows")).first()[0] // MAX_HOT_KEYS
        hot = hot.where(F.col("_rows") > share)

    # a hot key is spread over as many salts as it has lots of hot_rows; a row's salt comes from where
    # it stands, so equal rows are spread too and any column type will do
    salts = F.least(F.ceil(F.col("_rows") / F.lit(max(hot_rows, 1))), F.lit(MAX_SALTS)).cast("long")
    spread = F.broadcast(hot.select(*keys, salts.alias("_salts")))
    drawn = F.pmod(F.monotonically_increasing_id(), F.col("_salts"))
    left = facts.join(spread, keys, "left").withColumn("_salt", F.coalesce(drawn, F.lit(0).cast("long")))
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1).cast("long")) - 1)
    right = dim.join(spread, keys, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return left.drop("_salts").join(shuffled(right), [*keys, "_salt"], how).drop("_salt")
