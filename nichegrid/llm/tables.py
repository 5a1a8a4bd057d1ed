"""Reading the text tables, and the small expressions the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nichegrid.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is.

    ``lower`` does the same for a text without letters beyond ASCII and is faster, so only the
    other texts go through ``translate``.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, upper, upper.lower())).otherwise(
        F.lower(text)
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: a cut that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def document_key(text: str = "text") -> Column:
    """What makes a row one document: its id and a hash of its text.

    Rows that repeat a document share the key, rows that only share an id do not; a missing id is a
    value like any other, since structs compare field by field.
    """
    return F.struct(F.col("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text"))
