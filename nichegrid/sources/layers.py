"""Layer tables laid out so that later joins on the cell find their rows in place."""

from __future__ import annotations

from pyspark.sql import DataFrame

CELL = ("cx", "cy")


def save_layers(df: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Store a layer table bucketed by cell, under ``path`` if given; a yearly one is also partitioned by year.

    A join on the cell leaves the rows of such a table where they are (:func:`nichegrid.operators.sampling.sample_stored`)
    when it has as many buckets as a shuffle has partitions, or more; a run reads only the years it needs. An
    existing table is left as it is.
    """
    layout = df.repartition(buckets, *CELL).write.mode("ignore").bucketBy(buckets, *CELL).sortBy(*CELL)
    if "yr" in df.columns:
        layout = layout.partitionBy("yr")
    if path is not None:
        layout = layout.option("path", path)
    layout.saveAsTable(table)
