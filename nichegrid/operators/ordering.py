"""Global order statistics without a single-task window.

A window with no ``partitionBy`` (or over a handful of giant groups) runs in one task. Here
every group is first cut into value buckets of about equal size, the window runs inside a
bucket, and a small per-bucket total supplies what lies below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichegrid.functions.hashing import key_digest
from nichegrid.operators.joins import broadcast_limit, has_at_most, lookup_join

# groups larger than this leave the in-memory percentile aggregate
LARGE_GROUP = 200_000
# a counted table of this many rows may be ordered by one task
WINDOW_ROWS = 100_000
BUCKET_ROWS, MIN_BUCKETS, MAX_BUCKETS = 1_000_000, 64, 8192
_STRIDE = 64
# leading bits of a value by which a quantile is narrowed down at a time; a divisor of 64
RADIX_BITS = 16
# hex digits of a key hash by which rows are counted before a sample is drawn
PREFIX_DIGITS = 4


def _bucket_of(value: Column, bounds: Column) -> Column:
    """Number of bounds at or below ``value``: a coarse step, then one stride of the array."""
    coarse = F.expr(f"filter(_bounds, (b, i) -> i % {_STRIDE} = 0)")
    coarse_hits = F.size(F.filter(coarse, lambda b: b <= value))
    start = F.greatest(coarse_hits - 1, F.lit(0)) * _STRIDE
    fine = F.slice(bounds, start + 1, F.lit(_STRIDE))
    return start + F.size(F.filter(fine, lambda b: b <= value))


def running_totals(
    df: DataFrame,
    value: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    buckets: int | None = None,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Exclusive running sums of ``sums`` in ``value`` order, per group ``by``.

    ``df`` must hold each (group, value) once; aggregate before calling. Adds
    ``<sum>_before`` and the group's ``<sum>_total``. The number of groups must be small
    (features, regions, one): each carries up to ``buckets`` bounds, by default one per
    BUCKET_ROWS rows of the table. A table counted to fit one
    task takes a plain window instead.
    """
    df = df.persist()
    if has_at_most(df, window_rows):
        below = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*by)
        return df.select(
            "*",
            *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_before") for c in sums],
            *[F.sum(c).over(whole).alias(f"{c}_total") for c in sums],
        )
    keys = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(1))
    if buckets is None:
        buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, df.count() // BUCKET_ROWS))
    probabilities = F.expr(f"array({', '.join(f'{i / buckets}D' for i in range(1, buckets))})")
    bounds = base.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(value, probabilities, F.lit(10 * buckets))).alias(
            "_bounds"
        )
    )
    placed = _attach(base, bounds, keys).withColumn(
        "_bucket", _bucket_of(F.col(value), F.col("_bounds"))
    ).drop("_bounds")

    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1
    )
    within = placed.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in sums]
    )
    # at most `buckets` rows per group from here on
    below = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = (
        placed.groupBy(*keys, "_bucket")
        .agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
        .select(
            *keys,
            "_bucket",
            *[F.coalesce(F.sum(f"_t_{c}").over(below), F.lit(0)).alias(f"_off_{c}") for c in sums],
            *[F.sum(f"_t_{c}").over(whole).alias(f"{c}_total") for c in sums],
        )
    )
    out = _attach(within, offsets, [*keys, "_bucket"])
    kept = [c for c in df.columns]
    return out.select(
        *kept,
        *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"{c}_before") for c in sums],
        *[F.col(f"{c}_total") for c in sums],
    )


def _attach(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Join the per-group table: at most groups x buckets rows, one row when ungrouped."""
    if "_all" in keys:
        return rows.join(F.broadcast(small), keys)
    return lookup_join(rows, small, keys)


def ordered_bits(value: Column) -> Column:
    """A whole number that sorts as the double does; both zeros are one, NaN is the greatest."""
    plain = value.cast("double") + F.lit(0.0)
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(bits)


def exact_quantile(
    df: DataFrame, value: str, q: float, by: Sequence[str] = (), name: str = "quantile",
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Exact interpolated quantile per group, for groups of any size and skew.

    Values are counted by their leading bits, which combines before the shuffle, and only rows of
    the buckets that hold the wanted ranks are looked at again with RADIX_BITS more, until these
    buckets are small or single values. No window is longer than 2**RADIX_BITS or ``window_rows``
    rows. Nulls are left out; null keys are a group.
    """
    by = list(by)
    base = df.where(F.col(value).isNotNull()).select(
        F.struct(*[F.col(c) for c in by] or [F.lit(1).alias("_all")]).alias("_key"),
        F.col(value).cast("double").alias("_v"),
        ordered_bits(F.col(value)).alias("_bits"),
    )

    def prefix(shift: int) -> Column:
        return F.shiftright("_bits", shift).alias("_prefix")

    def covers(rank: str) -> Column:
        return (F.col("_before") <= F.col(rank)) & (F.col(rank) < F.col("_before") + F.col("_n"))

    shift = 64 - RADIX_BITS
    position = (F.sum("_n").over(Window.partitionBy("_key")) - 1) * F.lit(float(q))
    below = Window.partitionBy("_key").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    state = (
        base.groupBy("_key", prefix(shift))
        .agg(F.count("*").alias("_n"))
        .withColumn("_at", position)
        .select(
            "_key", "_prefix", "_n", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"),
            F.floor("_at").alias("_low"), F.ceil("_at").alias("_high"), (F.col("_at") - F.floor("_at")).alias("_frac"),
        )
        .where(covers("_low") | covers("_high"))
        .persist()
    )

    def split(part: str) -> DataFrame:
        """Rows of the state's buckets, counted by ``part`` and put in its order."""
        own = state.select("_key", "_prefix", F.col("_before").alias("_base"), "_low", "_high", "_frac")
        inside = Window.partitionBy("_key", "_prefix").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        placed = base.select("_key", prefix(shift), "_v", finer.alias("_next"))
        keys = ["_key", "_prefix"]
        few = buckets <= broadcast_limit(own)
        counted = (
            (placed.join(F.broadcast(own), keys) if few else lookup_join(placed, own, keys))
            .groupBy("_key", "_prefix", "_base", "_low", "_high", "_frac", part)
            .agg(F.count("*").alias("_n"))
        )
        before = F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
        return counted.withColumn("_before", before).where(covers("_low") | covers("_high"))

    finer = F.lit(0)
    buckets, most = state.agg(F.count("*"), F.max("_n")).first()
    while shift > 0 and (most or 0) > window_rows:
        finer = F.shiftright("_bits", shift - RADIX_BITS)
        coarse, state = state, split("_next").select(
            "_key", F.col("_next").alias("_prefix"), "_n", "_before", "_low", "_high", "_frac"
        ).persist()
        buckets, most = state.agg(F.count("*"), F.max("_n")).first()
        coarse.unpersist()
        shift -= RADIX_BITS
    picked = (
        split("_v")
        .groupBy("_key")
        .agg(
            F.max(F.when(covers("_low"), F.col("_v"))).alias("_lo"),
            F.max(F.when(covers("_high"), F.col("_v"))).alias("_hi"),
            F.max("_frac").alias("_frac"),
        )
    )
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")
    return picked.select(*[F.col("_key").getField(c).alias(c) for c in by], between.alias(name))


def group_median(
    df: DataFrame, value: str, by: Sequence[str], name: str, large_group: int = LARGE_GROUP
) -> DataFrame:
    """Exact median for very many groups (one per cell).

    Ordinary groups use Spark's exact ``median``. Groups above ``large_group`` rows are taken
    out by a counted key list and go through :func:`exact_quantile`.
    """
    by = list(by)
    present = df.where(F.col(value).isNotNull())
    counts = present.groupBy(*by).count()
    large = counts.where(F.col("count") > large_group).select(*by).persist()
    if has_at_most(large, 0):
        return present.groupBy(*by).agg(F.median(value).alias(name))
    flagged = lookup_join(present, large.withColumn("_large", F.lit(True)), by, "left")
    small = flagged.where(F.col("_large").isNull()).groupBy(*by).agg(F.median(value).alias(name))
    big = exact_quantile(flagged.where(F.col("_large")).drop("_large"), value, 0.5, by, name)
    return small.unionByName(big)


def hash_positions(
    df: DataFrame,
    ids: Sequence[str],
    seed: int | str = "",
    by: Sequence[str] = (),
    name: str = "position",
    digits: int = 4,
) -> DataFrame:
    """0-based position of each row in key-hash order, per group.

    The leading ``digits`` hex digits of the hash are the bucket: they are uniform, so the
    16**digits windows are even however the keys or groups are skewed.
    """
    keys = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(1))
    hashed = base.withColumn("_digest", key_digest(ids, seed)).withColumn(
        "_bucket", F.substring("_digest", 1, digits)
    )
    below = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*keys, "_bucket")
        .count()
        .select(*keys, "_bucket", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_digest", *ids)
    placed = hashed.withColumn("_in", F.row_number().over(inside))
    return _attach(placed, offsets, [*keys, "_bucket"]).select(
        *df.columns, (F.col("_off") + F.col("_in") - 1).cast("long").alias(name)
    )


def hash_sample(
    df: DataFrame, n: int, ids: Sequence[str], seed: int | str = "", by: Sequence[str] = ()
) -> DataFrame:
    """The first ``n`` rows (per group) in key-hash order: a sample of any size, any partitioning.

    Rows are first counted per leading digits of their hash, which combines before the shuffle; the
    digits at which ``n`` rows are reached filter the scan. Only what is left, ``n`` rows and those of
    one more prefix, is shuffled and put in order.
    """
    keys = list(by) or ["_all"]
    base = (df if by else df.withColumn("_all", F.lit(1))).withColumn(
        "_prefix", F.substring(key_digest(ids, seed), 1, PREFIX_DIGITS)
    )
    so_far = Window.partitionBy(*keys).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        base.groupBy(*keys, "_prefix")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(so_far), F.lit(0)))
        .where(F.col("_before") < n)
        .groupBy(*keys)
        .agg(F.max("_prefix").alias("_cut"))
    )
    near = _attach(base, cut, keys).where(F.col("_prefix") <= F.col("_cut")).select(*df.columns)
    near = near.persist()  # counted by bucket, then numbered
    return (
        hash_positions(near, ids, seed, by, "_position").where(F.col("_position") < n).drop("_position")
    )
