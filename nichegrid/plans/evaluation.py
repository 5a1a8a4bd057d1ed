"""Repeated evaluation and permutation importance."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichegrid.operators.joins import broadcast_limit, shuffled
from nichegrid.operators.metrics import roc_auc
from nichegrid.operators.ordering import hash_positions
from nichegrid.plans import forest
from nichegrid.session import cut_lineage

LABEL = "PresAbs"

# Evaluation repeats, permutation repeats and their seed.
SPLITS = 10
PERMUTATIONS = 100
SEED = 42


def stratified_split(
    sample: DataFrame, ids: Sequence[str], train_size: float, seed: int | str, label: str = LABEL
) -> DataFrame:
    """Adds ``is_train``: the first ``train_size`` of each class in key-hash order."""
    counts = {r[label]: r["count"] for r in sample.groupBy(label).count().collect()}  # two rows
    if len(counts) < 2 or min(counts.values()) < 2:
        raise ValueError("each class needs at least two rows to be split")
    limit = F.lit(0)
    for value, n in counts.items():
        share = min(n - 1, max(1, round(n * train_size)))
        limit = F.when(F.col(label) == value, share).otherwise(limit)
    placed = hash_positions(sample, ids, seed, [label], "_position")
    return placed.withColumn("is_train", F.col("_position") < limit).drop("_position")


def repeated_evaluation(
    sample: DataFrame,
    ids: Sequence[str],
    features: Sequence[str],
    n_trees: int = 100,
    max_depth: int = 5,
    train_size: float = 0.7,
    repeats: int = SPLITS,
    seed: int = SEED,
) -> tuple[DataFrame, RandomForestClassificationModel, DataFrame]:
    """(one row of AUC and importances per split, the last model, its test rows)."""
    table = cut_lineage(sample.select(*ids, *features, LABEL))
    vector = forest.feature_vector(features)
    out = model = test = None
    for repeat in range(repeats):
        split = stratified_split(table, ids, train_size, f"{seed}-{repeat}")
        test = split.where(~F.col("is_train")).drop("is_train")
        model = forest.fit(
            split.where("is_train"),
            vector,
            ids,
            n_trees,
            max_depth,
            seed + repeat,
            balanced=True,
            leaf_share=forest.LEAF_SHARE,
        )
        auc = roc_auc(forest.score(model, test, vector))
        row = auc.select(
            F.lit(repeat).alias("repeat"),
            "roc_auc",
            *[F.lit(v).alias(f) for f, v in forest.importances(model, features).items()],
        )
        out = row if out is None else out.unionByName(row)
    return out, model, test


def _shuffles(n: int, repeats: int, seed: int) -> list[tuple[int, int, int]]:
    """(repeat, factor, shift) of permutations ``pos -> (factor * pos + shift) mod n``."""
    out = []
    for r in range(repeats):
        digest = hashlib.md5(f"{seed}-{r}".encode()).digest()
        factor = int.from_bytes(digest[:4], "big") % min(n, 1 << 30) or 1
        while math.gcd(factor, n) != 1:
            factor += 1
        out.append((r, factor, int.from_bytes(digest[4:12], "big") % n))
    return out


def _partner(factor: Column, position: Column, shift: Column, n: int) -> Column:
    """``(factor * position + shift) mod n``; factors are below 2**30, so from 2**33 rows on a long overflows."""
    if n < 1 << 32:
        return F.pmod(factor * position + shift, F.lit(n))
    wide = factor.cast("decimal(10,0)") * position.cast("decimal(19,0)") + shift.cast("decimal(20,0)")
    return F.pmod(wide, F.lit(n).cast("decimal(20,0)")).cast("long")


def permutation_importance(
    model: RandomForestClassificationModel,
    test: DataFrame,
    ids: Sequence[str],
    features: Sequence[str],
    repeats: int = PERMUTATIONS,
    seed: int = SEED,
    label: str = LABEL,
) -> DataFrame:
    """Drop in accuracy when a feature's values change hands, per feature over the repeats.

    Rows are numbered in key-hash order. In repeat r a row takes the feature of the row at
    ``(factor * position + shift) mod n``: a true permutation, found by one equality join, with
    the same shuffle for every feature.
    """
    features = list(features)
    numbered = hash_positions(test.select(*ids, *features, label), ids, seed, name="_pos")
    table = cut_lineage(numbered.select("_pos", label, *[F.col(f).cast("double").alias(f) for f in features]))
    n = table.count()
    if n == 0:
        raise ValueError("no rows to permute")
    plans = F.array(
        *[
            F.struct(F.lit(r).alias("repeat"), F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c"))
            for r, a, c in _shuffles(n, repeats, seed)
        ]
    )
    # spread first: every row turns into repeats x features rows
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = table.repartition(tasks, "_pos").select("*", F.explode(plans).alias("_plan")).withColumn(
        "_partner", _partner(F.col("_plan.a"), F.col("_pos"), F.col("_plan.c"), n)
    )
    partner = table.select(
        F.col("_pos").alias("_partner"), *[F.col(f).alias(f"_other_{f}") for f in features]
    )
    # every row is the partner of one row in each repeat, so no key is hot; `repeats` times the rows look
    # as small to Spark as the table, and must not be the side that is broadcast
    if n <= broadcast_limit(partner):
        joined = own.join(F.broadcast(partner), "_partner")
    else:
        joined = own.repartition(tasks, "_partner").join(shuffled(partner), "_partner")

    def swapped(position: int) -> Column:
        values = [
            F.col(f"_other_{f}") if i == position else F.col(f) for i, f in enumerate(features)
        ]
        return F.struct(F.lit(features[position]).alias("feature"), F.array(*values).alias("values"))

    variants = joined.select(
        label, F.col("_plan.repeat").alias("repeat"),
        F.inline(F.array(*[swapped(i) for i in range(len(features))])),
    )

    def hits(df: DataFrame, vector: Column) -> DataFrame:
        scored = forest.score(model, df, vector)
        return scored.withColumn("_hit", ((F.col("score") >= 0.5).cast("int") == F.col(label)).cast("double"))

    baseline = hits(table, forest.feature_vector(features)).agg(F.avg("_hit")).first()[0]
    drops = (
        hits(variants, forest.array_to_vector("values"))
        .groupBy("feature", "repeat")
        .agg((F.lit(baseline) - F.avg("_hit")).alias("drop"))
    )
    # `repeats` values per feature from here on
    return drops.groupBy("feature").agg(
        F.avg("drop").alias("importance_mean"),
        F.stddev_pop("drop").alias("importance_std"),
        F.percentile("drop", 0.25).alias("q25"),
        F.percentile("drop", 0.5).alias("q50"),
        F.percentile("drop", 0.75).alias("q75"),
    ).orderBy(F.desc("importance_mean"))
