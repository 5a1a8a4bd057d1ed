"""Random forests on sample tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichegrid.config import MAX_TREE_DEPTH

LABEL = "PresAbs"

# Share of rows in a tree's bag, smallest leaf as a share of the rows, and the
# forest grown on embedding bands.
BAG_FRACTION = 0.8
LEAF_SHARE = 0.1
EMBEDDING_TREES, EMBEDDING_DEPTH = 500, 5


def feature_vector(features: Sequence[str]) -> Column:
    return array_to_vector(F.array(*[F.col(f).cast("double") for f in features]))


def stable_order(df: DataFrame, ids: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Fixed placement and order of rows, because bagging draws per partition."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *ids).sortWithinPartitions(*ids)


def class_weights(train: DataFrame, label: str = LABEL) -> tuple[Column, int]:
    """Weight that gives both classes the same total, and the number of rows."""
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}  # two rows
    n = sum(counts.values())
    if len(counts) < 2:
        raise ValueError("both classes are needed to train")
    weight = F.when(F.col(label) == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))
    return weight, n


def fit(
    train: DataFrame,
    vector: Column,
    ids: Sequence[str],
    n_trees: int,
    max_depth: int,
    seed: int = 42,
    balanced: bool = False,
    leaf_share: float = 0.0,
    label: str = LABEL,
) -> RandomForestClassificationModel:
    """Forest with real tree depth; reproducible for a seed and a set of keys."""
    if not 1 <= max_depth <= MAX_TREE_DEPTH:
        raise ValueError(f"max_depth must lie between 1 and {MAX_TREE_DEPTH}")
    weight, n = class_weights(train, label)
    rows = train.select(
        *ids,
        F.col(label).cast("double").alias("label"),
        vector.alias("features"),
        (weight if balanced else F.lit(1.0)).alias("weight"),
    )
    learner = RandomForestClassifier(
        numTrees=n_trees,
        maxDepth=max_depth,
        subsamplingRate=BAG_FRACTION,
        minInstancesPerNode=max(1, math.ceil(leaf_share * n)),
        seed=seed,
        labelCol="label",
        featuresCol="features",
        weightCol="weight",
    )
    ordered = stable_order(rows, ids).persist()  # read once per tree level
    try:
        return learner.fit(ordered)
    finally:
        ordered.unpersist()


def score(
    model: RandomForestClassificationModel, df: DataFrame, vector: Column, name: str = "score"
) -> DataFrame:
    """Probability of presence for every row."""
    extra = {
        model.featuresCol: "_features",
        model.rawPredictionCol: "",
        model.predictionCol: "",
        model.probabilityCol: "_probability",
    }
    scored = model.copy(extra).transform(df.withColumn("_features", vector))
    return scored.withColumn(name, vector_to_array("_probability")[1]).drop("_features", "_probability")


def importances(model: RandomForestClassificationModel, features: Sequence[str]) -> dict[str, float]:
    return dict(zip(features, model.featureImportances.toArray().tolist()))
