"""Model quality and result summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.operators.ordering import running_totals

LABEL = "PresAbs"
LOW_METRIC = 0.7
PROBABILITY_CUT = 0.5
METRIC_COLUMNS = ("repeat", "roc_auc", "overall_accuracy", "excluded_presence_count")


def cut_probability(df: DataFrame, score: str = "score", name: str = "classification") -> DataFrame:
    """1 where the probability reaches one half, else 0."""
    return df.withColumn(name, (F.col(score) >= PROBABILITY_CUT).cast("int"))


def error_matrix(df: DataFrame, label: str = LABEL, predicted: str = "classification") -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, label: str = LABEL, predicted: str = "classification") -> DataFrame:
    """Share of rows on the diagonal of the error matrix."""
    return df.agg(
        F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("overall_accuracy"),
        F.count("*").alias("n"),
    )


def roc_auc(
    df: DataFrame, label: str = LABEL, score: str = "score", by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Exact area under the ROC curve; a tie counts one half.

    Rows collapse to (score, positives, negatives) before anything is ordered. NULL where a
    class is missing.
    """
    positive = F.col(label).cast("long")
    grouped = (
        df.where(F.col(score).isNotNull())
        .groupBy(*by, score)
        .agg(F.sum(positive).alias("_p"), F.sum(1 - positive).alias("_n"))
    )
    ranked = running_totals(grouped, score, ["_n"], by, buckets)
    won = F.sum(F.col("_p") * (F.col("_n_before").cast("double") + F.col("_n") / F.lit(2.0)))
    totals = ranked.groupBy(*by).agg(
        won.alias("_won"), F.sum("_p").alias("_np"), F.sum("_n").alias("_nn")
    )
    pairs = F.col("_np").cast("double") * F.col("_nn").cast("double")
    return totals.select(*by, F.try_divide(F.col("_won"), pairs).alias("roc_auc"))


def importance_rank(results: DataFrame, metrics: Sequence[str] = METRIC_COLUMNS) -> DataFrame:
    """Mean importance of each feature over the runs, highest first; metrics are not features."""
    features = [c for c in results.columns if c not in metrics]
    means = results.agg(*[F.avg(f).alias(f) for f in features])
    return (
        means.unpivot([], features, "feature", "importance")
        .where(F.col("importance").isNotNull())
        .orderBy(F.desc("importance"), "feature")
    )


def metric_flags(results: DataFrame) -> DataFrame:
    """Mean metrics, whether they are low, and the excluded count where there is one."""
    rows = [c for c in ("roc_auc", "overall_accuracy") if c in results.columns]
    aggregates = [F.avg(c).alias(c) for c in rows]
    if "excluded_presence_count" in results.columns:
        aggregates.append(F.max("excluded_presence_count").alias("excluded_presence_count"))
    out = results.agg(*aggregates)
    for c in rows:
        out = out.withColumn(f"{c}_low", F.col(c) < LOW_METRIC)
    if "excluded_presence_count" in results.columns:
        n = F.col("excluded_presence_count")
        out = out.withColumn("excluded_presence_count", F.when(n > 0, n))
    return out
