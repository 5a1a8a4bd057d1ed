"""Maximum entropy by its published equivalence to weighted logistic regression.

Fithian & Hastie (2013) and Phillips et al. (2017): presences against a heavily weighted
background with linear, quadratic, product and hinge features under an L1 penalty, and the
complementary log-log transform of the linear predictor as output.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL = "PresAbs"

# Fixed values of the published method: background weight and penalty scale.
BACKGROUND_WEIGHT = 100.0
PENALTY = 0.5


@dataclass(frozen=True)
class MaxentModel:
    features: tuple[str, ...]
    ranges: dict[str, tuple[float, float]]
    knots: dict[str, tuple[float, ...]]
    regression: LogisticRegressionModel
    centre: float

    def predictor(self, df: DataFrame) -> DataFrame:
        return _linear_predictor(self.regression, df, expand(self.features, self.ranges, self.knots))

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Cloglog suitability, 0 to 1."""
        eta = self.predictor(df)
        return eta.withColumn(
            name, F.lit(1.0) - F.exp(-F.exp(F.col("_eta") - F.lit(self.centre)))
        ).drop("_eta")


def expand(
    features: Sequence[str],
    ranges: dict[str, tuple[float, float]],
    knots: dict[str, tuple[float, ...]],
) -> Column:
    """Feature vector; values beyond the training range are clamped to it."""

    def scaled(f: str) -> Column:
        low, high = ranges[f]
        span = (high - low) or 1.0
        return F.least(
            F.greatest((F.col(f).cast("double") - F.lit(low)) / F.lit(span), F.lit(0.0)), F.lit(1.0)
        )

    linear = {f: scaled(f) for f in features}
    out = list(linear.values())
    out += [x * x for x in linear.values()]
    out += [linear[a] * linear[b] for a, b in combinations(features, 2)]
    for f in features:
        for k in knots[f]:
            out.append(F.greatest(linear[f] - k, F.lit(0.0)) / (1 - k))
            out.append(F.greatest(F.lit(k) - linear[f], F.lit(0.0)) / k)
    return array_to_vector(F.array(*out))


def _linear_predictor(model: LogisticRegressionModel, df: DataFrame, vector: Column) -> DataFrame:
    extra = {
        model.featuresCol: "_features",
        model.rawPredictionCol: "_raw",
        model.probabilityCol: "",
        model.predictionCol: "",
    }
    out = model.copy(extra).transform(df.withColumn("_features", vector))
    return out.withColumn("_eta", vector_to_array("_raw")[1]).drop("_features", "_raw")


def fit(
    train: DataFrame,
    features: Sequence[str],
    n_knots: int = 8,
    regularisation: float = 1.0,
    max_iter: int = 50,
    tolerance: float = 1e-5,
    label: str = LABEL,
) -> MaxentModel:
    features = tuple(features)
    sums = train.agg(
        F.sum(F.col(label).cast("long")).alias("_p"),
        F.count("*").alias("_n"),
        *[F.min(f).cast("double").alias(f"min_{f}") for f in features],
        *[F.max(f).cast("double").alias(f"max_{f}") for f in features],
    ).first()
    presences = sums["_p"] or 0
    background = sums["_n"] - presences
    if not presences or not background:
        raise ValueError("both classes are needed to train")
    ranges = {f: (sums[f"min_{f}"], sums[f"max_{f}"]) for f in features}

    steps = [i / (n_knots + 1) for i in range(1, n_knots + 1)]
    quantiles = train.select(*[F.col(f).cast("double") for f in features]).approxQuantile(
        list(features), steps, 0.001
    )
    knots = {}
    for f, cuts in zip(features, quantiles):
        low, high = ranges[f]
        span = (high - low) or 1.0
        at = sorted({(c - low) / span for c in cuts})
        knots[f] = tuple(k for k in at if 0 < k < 1)

    rows = train.select(
        F.col(label).cast("double").alias("label"),
        F.when(F.col(label) == 1, 1.0).otherwise(BACKGROUND_WEIGHT).alias("weight"),
        expand(features, ranges, knots).alias("features"),
    )
    total_weight = presences + BACKGROUND_WEIGHT * background
    penalty = regularisation * PENALTY / math.sqrt(presences) * presences / total_weight
    model = LogisticRegression(
        labelCol="label",
        weightCol="weight",
        elasticNetParam=1.0,
        regParam=penalty,
        maxIter=max_iter,
        tol=tolerance,
    ).fit(rows)

    # mean predictor under the fitted density of the background; the intercept cancels
    eta = _linear_predictor(
        model, train.where(F.col(label) == 0), expand(features, ranges, knots)
    ).select("_eta")
    top = eta.agg(F.max("_eta")).first()[0]
    density = F.exp(F.col("_eta") - F.lit(top))
    centre = eta.agg(F.sum(density * F.col("_eta")) / F.sum(density)).first()[0]
    return MaxentModel(features, ranges, knots, model, centre)
