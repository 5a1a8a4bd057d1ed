"""Rank correlation of predictors and pruning of redundant ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.operators.joins import lookup_join
from nichegrid.operators.ordering import running_totals
from nichegrid.session import cut_lineage

CLUSTER_DISTANCE = 0.35


def average_ranks(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Each feature replaced by its average rank, for rows that have every feature.

    Features are ranked together in long form; equal values are counted once, and the ranks
    return to the rows through a join that splits hot values.
    """
    # read once, then counted and ranked: sums of doubles may come out otherwise when they are made again
    complete = cut_lineage(
        df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).dropna(subset=list(features))
    )
    long = complete.unpivot(list(ids), list(features), "feature", "value")
    counted = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    ranked = cut_lineage(
        running_totals(counted, "value", ["n"], ["feature"]).select(
            "feature", "value", "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank")
        )
    )
    rows = ranked.select("feature", "value", F.col("n").alias("_rows"))
    return (
        lookup_join(long, ranked.drop("n"), ["feature", "value"], counts=rows)
        .groupBy(*ids)
        .agg(*[F.max(F.when(F.col("feature") == f, F.col("rank"))).alias(f) for f in features])
    )


def pairwise_ranks(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Columns ``_i_j``: average rank of feature i among the rows that also have feature j.

    One pass ranks a feature against all its partners: a value is counted once with how many of
    its rows have each partner, and the running sums of these counts are its ranks. Where the
    partner is missing ``_j_i`` is null, and ``_i_j`` means nothing.
    """
    places = range(len(features))
    number = [F.col(f).cast("double") for f in features]
    known = cut_lineage(df.select(*ids, *[F.when(~F.isnan(n), n).alias(f"_f{i}") for i, n in enumerate(number)]))
    held = [F.col(f"_f{i}").isNotNull().cast("long").alias(f"_n{i}") for i in places]
    values = [f"_f{i}" for i in places]
    counted = (
        known.select(*held, *values)
        .unpivot([f"_n{j}" for j in places], values, "_feature", "_value")
        .where("_value is not null")
        .groupBy("_feature", "_value")
        .agg(*[F.sum(f"_n{j}").alias(f"_n{j}") for j in places], F.count("*").alias("_rows"))
    )
    ranked = cut_lineage(
        running_totals(counted, "_value", [f"_n{j}" for j in places], ["_feature"]).select(
            "_feature", "_value", "_rows",
            *[(F.col(f"_n{j}_before") + (F.col(f"_n{j}") + 1) / 2).alias(f"_rank{j}") for j in places],
        )
    )
    long = known.unpivot(list(ids), values, "_feature", "_value").where("_value is not null")
    keys = ["_feature", "_value"]
    return (
        lookup_join(long, ranked.drop("_rows"), keys, counts=ranked.select(*keys, "_rows"))
        .groupBy(*ids)
        .agg(
            *[
                F.max(F.when(F.col("_feature") == f"_f{i}", F.col(f"_rank{j}"))).alias(f"_{i}_{j}")
                for i in places
                for j in places
                if i != j
            ]
        )
    )


def spearman(
    df: DataFrame, ids: Sequence[str], features: Sequence[str], pairwise: bool = False
) -> DataFrame:
    """Spearman correlation of every feature pair as ``(feature_a, feature_b, rho)``.

    ``pairwise`` ranks each pair on the rows complete for that pair; otherwise a row must have
    every feature. Needs a unique ``ids`` key. Without two different ranks on both sides rho is null.
    """
    pairs = list(combinations(features, 2))
    if pairwise:
        ranks = pairwise_ranks(df, ids, features)
        corr = [F.corr(f"_{i}_{j}", f"_{j}_{i}") for i, j in combinations(range(len(features)), 2)]
    else:
        ranks = average_ranks(df, ids, features)
        corr = [F.corr(a, b) for a, b in pairs]
    wide = ranks.agg(*[c.alias(f"_r{i}") for i, c in enumerate(corr)])
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"_r{i}").alias("rho"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(F.inline(entries))


def ward_clusters(distance: np.ndarray, cut: float = CLUSTER_DISTANCE) -> list[int]:
    """Cluster label per item: Ward linkage on a small distance matrix, cut at a height.

    Uses the published Lance-Williams update for Ward's criterion.
    """
    d2 = {
        (i, j): float(distance[i, j]) ** 2
        for i, j in combinations(range(len(distance)), 2)
    }
    members = {i: [i] for i in range(len(distance))}
    fresh = len(distance)
    while d2:
        (a, b), least = min(d2.items(), key=lambda item: (item[1], item[0]))
        if least**0.5 > cut:
            break
        na, nb = len(members[a]), len(members[b])
        for k in members:
            if k in (a, b):
                continue
            nk = len(members[k])
            ak = d2.pop((min(a, k), max(a, k)))
            bk = d2.pop((min(b, k), max(b, k)))
            d2[(k, fresh)] = ((na + nk) * ak + (nb + nk) * bk - nk * least) / (na + nb + nk)
        del d2[(a, b)]
        members[fresh] = members.pop(a) + members.pop(b)
        fresh += 1
    labels = [0] * len(distance)
    for label, items in enumerate(sorted(members.values(), key=min)):
        for i in items:
            labels[i] = label
    return labels


def keep_one_per_cluster(
    rho: Mapping[tuple[str, str], float], features: Sequence[str], cut: float = CLUSTER_DISTANCE
) -> list[str]:
    """First feature, in column order, of each cluster of correlated features."""
    n = len(features)
    distance = np.zeros((n, n))
    for i, j in combinations(range(n), 2):
        value = rho.get((features[i], features[j]), rho.get((features[j], features[i])))
        distance[i, j] = distance[j, i] = 1 - abs(value if value is not None else 0.0)
    labels = ward_clusters(distance, cut)
    return [f for i, f in enumerate(features) if labels.index(labels[i]) == i]


def prune_features(
    df: DataFrame, ids: Sequence[str], features: Sequence[str], cut: float = CLUSTER_DISTANCE
) -> DataFrame:
    """Features to keep. Only the feature-by-feature matrix comes to the driver."""
    rho = {(r["feature_a"], r["feature_b"]): r["rho"] for r in spearman(df, ids, features).collect()}
    kept = keep_one_per_cluster(rho, features, cut)
    rows = [(i, f, f in kept) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "position int, feature string, kept boolean")
