"""The number of clusters: three measures each name a k, and the majority wins."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusfold.operators.cluster import MAX_ITER, RESTARTS, SEED, Fit, assign_all, fit_all
from corpusfold.operators.quality import METRICS, labelling_metrics

MAX_CLUSTERS = 10


class Sweep(NamedTuple):
    metrics: DataFrame
    fits: list[Fit]
    n: int


def check_max_clusters(max_clusters: int) -> None:
    if max_clusters < 3:
        raise ValueError("max_clusters must be at least 3, so that there is a choice beyond k = 2")


def candidate_ks(n: int, max_clusters: int = MAX_CLUSTERS) -> list[int]:
    """2 to ``max_clusters``, but always fewer clusters than rows."""
    return list(range(2, min(max_clusters, n - 1) + 1))


def sweep_k(df: DataFrame, max_clusters: int = MAX_CLUSTERS, features: str = "features",
            restarts: int = RESTARTS, seed: int = SEED, max_iter: int = MAX_ITER,
            silhouette: str = "squared") -> Sweep:
    """Best fit and metrics for every candidate k. Pass a written table of vectors."""
    n = df.count()
    ks = candidate_ks(n, max_clusters)
    if not ks:
        return Sweep(df.sparkSession.createDataFrame([], METRICS), [], n)
    fits = fit_all(df, ks, features, restarts, seed, max_iter)
    labelled = assign_all(df.select(features), [f.centers for f in fits], features)
    return Sweep(labelling_metrics(labelled, ks, features, "labels", silhouette), fits, n)


def k_candidates(metrics: DataFrame) -> DataFrame:
    """``k, priority`` of each measure's choice: best silhouette, best Calinski-Harabasz, elbow.

    The elbow is the k at which the second difference of the distortion starts to be least; it needs
    three values of k. Of equal values the smallest k is taken. The table holds one row per k
    tried, so one task orders it.
    """
    by_k = Window.orderBy("k")
    bend = (F.lead("distortion", 2).over(by_k) - 2 * F.lead("distortion", 1).over(by_k)
            + F.col("distortion"))
    ranked = metrics.withColumn("bend", bend)

    def first(priority: int, column: F.Column) -> DataFrame:
        return (ranked.filter(F.col("bend").isNotNull()) if priority == 2 else ranked).orderBy(
            column, "k").limit(1).select("k", F.lit(priority).alias("priority"))

    return (first(0, F.desc("silhouette")).unionAll(first(1, F.desc("calinski")))
            .unionAll(first(2, F.asc("bend"))))


def vote_k(candidates: DataFrame) -> DataFrame:
    """The k named most often; of a tie, the one named first."""
    return (candidates.groupBy("k").agg(F.count("*").alias("votes"), F.min("priority").alias("priority"))
            .orderBy(F.desc("votes"), "priority").limit(1).select("k"))


def select_k(metrics: DataFrame, n: int) -> DataFrame:
    """One row ``k``: 1 for two rows or fewer, else the vote held within ``2 .. n-1``."""
    if n <= 2:
        return metrics.sparkSession.createDataFrame([(1,)], "k int")
    return vote_k(k_candidates(metrics)).select(
        F.least(F.greatest("k", F.lit(2)), F.lit(n - 1)).cast("int").alias("k"))
