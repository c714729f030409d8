"""Which clusters belong to a disease: exact right-tail tests, centroids and specimen scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sparktoire.operators.clustering import BLOCK, consensus, nearest_centroids


def log_factorial(n: Column) -> Column:
    """Natural logarithm of ``n!``: exact up to 20, Stirling's series beyond."""
    x = n.cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(n <= 20, F.ln(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def fisher_right_tail(a: Column, cluster: Column, label: Column, total: Column) -> Column:
    """P(X >= a) of a hypergeometric count: ``cluster`` drawn from ``total``, ``label`` of them marked."""
    terms = F.transform(F.sequence(a, F.least(cluster, label)), lambda x: F.when(cluster - x <= total - label, F.exp(_log_choose(label, x) + _log_choose(total - label, cluster - x) - _log_choose(total, cluster))).otherwise(0.0))
    return F.when(a <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def cluster_participants(clustered: DataFrame, keys: list[str], label: str = "disease") -> DataFrame:
    """Distinct participants of each cluster and class."""
    return clustered.groupBy(*keys, label).agg(F.countDistinct("participant_label").alias("n_participants"))


def fisher_scores(clustered: DataFrame, keys: list[str], label: str = "disease") -> DataFrame:
    """``keys, disease, p_value`` of every cluster and class; classes that a cluster lacks get 1."""
    per_class = clustered.groupBy(label).agg(F.countDistinct("participant_label").alias("in_class"))
    total = per_class.agg(F.sum("in_class").alias("total"))
    counts = cluster_participants(clustered, keys, label)
    sizes = counts.groupBy(*keys).agg(F.sum("n_participants").alias("in_cluster"))
    # one row for each cluster and class is the result itself; classes and totals are a few rows
    grid = sizes.crossJoin(F.broadcast(per_class)).crossJoin(F.broadcast(total)).join(counts, [*keys, label], "left")
    p = fisher_right_tail(F.coalesce("n_participants", F.lit(0)), F.col("in_cluster"), F.col("in_class"), F.col("total"))
    return grid.select(*keys, label, F.coalesce("n_participants", F.lit(0)).cast("long").alias("n_participants"), "in_cluster", "in_class", p.alias("p_value"))


def significant(scores: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Clusters whose least p-value is at most the largest candidate threshold."""
    return scores.groupBy(*keys).agg(F.min("p_value").alias("least_p")).where(F.col("least_p") <= most)


def centroids(clustered: DataFrame, order: str = "ord") -> DataFrame:
    """The consensus of each cluster, weighted by clone size."""
    return consensus(clustered, [*BLOCK, "cluster"], "cdr3", "weight", order)


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are there more than once; an empty result is what a 1:1 join needs."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def specimen_scores(hits: DataFrame, predictive: DataFrame, specimens: DataFrame, label: str = "disease") -> DataFrame:
    """Distinct predictive clusters of each specimen and class, 0 where it has none, and who abstains.

    A specimen abstains if it hits no predictive cluster of any class.
    """
    keys = [*BLOCK, "cluster"]
    joined = hits.join(predictive.select(*keys, label), keys)
    counts = joined.groupBy("specimen_label", label).agg(F.countDistinct(*keys).alias("score"))
    grid = specimens.select("specimen_label").distinct().crossJoin(F.broadcast(predictive.select(label).distinct()))
    full = grid.join(counts, ["specimen_label", label], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    scored = counts.select("specimen_label").distinct().withColumn("scored", F.lit(True))
    return full.join(scored, "specimen_label", "left").withColumn("abstained", F.col("scored").isNull()).drop("scored")


def assigned(sequences: DataFrame, known: DataFrame, identity: float) -> DataFrame:
    """Every row with the cluster of its nearest centroid, found once per distinct sequence."""
    near = nearest_centroids(sequences, known, identity)
    return sequences.join(near, [*BLOCK, "cdr3"], "left")
