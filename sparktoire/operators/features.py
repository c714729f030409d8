"""Frequencies, pivots and group features. Matrices stay long until a model needs them wide."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sparktoire.functions import expressions as X


def share(value, *keys: str):
    """A value divided by its sum over the keys; null if that is 0."""
    return value / F.nullif(F.sum(value).over(Window.partitionBy(*keys)), F.lit(0))


def vj_frequencies(df: DataFrame, specimen: str = "specimen_label") -> DataFrame:
    """The share of each V-J pair among the rows of a specimen and isotype."""
    key = X.vj_key(F.col("v_gene"), F.col("j_gene"), F.col("isotype_supergroup")).alias("feature")
    counts = df.groupBy(specimen, "isotype_supergroup", key).agg(F.count("*").alias("n"))
    return counts.select(specimen, "isotype_supergroup", "feature", "n", share(F.col("n"), specimen, "isotype_supergroup").alias("frequency"))


def aligned(frequencies: DataFrame, train_features: DataFrame, specimen: str = "specimen_label") -> DataFrame:
    """The cells of the matrix of specimens by training features that aren't 0: unseen features go, rows sum to 1 again."""
    seen = frequencies.join(train_features.select("feature").distinct(), "feature", "left_semi").select(specimen, "feature", "frequency")
    return seen.withColumn("frequency", share(F.col("frequency"), specimen))


def pivoted(long: DataFrame, features: list[str], specimen: str = "specimen_label") -> DataFrame:
    return long.groupBy(specimen).pivot("feature", features).agg(F.first("frequency")).na.fill(0.0)


def zero_rows(cells: DataFrame, specimens: DataFrame, specimen: str = "specimen_label") -> DataFrame:
    """Specimens without any cell."""
    return specimens.select(specimen).distinct().join(cells, specimen, "left_anti")


def common_v_genes(df: DataFrame, quantile: float = 0.5) -> DataFrame:
    """V genes whose share of all rows is at least the quantile of the shares."""
    counts = df.groupBy("v_gene").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.percentile("n", F.lit(quantile)).alias("__cut"))), F.col("n") >= F.col("__cut")).drop("__cut")


def common_v_genes_by_class(df: DataFrame, label: str = "disease", quantile: float = 0.5) -> DataFrame:
    """V genes whose largest share in any class is at least the quantile of these."""
    shares = df.groupBy(label, "v_gene").agg(F.count("*").alias("n")).withColumn("share", share(F.col("n"), label))
    most = shares.groupBy("v_gene").agg(F.max("share").alias("max_share"))
    return most.join(F.broadcast(most.agg(F.percentile("max_share", F.lit(quantile)).alias("__cut"))), F.col("max_share") >= F.col("__cut")).drop("__cut")


def group_frequencies(df: DataFrame, groups: DataFrame, specimen: str = "specimen_label", within: tuple[str, ...] = ()) -> DataFrame:
    """The share of each kept V gene in a specimen (and in ``within``, such as its isotype), after the others have gone."""
    kept = df.join(groups.select("v_gene"), "v_gene", "left_semi")
    return kept.groupBy(specimen, *within, "v_gene").agg(F.count("*").alias("n")).withColumn("frequency", share(F.col("n"), specimen, *within))


def isotype_shares(df: DataFrame, specimen: str = "specimen_label", label: str = "disease") -> DataFrame:
    """The share of each isotype among a specimen's rows, with its mean over the specimens of the class that have it."""
    x = df.groupBy(specimen, label, "isotype_supergroup").agg(F.count(F.lit(1)).alias("n")).withColumn("share", share(F.col("n"), specimen))
    means = x.groupBy(label, "isotype_supergroup").agg(F.avg("share").alias("class_share"))
    return x.join(means, [label, "isotype_supergroup"])


# ---- weighted aggregation of probabilities ----------------------------------------------------

#: ``mean``, ``median``, and two that keep confident rows only: by a share of the largest entropy, or a bound.
STRATEGIES = ("mean", "median", "entropy_cutoff", "entropy_percentile_cutoff")


def entropy_threshold(df: DataFrame, percentile: float = 0.01, p: str = "p") -> float | None:
    """The percentile, of 100, of the rows' entropies; interpolated."""
    return df.agg(F.percentile(X.entropy(F.col(p)), F.lit(percentile / 100))).first()[0]


def aggregated(df: DataFrame, keys: list[str], n_classes: int, strategy: str = "entropy_cutoff", fraction: float = 0.8, threshold: float | None = None, p: str = "p", weight: str = "weight") -> DataFrame:
    """``keys, class_index, probability, n_survived``: a weighted average of each group's arrays.

    Rows at or above the entropy bound don't count; with none left all classes are alike. If the
    weights sum to 0 the mean is plain.
    """
    bound = F.lit(fraction) * F.ln(F.lit(float(n_classes))) if strategy == "entropy_cutoff" else F.lit(threshold) if strategy == "entropy_percentile_cutoff" else None
    counts = F.lit(True) if bound is None else F.coalesce(X.entropy(F.col(p)) < bound, F.lit(False))
    each = df.select(*keys, F.col(weight).cast("double").alias("w"), counts.alias("counts"), F.posexplode(p).alias("class_index", "x"))
    group = [*keys, "class_index"]
    if strategy == "median":
        order = Window.partitionBy(*group).orderBy("x")
        running = each.withColumns({"run": F.sum("w").over(order.rangeBetween(Window.unboundedPreceding, 0)), "total": F.sum("w").over(Window.partitionBy(*group))})
        return running.groupBy(*group).agg(F.min(F.when(F.col("run") >= 0.5 * F.col("total"), F.col("x"))).alias("probability"), F.count("*").alias("n_survived"))
    w, x = F.when(F.col("counts"), F.col("w")), F.when(F.col("counts"), F.col("x"))
    mean = F.when(F.sum(w) != 0, F.sum(w * x) / F.nullif(F.sum(w), F.lit(0.0))).otherwise(F.avg(x))
    return each.groupBy(*group).agg(F.coalesce(mean, F.lit(1.0 / n_classes)).alias("probability"), F.count(x).alias("n_survived"))


def featurized(aggregates: DataFrame, specimens: DataFrame, groups: DataFrame, n_classes: int, specimen: str = "specimen_label", group: str = "v_gene") -> DataFrame:
    """Every specimen, group and class; where a specimen has no rows of a group, all classes are alike."""
    classes = specimens.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class_index"))
    grid = specimens.select(specimen).distinct().crossJoin(groups.select(group).distinct().crossJoin(classes))
    full = grid.join(aggregates, [specimen, group, "class_index"], "left")
    return full.withColumns({"probability": F.coalesce("probability", F.lit(1.0 / n_classes)), "n_survived": F.coalesce("n_survived", F.lit(0))})
