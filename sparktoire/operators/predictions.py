"""Combining the predictions of several models: alignment, abstention and meta features."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

STRATEGIES = ("ensemble_abstain", "fill_0.5", "fill_models13_mean")


def argmax_class(df: DataFrame, keys: list[str], score: str = "score", order: str = "class_index") -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by("class", F.struct(score, -F.col(order))).alias("predicted_class"))


def binary_pair(metadata: DataFrame, disease: str, reference: str) -> DataFrame:
    """The specimens of participants with either class."""
    people = metadata.where(F.col("disease").isin(disease, reference)).select("participant_label").distinct()
    return metadata.join(people, "participant_label", "left_semi")


def pair_label(disease: str, reference: str) -> str:
    """``expressions.pair_name`` of two given classes."""
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", f"{disease}_vs_{reference}")


def only_folds(metadata: DataFrame, folds: list[int]) -> DataFrame:
    """The specimens of some folds; a fold that isn't there is an error."""
    known = {r[0] for r in metadata.select("CV_fold").distinct().collect()}
    if missing := sorted(set(folds) - known):
        raise ValueError(f"no such folds: {missing}")
    return metadata.where(F.col("CV_fold").isin(*folds))


def class_differences(test: DataFrame, training: DataFrame) -> DataFrame:
    """``disease, status``: shared, extra (only in the test data) or missing (only in training)."""
    a, b = test.select("disease").distinct().withColumn("t", F.lit(1)), training.select("disease").distinct().withColumn("m", F.lit(1))
    status = F.when(F.col("t").isNull(), "missing").when(F.col("m").isNull(), "extra").otherwise("shared")
    return a.join(b, "disease", "full").select("disease", status.alias("status"))


def align_classes(test: DataFrame, training: DataFrame, allow_unknown: bool = False) -> DataFrame:
    """Specimens of trained classes; without any it is an error, with others too unless allowed."""
    status = {r["status"] for r in class_differences(test, training).select("status").distinct().collect()}
    if "shared" not in status:
        raise ValueError("no class of the test data was trained")
    if "extra" in status and not allow_unknown:
        raise ValueError("the test data have classes that were not trained")
    return test.join(training.select("disease").distinct(), "disease", "left_semi")


def assembled(specimens: DataFrame, predictions: DataFrame, models: list[str]) -> DataFrame:
    """A column per model with its class, ``ABSTAINED`` where it has none."""
    wide = predictions.groupBy("specimen_label").pivot("model", models).agg(F.first("predicted_class"))
    return specimens.join(wide, "specimen_label", "left").na.fill("ABSTAINED", models)


def scored_by_all(scores: DataFrame, n_models: int) -> DataFrame:
    """Specimens that every model has scored."""
    return scores.where("score IS NOT NULL").groupBy("specimen_label").agg(F.countDistinct("model").alias("n")).where(F.col("n") == n_models).select("specimen_label")


def meta_features(scores: DataFrame, strategy: str = "ensemble_abstain", second: int | str = 2, drop_inactive: bool = True) -> DataFrame:
    """``specimen_label, model, class, score`` without nulls, by what becomes of the second model's.

    A model that abstained everywhere is left out under every strategy, unless ``drop_inactive`` is false.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    x = scores
    if drop_inactive:
        active = scores.where("score IS NOT NULL").select("model").distinct()
        x = scores.join(F.broadcast(active), "model", "left_semi")
    if strategy == "fill_0.5":
        x = x.withColumn("score", F.when(F.col("model") == second, F.coalesce("score", F.lit(0.5))).otherwise(F.col("score")))
    elif strategy == "fill_models13_mean":
        others = F.avg(F.when(F.col("model") != second, F.col("score"))).over(Window.partitionBy("specimen_label", "class"))
        x = x.withColumn("score", F.when(F.col("model") == second, F.coalesce("score", others)).otherwise(F.col("score")))
    gaps = F.max(F.col("score").isNull()).over(Window.partitionBy("specimen_label"))
    return x.withColumn("__gap", gaps).where(~F.col("__gap")).drop("__gap")


def feature_matrix(features: DataFrame, names: list[str], locus: str = "TCR") -> DataFrame:
    """A column per ``locus:model:class``."""
    named = features.withColumn("feature", F.concat_ws(":", F.lit(locus), F.concat(F.lit("model"), F.col("model")), "class"))
    return named.groupBy("specimen_label").pivot("feature", names).agg(F.first("score"))
