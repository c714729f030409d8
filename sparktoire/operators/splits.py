"""Participant-level splits: stratified, deterministic, never splitting a participant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Which roles a context has, and whether it belongs to a fold.
CONTEXTS = {
    "cv_single_model": (("train_smaller1", "train_smaller2", "test"), True),
    "cv_ensemble": (("train_smaller1", "train_smaller2", "validation", "test"), True),
    "train_all": (("train_smaller1", "train_smaller2"), False),
    "train_all_ensemble": (("train_smaller1", "train_smaller2", "validation"), False),
}
LEAST_PARTICIPANTS = {"cv_single_model": 2, "train_all": 2, "cv_ensemble": 3, "train_all_ensemble": 3}


def check_context(context: str, role: str | None = None, fold: int | None = None) -> None:
    if context not in CONTEXTS:
        raise ValueError(f"unknown context {context}")
    roles, folded = CONTEXTS[context]
    if role is not None and role not in roles:
        raise ValueError(f"{context} has no role {role}")
    if folded != (fold is not None):
        raise ValueError(f"{context} needs {'a' if folded else 'no'} fold")


def participants(metadata: DataFrame) -> DataFrame:
    return metadata.select("participant_label", "disease").distinct()


def quota_split(people: DataFrame, share: tuple[int, int], seed: int, first: str, rest: str, column: str = "split_role") -> DataFrame:
    """``first`` for a share (a fraction) of each disease's participants, by the order of a hash."""
    order = F.md5(F.concat(F.col("participant_label"), F.lit(f"#{seed}")))
    window = Window.partitionBy("disease")
    rank, n = F.row_number().over(window.orderBy(order, "participant_label")), F.count("*").over(window)
    return people.withColumn(column, F.when(rank * share[1] <= n * share[0], first).otherwise(rest))


def split_roles(metadata: DataFrame, context: str = "cv_ensemble", fold: int | None = None, seed: int = 0) -> DataFrame:
    """``participant_label, disease, split_role`` of everyone: test by fold, then thirds by disease."""
    check_context(context, fold=fold)
    people = participants(metadata)
    parts = []
    if fold is not None:
        test = metadata.where(F.col("CV_fold") == fold).select("participant_label").distinct()
        parts.append(people.join(test, "participant_label", "left_semi").withColumn("split_role", F.lit("test")))
        people = people.join(test, "participant_label", "left_anti")
    if "validation" in CONTEXTS[context][0]:
        split = quota_split(people, (1, 3), seed, "validation", "train")
        parts.append(split.where("split_role = 'validation'"))
        people = split.where("split_role = 'train'").drop("split_role")
    parts.append(quota_split(people, (2, 3), seed + 1, "train_smaller1", "train_smaller2"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def too_few(people: DataFrame, context: str) -> DataFrame:
    """Diseases with fewer participants than the context's roles need."""
    return people.groupBy("disease").agg(F.countDistinct("participant_label").alias("n")).where(F.col("n") < LEAST_PARTICIPANTS[context])


def grouped_folds(people: DataFrame, k: int, seed: int = 0, size: str | None = None) -> DataFrame:
    """Folds of participants that keep the shares of classes even.

    Within each disease participants are dealt to and fro, the largest first if ``size`` names a column of how
    many specimens each has: the sums of two folds then differ by no more than its largest participant.
    """
    order = F.md5(F.concat(F.col("participant_label"), F.lit(f"#{seed}")))
    largest = [F.desc(size)] if size else []
    place = F.row_number().over(Window.partitionBy("disease").orderBy(*largest, order, "participant_label")) - 1
    fold = F.when(F.floor(place / k) % 2 == 0, place % k).otherwise(k - 1 - place % k)
    return people.withColumn("fold", fold.cast("int"))


def cross_validation_cap(metadata: DataFrame, requested: int) -> int:
    """At most as many folds as the rarest class has participants, 2 at least; fewer is an error."""
    least = metadata.groupBy("disease").agg(F.countDistinct("participant_label").alias("n")).agg(F.min("n")).first()[0]
    if least is None or least < 2:
        raise ValueError("a class has fewer than two participants")
    return max(2, min(requested, least))


def unexpected(used: DataFrame, expected: DataFrame) -> DataFrame:
    """Participants that are used and shouldn't be."""
    return used.select("participant_label").distinct().join(expected.select("participant_label"), "participant_label", "left_anti")


def many_valued(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value, where one is required."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def role_summary(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split_role").pivot("disease").agg(F.count(F.lit(1))).na.fill(0)
