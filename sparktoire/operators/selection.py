"""Deterministic sampling, rankings and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparktoire.functions import expressions as X
from sparktoire.operators.storage import written


def hash_order(column: str, seed: int = 0) -> Column:
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f"#{seed}")))


def per_class_sample(metadata: DataFrame, most: int, seed: int = 0, label: str = "disease", key: str = "specimen_label") -> DataFrame:
    """At most ``most`` specimens of each class, by the order of a hash."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(key, seed), key))
    return metadata.withColumn("__r", rank).where(F.col("__r") <= most).drop("__r")


def stratified_people(metadata: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """So many participants of each disease and fold; those of several specimens come first."""
    people = metadata.groupBy("participant_label", "disease", "CV_fold").agg(F.countDistinct("specimen_label").alias("n_specimens"))
    order = [F.desc(F.col("n_specimens") > 1), hash_order("participant_label", seed), "participant_label"]
    return people.withColumn("__r", F.row_number().over(Window.partitionBy("disease", "CV_fold").orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def convergent_items(df: DataFrame, least: int, item: str = "cdr3_aa", label: str = "disease", specimen: str = "repertoire_id") -> DataFrame:
    """Items in so many specimens of a class."""
    return df.groupBy(label, item).agg(F.countDistinct(specimen).alias("n_specimens")).where(F.col("n_specimens") >= least)


def biased_sample(df: DataFrame, items: DataFrame, most_items: int, size: int, seed: int = 0, specimen: str = "repertoire_id", order: str = "ord") -> DataFrame:
    """Of each specimen, some rows with convergent items first, then any others up to ``size``."""
    marked = df.join(items.select("disease", "cdr3_aa").distinct().withColumn("__hit", F.lit(1)), ["disease", "cdr3_aa"], "left").withColumn("__hit", F.coalesce("__hit", F.lit(0)))
    hits = F.row_number().over(Window.partitionBy(specimen, "__hit").orderBy(hash_order(order, seed), order))
    first = F.when((F.col("__hit") == 1) & (F.col("__n") <= most_items), 0).otherwise(1)
    ranked = marked.withColumn("__n", hits).withColumn("__r", F.row_number().over(Window.partitionBy(specimen).orderBy(first, hash_order(order, seed), order)))
    return ranked.where(F.col("__r") <= size).drop("__hit", "__n", "__r")


def candidate_ranking(candidates: DataFrame) -> DataFrame:
    """By mean score, then the strategy's priority, then the larger threshold."""
    return candidates.withColumn("position", F.row_number().over(Window.orderBy(F.desc("mean_mcc"), "priority", F.desc("threshold"))))


def top_confusions(cells: DataFrame, k: int = 5) -> DataFrame:
    return cells.where("true_class <> predicted_class").orderBy(F.desc("n"), "true_class", "predicted_class").limit(k)


# ---- quality-control reports ------------------------------------------------------------------


STEPS = ("n_raw", "dropped_productive", "dropped_v_score", "dropped_residues", "n_kept")


def step_counts(raw: DataFrame, *keys: str) -> DataFrame:
    """Per participant or other keys, in one pass: rows, and rows that each of the first steps drops.

    The counts are an aggregation and no metrics of a run, so they stay right when tasks are run again.
    """
    productive = F.coalesce(X.airr_boolean(F.col("productive")) == "T", F.lit(False))
    scored = F.coalesce(F.col("v_score") > X.V_SCORE_LEAST["TCR"], F.lit(False))
    other = X.has_other_residues(X.unspaced(F.col("cdr3_aa")))
    reached = F.when(~productive, "dropped_productive").when(~scored, "dropped_v_score").when(other, "dropped_residues").otherwise("n_kept")
    marked = raw.select(*(keys or ("participant_label",)), reached.alias("__step"))
    return marked.groupBy(*(keys or ("participant_label",))).agg(F.count(F.lit(1)).alias("n_raw"), *(F.count_if(F.col("__step") == s).alias(s) for s in STEPS[1:]))


def by_participant(counts: DataFrame) -> DataFrame:
    """Step counts of finer keys summed by participant."""
    return counts.groupBy("participant_label").agg(*(F.sum(s).alias(s) for s in STEPS))


def people_and_steps(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The metadata and the step counts of all participants, which all reports read, from one pass over the rows.

    A row per specimen is written, of which both are made.
    """
    each = written(step_counts(raw, "participant_label", "repertoire_id", "disease", "CV_fold"))
    return each.select("participant_label", F.col("repertoire_id").alias("specimen_label"), "disease", "CV_fold"), by_participant(each)


def filter_effectiveness(steps: DataFrame) -> DataFrame:
    """``step, n_dropped, share``: what each step drops of the rows that reach it."""
    sums = steps.agg(*(F.sum(c).cast("long").alias(c) for c in STEPS[:-1]))
    reach, rows = F.col("n_raw"), []
    for step in ("productive", "v_score", "residues"):
        rows.append(F.struct(F.lit(step).alias("step"), F.col(f"dropped_{step}").alias("n_dropped"), (F.col(f"dropped_{step}") / F.nullif(reach, F.lit(0))).alias("share")))
        reach = reach - F.col(f"dropped_{step}")
    return sums.select(F.inline(F.array(*rows)))


def fold_by_disease(metadata: DataFrame, diseases: list[str]) -> DataFrame:
    """Participants of each fold, a column per disease."""
    return metadata.groupBy("CV_fold").pivot("disease", diseases).agg(F.countDistinct("participant_label")).na.fill(0)


def specimen_statistics(metadata: DataFrame, steps: DataFrame, gate: DataFrame) -> DataFrame:
    """One row per specimen with its participant's counts; participants without one keep a row."""
    x = metadata.select("participant_label", "specimen_label", "CV_fold")
    return steps.join(x, "participant_label", "left").join(gate.withColumnRenamed("repertoire_id", "specimen_label"), "specimen_label", "left")


def summary_report(metadata: DataFrame, steps: DataFrame) -> DataFrame:
    """``category, metric, value``."""
    people = metadata.agg(F.countDistinct("participant_label").alias("participants"), F.countDistinct("specimen_label").alias("specimens"), F.countDistinct("disease").alias("diseases"))
    rows = steps.agg(*(F.sum(c).alias(c) for c in STEPS))
    parts = [("dataset", people, people.columns), ("rows", rows, rows.columns)]
    out = None
    for category, df, names in parts:
        long = df.select(F.lit(category).alias("category"), F.expr(f"stack({len(names)}, {', '.join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)}) AS (metric, value)"))
        out = long if out is None else out.unionByName(long)
    return out


def stage_report(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median, extremes and sample deviation by key."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_samp(value).alias("deviation"))


def class_counts(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("disease").agg(F.countDistinct("participant_label").alias("n_participants"), F.count("*").alias("n_rows"))
