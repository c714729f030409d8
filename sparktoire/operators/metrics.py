"""Evaluation over long tables: ``specimen_label, true_class, class, score``, with abstentions aside.

Every metric is a few aggregations and windows; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def predicted(scores: DataFrame) -> DataFrame:
    """The class of the highest score of each specimen; the first one on ties."""
    best = F.max_by("class", F.struct("score", -F.col("class_index")))
    return scores.groupBy("specimen_label", "true_class").agg(best.alias("predicted_class"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("true_class", "predicted_class").agg(F.count("*").alias("n"))


def confusion_grid(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs of classes, with each row's shares; rows without specimens have 0."""
    grid = classes.select(F.col("class").alias("true_class")).crossJoin(F.broadcast(classes.select(F.col("class").alias("predicted_class"))))
    full = grid.join(confusion(pairs), ["true_class", "predicted_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("true_class"))
    return full.withColumn("share", F.coalesce(F.col("n") / F.nullif(total, F.lit(0)), F.lit(0.0)))


def accuracy(pairs: DataFrame, abstained: DataFrame) -> DataFrame:
    """Abstentions count as wrong."""
    counts = pairs.agg(F.count_if(F.col("true_class") == F.col("predicted_class")).alias("correct"), F.count("*").alias("scored"))
    all_counts = counts.crossJoin(F.broadcast(abstained.agg(F.count("*").alias("abstained"))))
    whole = F.col("scored") + F.col("abstained")
    return all_counts.select("correct", "scored", "abstained", (F.col("correct") / F.nullif(whole, F.lit(0))).alias("accuracy"), (F.col("abstained") / F.nullif(whole, F.lit(0))).alias("abstention_rate"))


def mcc(pairs: DataFrame) -> DataFrame:
    """Matthews correlation over all classes; 0 where it isn't defined."""
    cells = confusion(pairs)
    t = cells.groupBy("true_class").agg(F.sum("n").alias("t")).withColumnRenamed("true_class", "class")
    p = cells.groupBy("predicted_class").agg(F.sum("n").alias("p")).withColumnRenamed("predicted_class", "class")
    margins = t.join(p, "class", "full").na.fill(0, ["t", "p"])
    m = margins.agg(F.sum(F.col("t") * F.col("p")).cast("double").alias("tp"), F.sum(F.col("t") * F.col("t")).cast("double").alias("tt"), F.sum(F.col("p") * F.col("p")).cast("double").alias("pp"))
    c = cells.agg(F.sum(F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0)).cast("double").alias("c"), F.sum("n").cast("double").alias("s"))
    below = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return m.crossJoin(c).select(F.coalesce((F.col("c") * F.col("s") - F.col("tp")) / F.nullif(below, F.lit(0.0)), F.lit(0.0)).alias("mcc"))


#: Fixed value: the class that abstained specimens are predicted as; no specimen has it.
ABSTAINED = "UNKNOWN99"


def mcc_with_abstention(pairs: DataFrame, abstained: DataFrame, label: str = ABSTAINED) -> DataFrame:
    """Abstained specimens are predicted as a class that no specimen has."""
    return mcc(pairs.select("true_class", "predicted_class").unionByName(abstained.select("true_class", F.lit(label).alias("predicted_class"))))


def class_report(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support; 0 where a denominator is."""
    hit = F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0)
    cells = confusion(pairs)
    t = cells.groupBy(F.col("true_class").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    p = cells.groupBy(F.col("predicted_class").alias("class")).agg(F.sum("n").alias("n_predicted"))
    x = classes.select("class").join(t, "class", "left").join(p, "class", "left").na.fill(0, ["support", "tp", "n_predicted"])
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    x = x.withColumns({"precision": ratio(F.col("tp"), F.col("n_predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    both = F.col("precision") + F.col("recall")
    return x.select("class", "precision", "recall", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0)), F.lit(0.0)).alias("f1"), "support")


def auroc(df: DataFrame, keys: list[str], positive: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve of each key by average ranks; null with one class only."""
    y = F.col(positive)
    points = df.groupBy(*keys, score).agg(F.sum(y).alias("p"), F.count(F.lit(1)).alias("m"))
    window = Window.partitionBy(*keys).orderBy(score)
    rank = F.sum("m").over(window) - (F.col("m") - 1) / 2
    sums = points.withColumn("__rank", rank).groupBy(*keys).agg(F.sum(F.when(F.col("p") > 0, F.col("p") * F.col("__rank"))).alias("r"), F.sum("p").alias("p"), F.sum(F.col("m") - F.col("p")).alias("n"))
    return sums.select(*keys, ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auroc"))


def cumulative(df: DataFrame, keys: list[str], positive: str = "y", score: str = "score") -> DataFrame:
    """True and false positives at each distinct score, from the highest down."""
    points = df.groupBy(*keys, score).agg(F.sum(positive).alias("p"), F.sum(1 - F.col(positive)).alias("n"))
    down, whole = Window.partitionBy(*keys).orderBy(F.desc(score)), Window.partitionBy(*keys)
    return points.select(*keys, score, F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(whole).alias("positives"), F.sum("n").over(whole).alias("negatives"), F.col("p").alias("here"))


def auprc(df: DataFrame, keys: list[str], positive: str = "y", score: str = "score") -> DataFrame:
    """Average precision: the sum of each recall step times its precision."""
    x = cumulative(df, keys, positive, score)
    return x.groupBy(*keys).agg(F.sum(F.col("here") / F.nullif(F.col("positives"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("auprc"))


def at_threshold(df: DataFrame, keys: list[str], threshold: float = 0.5, positive: str = "y", score: str = "score") -> DataFrame:
    """Sensitivity and specificity of each key if scores from a threshold on are positive; null where a class is missing."""
    hit, y = F.col(score) >= threshold, F.col(positive) == 1
    return df.groupBy(*keys).agg((F.count_if(hit & y) / F.nullif(F.count_if(y), F.lit(0))).alias("sensitivity"), (F.count_if(~hit & ~y) / F.nullif(F.count_if(~y), F.lit(0))).alias("specificity"))


def with_all_classes(scores: DataFrame) -> DataFrame:
    """Scores of 0 for true classes that have no scores of their own."""
    missing = scores.select(F.col("true_class").alias("class")).distinct().join(scores.select("class").distinct(), "class", "left_anti")
    specimens = scores.drop("class", "class_index", "score").distinct()
    more = specimens.join(F.broadcast(missing), F.lit(True)).withColumns({"class_index": F.lit(None).cast("int"), "score": F.lit(0.0)})
    return scores.unionByName(more, allowMissingColumns=True)


def curves(df: DataFrame, keys: list[str]) -> DataFrame:
    """Points of the ROC and precision-recall curves; keys that lack a class are skipped."""
    x = cumulative(df, keys).where("positives > 0 AND negatives > 0")
    return x.select(*keys, F.col("score").alias("threshold"), (F.col("tp") / F.col("positives")).alias("tpr"), (F.col("fp") / F.col("negatives")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def youden(df: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold of the largest ``tpr - fpr``, the highest one on ties."""
    j = F.col("tpr") - F.col("fpr")
    return curves(df, keys).groupBy(*keys).agg(F.max_by(F.struct("threshold", "tpr", "fpr"), F.struct(F.round(j, 12), "threshold")).alias("b")).select(*keys, F.col("b.threshold").alias("threshold"), F.col("b.tpr").alias("sensitivity"), (1 - F.col("b.fpr")).alias("specificity"))


def one_vs_rest(scores: DataFrame) -> DataFrame:
    return scores.withColumn("y", (F.col("true_class") == F.col("class")).cast("int"))


def one_vs_one(scores: DataFrame) -> DataFrame:
    """Rows of each ordered pair of classes: specimens of either, by the score of the first.

    A specimen is in one row for each other class, so rows grow with the number of classes only.
    """
    classes = scores.select(F.col("class").alias("other")).distinct()
    own = scores.where("true_class = class").join(F.broadcast(classes), F.col("other") != F.col("class")).select("class", "other", F.lit(1).alias("y"), "score")
    rest = scores.where("true_class <> class").select("class", F.col("true_class").alias("other"), F.lit(0).alias("y"), "score")
    return own.unionByName(rest)


def multiclass(scores: DataFrame, metric=auroc, name: str = "auroc") -> DataFrame:
    """``ovr_macro, ovr_weighted, ovo_macro, ovo_weighted`` of a binary metric."""
    ovr = metric(one_vs_rest(scores), ["class"])
    support = scores.where("true_class = class").groupBy("class").agg(F.count("*").alias("support"))
    r = ovr.join(support, "class", "left").na.fill(0, ["support"]).agg(F.avg(name).alias("ovr_macro"), (F.sum(F.col(name) * F.col("support")) / F.sum(F.when(F.col(name).isNotNull(), F.col("support")))).alias("ovr_weighted"))
    pairs = metric(one_vs_one(scores), ["class", "other"])
    a, b = F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")
    both = pairs.groupBy(a, b).agg(F.avg(name).alias("v"))
    both = both.join(support.select(F.col("class").alias("a"), F.col("support").alias("na")), "a").join(support.select(F.col("class").alias("b"), F.col("support").alias("nb")), "b")
    w = F.col("na") + F.col("nb")
    return r.crossJoin(both.agg(F.avg("v").alias("ovo_macro"), (F.sum(F.col("v") * w) / F.sum(w)).alias("ovo_weighted")))


def log_loss(scores: DataFrame, renormalize: bool, eps: float = 2.0**-52) -> DataFrame:
    """Mean negative logarithm of the true class's score, cut to ``[eps, 1 - eps]``."""
    p = F.col("score") / F.nullif(F.sum("score").over(Window.partitionBy("specimen_label")), F.lit(0.0)) if renormalize else F.col("score")
    cut = F.greatest(F.least(F.col("p"), F.lit(1 - eps)), F.lit(eps))
    return scores.withColumn("p", p).where("true_class = class").agg(F.avg(-F.ln(cut)).alias("log_loss"))


def fold_summary(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean and sample deviation over folds, nulls left out; the deviation of one fold is 0."""
    return values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("std"), F.count(value).alias("n_folds"))


def class_weights(df: DataFrame, label: str = "disease") -> DataFrame:
    """Balanced weights ``n / (k n_c)``, scaled to sum 1."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    raw: Column = 1 / F.col("n")
    return counts.withColumn("weight", raw / F.sum(raw).over(Window.partitionBy(F.lit(1))))
