"""Splits, metrics, model selection and the ensemble's features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sparktoire.functions import expressions as X
from sparktoire.operators import metrics, predictions, selection, splits
from sparktoire.operators.storage import written
from sparktoire.plans.base import WITH, metadata, query

# ---- splits -----------------------------------------------------------------------------------

_SPLIT = """people AS (SELECT DISTINCT participant_label, disease FROM meta), tst AS (SELECT DISTINCT participant_label FROM meta WHERE CV_fold = 0), rest AS (SELECT * FROM people WHERE participant_label NOT IN (SELECT participant_label FROM tst)),
v AS (SELECT *, row_number() OVER (PARTITION BY disease ORDER BY md5(participant_label || '#0'), participant_label) * 3 <= count(*) OVER (PARTITION BY disease) AS val FROM rest),
t AS (SELECT *, row_number() OVER (PARTITION BY disease ORDER BY md5(participant_label || '#1'), participant_label) * 3 <= count(*) OVER (PARTITION BY disease) * 2 AS small1 FROM v WHERE NOT val),
split AS (SELECT p.participant_label, p.disease, 'test' AS split_role FROM people p JOIN tst USING (participant_label) UNION ALL SELECT participant_label, disease, 'validation' FROM v WHERE val UNION ALL SELECT participant_label, disease, CASE WHEN small1 THEN 'train_smaller1' ELSE 'train_smaller2' END FROM t)"""


@query("v01_split_roles", WITH + f", {_SPLIT} SELECT * FROM split")
def v01(spark, d):
    return splits.split_roles(metadata(spark, d), "cv_ensemble", fold=0)


_SHARES = "p AS (SELECT DISTINCT participant_label, disease, CV_fold = 0 AS held FROM meta), c AS (SELECT unnest(['cv_single_model', 'cv_ensemble', 'train_all', 'train_all_ensemble']) AS context, unnest([true, true, false, false]) AS folded, unnest([false, true, false, true]) AS valid), x AS (SELECT context, valid, p.disease, held AND folded AS test, p.participant_label FROM c CROSS JOIN p), v AS (SELECT *, NOT test AND valid AND row_number() OVER (PARTITION BY context, disease, test ORDER BY md5(participant_label || '#0'), participant_label) * 3 <= count(*) OVER (PARTITION BY context, disease, test) AS val FROM x), t AS (SELECT *, row_number() OVER (PARTITION BY context, disease, test, val ORDER BY md5(participant_label || '#1'), participant_label) * 3 <= count(*) OVER (PARTITION BY context, disease, test, val) * 2 AS small1 FROM v)"


@query("v02_contexts", WITH + f", {_SHARES} SELECT context, CASE WHEN test THEN 'test' WHEN val THEN 'validation' WHEN small1 THEN 'train_smaller1' ELSE 'train_smaller2' END AS split_role, count(*) AS n FROM t GROUP BY ALL")
def v02(spark, d):
    """The participants of each role of each context."""
    x, out = written(metadata(spark, d)), None
    for context, (_, folded) in splits.CONTEXTS.items():
        part = splits.split_roles(x, context, 0 if folded else None).groupBy("split_role").agg(F.count(F.lit(1)).alias("n")).select(F.lit(context).alias("context"), "split_role", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("v03_too_few_participants", WITH + "SELECT disease || '-' || substr(participant_label, 1, 4) AS disease, count(DISTINCT participant_label) AS n FROM meta GROUP BY 1 HAVING count(DISTINCT participant_label) < 3")
def v03(spark, d):
    """Strata of disease and the label's beginning that are too small."""
    return splits.too_few(metadata(spark, d).withColumn("disease", F.concat_ws("-", "disease", F.substring("participant_label", 1, 4))), "cv_ensemble")


@query("v04_grouped_folds", WITH + """, g AS (SELECT participant_label, disease, count(*) AS n_specimens FROM meta GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY disease ORDER BY n_specimens DESC, md5(participant_label || '#0'), participant_label) - 1 AS place FROM g)
SELECT participant_label, disease, n_specimens, CAST(CASE WHEN place // 5 % 2 = 0 THEN place % 5 ELSE 4 - place % 5 END AS INT) AS fold FROM r""")
def v04(spark, d):
    sizes = metadata(spark, d).groupBy("participant_label", "disease").agg(F.countDistinct("specimen_label").alias("n_specimens"))
    return splits.grouped_folds(sizes, 5, size="n_specimens")


@query("v05_unexpected_participants", WITH + f", {_SPLIT} SELECT DISTINCT participant_label FROM meta WHERE participant_label NOT IN (SELECT participant_label FROM split WHERE split_role <> 'validation')")
def v05(spark, d):
    x = metadata(spark, d)
    return splits.unexpected(x, splits.split_roles(x, "cv_ensemble", fold=0).where("split_role <> 'validation'"))


@query("v06_single_split", WITH + "SELECT participant_label, disease, CASE WHEN row_number() OVER (PARTITION BY disease ORDER BY md5(participant_label || '#0'), participant_label) * 3 <= count(*) OVER (PARTITION BY disease) * 2 THEN 'train_smaller1' ELSE 'train_smaller2' END AS split_role FROM (SELECT DISTINCT participant_label, disease FROM meta)")
def v06(spark, d):
    return splits.quota_split(splits.participants(metadata(spark, d)), (2, 3), 0, "train_smaller1", "train_smaller2")


@query("a18_cross_validation_cap", WITH + "SELECT CAST(greatest(2, least(5, min(n))) AS INT) AS n_splits FROM (SELECT count(DISTINCT participant_label) AS n FROM meta GROUP BY disease)")
def a18(spark, d):
    return spark.createDataFrame([(splits.cross_validation_cap(metadata(spark, d), 5),)], "n_splits int")


@query("a26_role_summary", WITH + f", {_SPLIT} SELECT split_role, count(*) FILTER (WHERE disease = 'AUTOMOBILE') AS \"AUTOMOBILE\", count(*) FILTER (WHERE disease = 'BUILDING') AS \"BUILDING\", count(*) FILTER (WHERE disease = 'FURNITURE') AS \"FURNITURE\", count(*) FILTER (WHERE disease = 'HOUSEHOLD') AS \"HOUSEHOLD\", count(*) FILTER (WHERE disease = 'MACHINERY') AS \"MACHINERY\" FROM split GROUP BY 1")
def a26(spark, d):
    return splits.role_summary(splits.split_roles(metadata(spark, d), "cv_ensemble", fold=0))


# ---- scores of a stand-in model, made of the specimens' keys ----------------------------------

CLASSES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_SCORES = """spec AS (SELECT specimen_label, disease AS true_class, CV_fold, CAST(substr(participant_label, 2) AS BIGINT) * 3 + ascii(right(specimen_label, 1)) % 3 AS k FROM meta),
allsc AS (SELECT specimen_label, true_class, CV_fold, k, class, class_index, ((k * 31 + class_index * 17) % 97 + 1 + CASE WHEN class = true_class THEN 30 ELSE 0 END) / 130.0 AS score, k % 11 = 0 AS abstained
  FROM spec, (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS class, unnest([0, 1, 2, 3, 4]) AS class_index)),
sc AS (SELECT specimen_label, true_class, CV_fold, class, class_index, CAST(score AS DOUBLE) AS score FROM allsc WHERE NOT abstained), ab AS (SELECT DISTINCT specimen_label, true_class, CV_fold FROM allsc WHERE abstained),
pr AS (SELECT specimen_label, true_class, CV_fold, arg_max(class, score * 1000000 - class_index) AS predicted_class FROM sc GROUP BY ALL)"""


def _all_scores(spark, d) -> DataFrame:
    k = F.expr("substr(participant_label, 2)").cast("long") * 3 + F.ascii(F.right("specimen_label", F.lit(1))) % 3
    classes = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.lit(i).alias("class_index")) for i, c in enumerate(CLASSES)])).alias("c")
    x = metadata(spark, d).select("specimen_label", F.col("disease").alias("true_class"), "CV_fold", k.alias("k"), classes).select("*", "c.class", "c.class_index").drop("c")
    score = ((F.col("k") * 31 + F.col("class_index") * 17) % 97 + 1 + F.when(F.col("class") == F.col("true_class"), 30).otherwise(0)) / F.lit(130.0)
    return x.withColumns({"score": score, "abstained": F.col("k") % 11 == 0})


def _scores(spark, d) -> tuple[DataFrame, DataFrame]:
    x = _all_scores(spark, d)
    return x.where("NOT abstained").drop("abstained", "k"), x.where("abstained").select("specimen_label", "true_class", "CV_fold").distinct()


def _pairs(spark, d) -> DataFrame:
    return metrics.predicted(_scores(spark, d)[0])


@query("p31_predicted_class", WITH + f", {_SCORES} SELECT specimen_label, true_class, predicted_class FROM pr")
def p31(spark, d):
    return _pairs(spark, d)


@query("e01_accuracy", WITH + f", {_SCORES}, n AS (SELECT (SELECT count(*) FROM pr WHERE true_class = predicted_class) AS correct, (SELECT count(*) FROM pr) AS scored, (SELECT count(*) FROM ab) AS abstained) SELECT *, round(correct / (scored + abstained), 9) AS accuracy, round(abstained / (scored + abstained), 9) AS abstention_rate FROM n")
def e01(spark, d):
    x = metrics.accuracy(_pairs(spark, d), _scores(spark, d)[1])
    return x.withColumns({c: F.round(c, 9) for c in ("accuracy", "abstention_rate")})


def _mcc_sql(source: str) -> str:
    return f"SELECT round(coalesce((c * s - tp) / nullif(sqrt((s * s - pp) * (s * s - tt)), 0), 0), 9) AS mcc FROM (SELECT CAST((SELECT count(*) FROM {source} WHERE true_class = predicted_class) AS DOUBLE) AS c, CAST((SELECT count(*) FROM {source}) AS DOUBLE) AS s, CAST((SELECT sum(coalesce(a.n, 0) * coalesce(b.n, 0)) FROM (SELECT true_class AS k, count(*) AS n FROM {source} GROUP BY 1) a FULL JOIN (SELECT predicted_class AS k, count(*) AS n FROM {source} GROUP BY 1) b USING (k)) AS DOUBLE) AS tp, CAST((SELECT sum(n * n) FROM (SELECT count(*) AS n FROM {source} GROUP BY true_class)) AS DOUBLE) AS tt, CAST((SELECT sum(n * n) FROM (SELECT count(*) AS n FROM {source} GROUP BY predicted_class)) AS DOUBLE) AS pp)"


@query("e02_mcc", WITH + f", {_SCORES} {_mcc_sql('pr')}")
def e02(spark, d):
    return metrics.mcc(_pairs(spark, d)).withColumn("mcc", F.round("mcc", 9))


@query("m03_mcc_with_abstention", WITH + f", {_SCORES}, pa AS (SELECT true_class, predicted_class FROM pr UNION ALL SELECT true_class, 'UNKNOWN99' FROM ab) {_mcc_sql('pa')}")
def m03(spark, d):
    return metrics.mcc_with_abstention(_pairs(spark, d), _scores(spark, d)[1]).withColumn("mcc", F.round("mcc", 9))


_GRID = "cl AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'NONE']) AS class)"


def _classes(spark) -> DataFrame:
    return spark.createDataFrame([(c,) for c in (*CLASSES, "NONE")], "class string")


@query("e03_confusion_matrix", WITH + f", {_SCORES}, {_GRID}, g AS (SELECT a.class AS true_class, b.class AS predicted_class, count(pr.specimen_label) AS n FROM cl a CROSS JOIN cl b LEFT JOIN pr ON pr.true_class = a.class AND pr.predicted_class = b.class GROUP BY a.class, b.class) SELECT *, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY true_class), 0), 0), 9) AS share FROM g")
def e03(spark, d):
    return metrics.confusion_grid(_pairs(spark, d), _classes(spark)).withColumn("share", F.round("share", 9))


@query("t03_top_confusions", WITH + f", {_SCORES} SELECT true_class, predicted_class, count(*) AS n FROM pr WHERE true_class <> predicted_class GROUP BY ALL ORDER BY n DESC, true_class, predicted_class LIMIT 5")
def t03(spark, d):
    return selection.top_confusions(metrics.confusion(_pairs(spark, d)))


@query("e07_class_report", WITH + f", {_SCORES}, {_GRID}, x AS (SELECT class, (SELECT count(*) FROM pr WHERE true_class = class) AS support, (SELECT count(*) FROM pr WHERE predicted_class = class) AS np, (SELECT count(*) FROM pr WHERE true_class = class AND predicted_class = class) AS tp FROM cl), y AS (SELECT class, support, coalesce(tp / nullif(np, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM x) SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1, support FROM y")
def e07(spark, d):
    x = metrics.class_report(_pairs(spark, d), _classes(spark))
    return x.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


_OVR = "pos AS (SELECT class, score FROM sc WHERE class = true_class), neg AS (SELECT class, score FROM sc WHERE class <> true_class), ovr AS (SELECT p.class, sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END) / count(*) AS auroc FROM pos p JOIN neg q USING (class) GROUP BY 1)"


@query("e04_auroc_by_class", WITH + f", {_SCORES}, {_OVR} SELECT class, round(auroc, 9) AS auroc FROM ovr")
def e04_class(spark, d):
    return metrics.auroc(metrics.one_vs_rest(_scores(spark, d)[0]), ["class"]).withColumn("auroc", F.round("auroc", 9))


@query("e04_auroc_multiclass", WITH + f", {_SCORES}, {_OVR}, sup AS (SELECT class, count(*) AS n FROM pos GROUP BY 1), no AS (SELECT class, true_class AS other, score FROM sc WHERE class <> true_class), ovo AS (SELECT p.class, q.other, sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END) / count(*) AS auroc FROM pos p JOIN no q USING (class) GROUP BY ALL), duo AS (SELECT least(class, other) AS a, greatest(class, other) AS b, avg(auroc) AS v FROM ovo GROUP BY ALL), dw AS (SELECT v, x.n + y.n AS w FROM duo JOIN sup x ON x.class = a JOIN sup y ON y.class = b) SELECT round((SELECT avg(auroc) FROM ovr), 9) AS ovr_macro, round((SELECT sum(auroc * n) / sum(n) FROM ovr JOIN sup USING (class)), 9) AS ovr_weighted, round((SELECT avg(v) FROM dw), 9) AS ovo_macro, round((SELECT sum(v * w) / sum(w) FROM dw), 9) AS ovo_weighted")
def e04(spark, d):
    x = metrics.multiclass(_scores(spark, d)[0])
    return x.withColumns({c: F.round(c, 9) for c in x.columns})


_AP = "pts AS (SELECT class, score, count(*) FILTER (WHERE class = true_class) AS p, count(*) AS m FROM sc GROUP BY ALL), cum AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS seen, sum(p) OVER (PARTITION BY class) AS np, sum(m) OVER (PARTITION BY class) AS nm FROM pts WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query("e05_auprc_by_class", WITH + f", {_SCORES}, {_AP} SELECT class, round(sum(p / np * tp / seen), 9) AS auprc FROM cum GROUP BY 1")
def e05(spark, d):
    return metrics.auprc(metrics.one_vs_rest(_scores(spark, d)[0]), ["class"]).withColumn("auprc", F.round("auprc", 9))


@query("e06_log_loss", WITH + f", {_SCORES} SELECT round(avg(-ln(greatest(least(score, 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 6) AS log_loss FROM sc WHERE class = true_class")
def e06(spark, d):
    return metrics.log_loss(_scores(spark, d)[0], False).withColumn("log_loss", F.round("log_loss", 6))


@query("e06_log_loss_renormalized", WITH + f", {_SCORES}, r AS (SELECT *, score / sum(score) OVER (PARTITION BY specimen_label) AS p FROM sc) SELECT round(avg(-ln(p)), 6) AS log_loss FROM r WHERE class = true_class")
def e06b(spark, d):
    return metrics.log_loss(_scores(spark, d)[0], True).withColumn("log_loss", F.round("log_loss", 6))


_CURVE = f"{_AP}, cv AS (SELECT class, score AS threshold, tp / np AS tpr, (seen - tp) / (nm - np) AS fpr, tp / seen AS precision FROM cum WHERE np > 0 AND nm > np)"


@query("e08_curves", WITH + f", {_SCORES}, {_CURVE} SELECT class, round(threshold, 9) AS threshold, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr, round(precision, 9) AS precision FROM cv")
def e08(spark, d):
    x = metrics.curves(metrics.one_vs_rest(_scores(spark, d)[0]), ["class"])
    return x.withColumns({c: F.round(c, 9) for c in ("threshold", "tpr", "fpr", "precision")})


@query("e09_youden", WITH + f", {_SCORES}, {_CURVE} SELECT class, round(threshold, 9) AS threshold, round(tpr, 9) AS sensitivity, round(1 - fpr, 9) AS specificity FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY round(tpr - fpr, 12) DESC, threshold DESC) AS r FROM cv) WHERE r = 1")
def e09(spark, d):
    x = metrics.youden(metrics.one_vs_rest(_scores(spark, d)[0]), ["class"])
    return x.withColumns({c: F.round(c, 9) for c in ("threshold", "sensitivity", "specificity")})


@query("e09_at_half", WITH + f", {_SCORES} SELECT class, round(count(*) FILTER (WHERE class = true_class AND score >= 0.5) / count(*) FILTER (WHERE class = true_class), 9) AS sensitivity, round(count(*) FILTER (WHERE class <> true_class AND score < 0.5) / count(*) FILTER (WHERE class <> true_class), 9) AS specificity FROM sc GROUP BY 1")
def e09_half(spark, d):
    x = metrics.at_threshold(metrics.one_vs_rest(_scores(spark, d)[0]), ["class"])
    return x.withColumns({c: F.round(c, 9) for c in ("sensitivity", "specificity")})


@query("e04_missing_class", WITH + f", {_SCORES}, part AS (SELECT * FROM sc WHERE class <> 'MACHINERY'), full_sc AS (SELECT class, true_class, score FROM part UNION ALL SELECT 'MACHINERY', true_class, 0.0 FROM (SELECT DISTINCT specimen_label, true_class, CV_fold FROM part)), r AS (SELECT class, true_class = class AS y, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2 AS rk FROM full_sc), s AS (SELECT class, sum(rk) FILTER (WHERE y) AS r, CAST(count(*) FILTER (WHERE y) AS DOUBLE) AS p, count(*) FILTER (WHERE NOT y) AS n FROM r GROUP BY 1) SELECT class, round((r - p * (p + 1) / 2) / (p * n), 9) AS auroc FROM s")
def e04_missing(spark, d):
    """A class without scores is like one that always scores 0."""
    x = metrics.with_all_classes(_scores(spark, d)[0].where("class <> 'MACHINERY'"))
    return metrics.auroc(metrics.one_vs_rest(x), ["class"]).withColumn("auroc", F.round("auroc", 9))


@query("e05_auprc_multiclass", WITH + f", {_SCORES}, pr1 AS (SELECT class, '' AS other, score, CAST(class = true_class AS INT) AS y FROM sc), pr2 AS (SELECT s.class, o.class AS other, s.score, 1 AS y FROM sc s JOIN (SELECT DISTINCT class FROM sc) o ON o.class <> s.class WHERE s.class = s.true_class UNION ALL SELECT class, true_class, score, 0 FROM sc WHERE class <> true_class), pts AS (SELECT class, other, score, sum(y) AS p, count(*) AS m FROM (FROM pr1 UNION ALL FROM pr2) GROUP BY ALL), cum AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS seen, sum(p) OVER (PARTITION BY class, other) AS np FROM pts WINDOW w AS (PARTITION BY class, other ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), ap AS (SELECT class, other, sum(p / np * tp / seen) AS v FROM cum GROUP BY ALL), sup AS (SELECT class, count(*) AS n FROM sc WHERE class = true_class GROUP BY 1), duo AS (SELECT least(class, other) AS a, greatest(class, other) AS b, avg(v) AS v FROM ap WHERE other <> '' GROUP BY ALL), dw AS (SELECT v, x.n + y.n AS w FROM duo JOIN sup x ON x.class = a JOIN sup y ON y.class = b) SELECT round((SELECT avg(v) FROM ap WHERE other = ''), 9) AS ovr_macro, round((SELECT sum(v * n) / sum(n) FROM ap JOIN sup USING (class) WHERE other = ''), 9) AS ovr_weighted, round((SELECT avg(v) FROM dw), 9) AS ovo_macro, round((SELECT sum(v * w) / sum(w) FROM dw), 9) AS ovo_weighted")
def e05_multi(spark, d):
    x = metrics.multiclass(_scores(spark, d)[0], metrics.auprc, "auprc")
    return x.withColumns({c: F.round(c, 9) for c in x.columns})


@query("e10_abstention_by_class", WITH + f", {_SCORES} SELECT true_class, count(*) AS n_abstained FROM ab GROUP BY 1")
def e10(spark, d):
    return _scores(spark, d)[1].groupBy("true_class").agg(F.count("*").alias("n_abstained"))


@query("e11_full_label_space", WITH + f", {_SCORES}, {_GRID}, s AS (SELECT DISTINCT specimen_label FROM sc) SELECT s.specimen_label, cl.class, round(coalesce(sc.score, 0), 9) AS score FROM s CROSS JOIN cl LEFT JOIN sc ON sc.specimen_label = s.specimen_label AND sc.class = cl.class")
def e11(spark, d):
    x = _scores(spark, d)[0]
    grid = x.select("specimen_label").distinct().crossJoin(_classes(spark))
    return grid.join(x.select("specimen_label", "class", "score"), ["specimen_label", "class"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))


_FOLD_ACCURACY = "fa AS (SELECT CV_fold, count(*) FILTER (WHERE true_class = predicted_class) / count(*) AS value FROM pr GROUP BY 1)"


def _fold_accuracy(spark, d) -> DataFrame:
    folds = metadata(spark, d).select("specimen_label", "CV_fold")
    return _pairs(spark, d).join(folds, "specimen_label").groupBy("CV_fold").agg((F.count_if(F.col("true_class") == F.col("predicted_class")) / F.count("*")).alias("value"))


@query("a23_fold_summary", WITH + f", {_SCORES}, {_FOLD_ACCURACY} SELECT 'accuracy' AS metric, round(avg(value), 9) AS mean, round(coalesce(stddev_samp(value), 0), 9) AS std, count(value) AS n_folds FROM fa")
def a23(spark, d):
    x = metrics.fold_summary(_fold_accuracy(spark, d).withColumn("metric", F.lit("accuracy")), ["metric"])
    return x.withColumns({c: F.round(c, 9) for c in ("mean", "std")})


@query("a24_pooled_folds", WITH + f", {_SCORES} SELECT true_class, predicted_class, count(*) AS n, count(DISTINCT CV_fold) AS n_folds FROM pr GROUP BY ALL")
def a24(spark, d):
    folds = metadata(spark, d).select("specimen_label", "CV_fold")
    return _pairs(spark, d).join(folds, "specimen_label").groupBy("true_class", "predicted_class").agg(F.count("*").alias("n"), F.countDistinct("CV_fold").alias("n_folds"))


@query("a24_pooled_areas", WITH + f", {_SCORES}, {_OVR}, {_AP}, ap AS (SELECT class, sum(p / np * tp / seen) AS v FROM cum GROUP BY 1) SELECT (SELECT count(DISTINCT CV_fold) FROM sc) AS n_folds, (SELECT count(*) FROM ab) AS n_abstained, round((SELECT avg(auroc) FROM ovr), 9) AS auroc, round((SELECT avg(v) FROM ap), 9) AS auprc")
def a24_areas(spark, d):
    """Areas over the scores of all folds together, with the specimens that no fold's model scored."""
    x, abstained = _scores(spark, d)
    one = metrics.one_vs_rest(x)
    areas = metrics.auroc(one, ["class"]).agg(F.round(F.avg("auroc"), 9).alias("auroc")).crossJoin(metrics.auprc(one, ["class"]).agg(F.round(F.avg("auprc"), 9).alias("auprc")))
    return x.agg(F.countDistinct("CV_fold").alias("n_folds")).crossJoin(abstained.agg(F.count(F.lit(1)).alias("n_abstained"))).crossJoin(areas)


@query("w03_running_weights", WITH + f", {_SCORES} SELECT specimen_label, class, round(sum(score) OVER (PARTITION BY specimen_label ORDER BY score, class_index ROWS UNBOUNDED PRECEDING) / sum(score) OVER (PARTITION BY specimen_label), 9) AS running FROM sc")
def w03(spark, d):
    whole = Window.partitionBy("specimen_label")
    running = F.sum("score").over(whole.orderBy("score", "class_index").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("score").over(whole)
    return _scores(spark, d)[0].select("specimen_label", "class", F.round(running, 9).alias("running"))


_CANDIDATES = "cand AS (SELECT CV_fold AS priority, class_index * 0.1 AS threshold, round(avg(score), 6) AS mean_mcc FROM sc GROUP BY CV_fold, class_index)"


def _candidates(spark, d) -> DataFrame:
    return _scores(spark, d)[0].groupBy(F.col("CV_fold").alias("priority"), "class_index").agg(F.round(F.avg("score"), 6).alias("mean_mcc")).withColumn("threshold", F.col("class_index") * F.lit(0.1)).drop("class_index")


@query("t06_candidate_ranking", WITH + f", {_SCORES}, {_CANDIDATES} SELECT priority, round(CAST(threshold AS DOUBLE), 6) AS threshold, mean_mcc, CAST(row_number() OVER (ORDER BY mean_mcc DESC, priority, threshold DESC) AS INT) AS position FROM cand")
def t06(spark, d):
    return selection.candidate_ranking(_candidates(spark, d)).withColumn("threshold", F.round("threshold", 6)).select("priority", "threshold", "mean_mcc", "position")


@query("t05_best_candidate", WITH + f", {_SCORES}, {_CANDIDATES} SELECT priority, round(CAST(threshold AS DOUBLE), 6) AS threshold, mean_mcc FROM cand ORDER BY mean_mcc DESC, priority, threshold DESC LIMIT 1")
def t05(spark, d):
    best = F.max_by(F.struct("priority", F.round("threshold", 6).alias("threshold"), "mean_mcc"), F.struct("mean_mcc", -F.col("priority"), "threshold"))
    return _candidates(spark, d).agg(best.alias("b")).select("b.*")


# ---- ensemble ---------------------------------------------------------------------------------

_MODELS = """ms AS (SELECT a.specimen_label, m.model, a.class, CASE WHEN m.model = 2 AND a.k % 7 = 0 THEN NULL ELSE CAST(((a.k * 13 + m.model * 29 + a.class_index * 7) % 89 + 1) / 90.0 AS DOUBLE) END AS score FROM allsc a, (SELECT unnest([1, 2, 3]) AS model) m)"""


def _models(spark, d) -> DataFrame:
    x = _all_scores(spark, d).select("specimen_label", "class", "class_index", "k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("model"))
    score = ((F.col("k") * 13 + F.col("model") * 29 + F.col("class_index") * 7) % 89 + 1) / F.lit(90.0)
    return x.select("specimen_label", "model", "class", F.when((F.col("model") == 2) & (F.col("k") % 7 == 0), None).otherwise(score).alias("score"))


def _strategy(name: str, strategy: str, value: str):
    @query(name, WITH + f", {_SCORES}, {_MODELS}, f AS (SELECT specimen_label, model, class, {value} AS score FROM ms) SELECT f.specimen_label, model, class, round(score, 9) AS score FROM f ANTI JOIN (SELECT DISTINCT specimen_label FROM f WHERE score IS NULL) g USING (specimen_label)")
    def run(spark, d):
        return predictions.meta_features(_models(spark, d), strategy).withColumn("score", F.round("score", 9))


_strategy("m10_features_abstain", "ensemble_abstain", "score")
_strategy("m10_features_half", "fill_0.5", "CASE WHEN model = 2 THEN coalesce(score, 0.5) ELSE score END")
_strategy("m10_features_mean", "fill_models13_mean", "CASE WHEN model = 2 THEN coalesce(score, avg(CASE WHEN model <> 2 THEN score END) OVER (PARTITION BY specimen_label, class)) ELSE score END")

_NAMES = [f"TCR:model{m}:{c}" for m in (1, 2, 3) for c in CLASSES]


@query("m11_raw_matrix", WITH + f", {_SCORES}, {_MODELS} SELECT specimen_label, " + ", ".join(f"round(max(score) FILTER (WHERE model = {n[9]} AND class = '{n[11:]}'), 9) AS \"{n}\"" for n in _NAMES) + " FROM ms GROUP BY 1")
def m11(spark, d):
    x = predictions.feature_matrix(_models(spark, d), _NAMES)
    return x.select("specimen_label", *(F.round(F.col(f"`{n}`"), 9).alias(n) for n in _NAMES))


@query("j14_scored_by_all", WITH + f", {_SCORES}, {_MODELS} SELECT specimen_label FROM ms GROUP BY 1 HAVING count(DISTINCT model) FILTER (WHERE score IS NOT NULL) = 3")
def j14(spark, d):
    return predictions.scored_by_all(_models(spark, d), 3)


@query("j13_assembled", WITH + f", {_SCORES}, {_MODELS}, b AS (SELECT specimen_label, model, arg_max(class, score) AS c FROM ms WHERE score IS NOT NULL GROUP BY ALL) SELECT specimen_label, coalesce(max(c) FILTER (WHERE model = 1), 'ABSTAINED') AS model1, coalesce(max(c) FILTER (WHERE model = 2), 'ABSTAINED') AS model2, coalesce(max(c) FILTER (WHERE model = 3), 'ABSTAINED') AS model3 FROM meta LEFT JOIN b USING (specimen_label) GROUP BY 1")
def j13(spark, d):
    best = _models(spark, d).where("score IS NOT NULL").groupBy("specimen_label", F.concat(F.lit("model"), F.col("model")).alias("model")).agg(F.max_by("class", "score").alias("predicted_class"))
    return predictions.assembled(metadata(spark, d).select("specimen_label"), best, ["model1", "model2", "model3"])


@query("p32_binary_names", WITH + "SELECT DISTINCT disease || '_vs_BUILDING' AS name FROM meta WHERE disease <> 'BUILDING'")
def p32(spark, d):
    return metadata(spark, d).where("disease <> 'BUILDING'").select(X.pair_name(F.col("disease"), F.lit("BUILDING")).alias("name")).distinct()
