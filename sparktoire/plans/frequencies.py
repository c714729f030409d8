"""V-J frequencies, rare genes, and weighted aggregation of sequence probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparktoire.functions import expressions as X
from sparktoire.models.sequence_level import score_groups
from sparktoire.operators import features, metrics
from sparktoire.operators.storage import written
from sparktoire.plans.base import WITH, downsampled, metadata, query, table

_VJ = "vj AS (SELECT specimen_label, isotype_supergroup, v_gene || '|' || j_gene || ':TCRB' AS feature, count(*) AS n FROM down GROUP BY ALL), freq AS (SELECT *, n / sum(n) OVER (PARTITION BY specimen_label, isotype_supergroup) AS frequency FROM vj)"


@query("a05_vj_frequencies", WITH + f", {_VJ} SELECT specimen_label, isotype_supergroup, feature, n, round(frequency, 9) AS frequency FROM freq")
def a05(spark, d):
    return features.vj_frequencies(downsampled(spark, d)).withColumn("frequency", F.round("frequency", 9))


_TRAIN = "train AS (SELECT DISTINCT feature FROM freq JOIN (SELECT DISTINCT specimen_label, CV_fold FROM meta) USING (specimen_label) WHERE CV_fold <> 0), tested AS (SELECT DISTINCT specimen_label FROM freq JOIN meta USING (specimen_label) WHERE CV_fold = 0), cell AS (SELECT specimen_label, feature, frequency AS f FROM freq JOIN tested USING (specimen_label) JOIN train USING (feature)), mat AS (SELECT specimen_label, feature, f / sum(f) OVER (PARTITION BY specimen_label) AS frequency FROM cell)"


def _matrix(spark, d, trained: str = "CV_fold <> 0") -> tuple[DataFrame, DataFrame]:
    """The cells of the test specimens, and the specimens."""
    x = written(downsampled(spark, d).select("specimen_label", "disease", "CV_fold", "v_gene", "j_gene", "isotype_supergroup"))
    train, test = features.vj_frequencies(x.where(trained)), features.vj_frequencies(x.where("CV_fold = 0"))
    return features.aligned(test, train), test.select("specimen_label").distinct()


@query("a06_aligned_matrix", WITH + f", {_VJ}, {_TRAIN} SELECT specimen_label, feature, round(frequency, 9) AS frequency FROM mat")
def a06(spark, d):
    return _matrix(spark, d)[0].withColumn("frequency", F.round("frequency", 9))


@query("a28_zero_rows", WITH + f", {_VJ}, " + _TRAIN.replace("JOIN (SELECT DISTINCT specimen_label, CV_fold FROM meta) USING (specimen_label) WHERE CV_fold <> 0", "JOIN meta USING (specimen_label) WHERE CV_fold = 1 AND disease = 'BUILDING'") + " SELECT specimen_label FROM tested ANTI JOIN mat USING (specimen_label)")
def a28(spark, d):
    """Specimens of the test fold without a feature of one class's specimens of another fold."""
    return features.zero_rows(*_matrix(spark, d, "CV_fold = 1 AND disease = 'BUILDING'"))


@query("a07_common_genes", WITH + ", c AS (SELECT v_gene, count(*) AS n FROM down GROUP BY 1) SELECT v_gene, n FROM c WHERE n >= (SELECT median(n) FROM c)")
def a07(spark, d):
    return features.common_v_genes(downsampled(spark, d))


_BY_CLASS = "sh AS (SELECT v_gene, disease, count(*) / sum(count(*)) OVER (PARTITION BY disease) AS share FROM down GROUP BY v_gene, disease), mx AS (SELECT v_gene, max(share) AS max_share FROM sh GROUP BY 1), kept AS (SELECT * FROM mx WHERE max_share >= (SELECT median(max_share) FROM mx))"


@query("a08_common_genes_by_class", WITH + f", {_BY_CLASS} SELECT v_gene, round(max_share, 9) AS max_share FROM kept")
def a08(spark, d):
    return features.common_v_genes_by_class(downsampled(spark, d)).withColumn("max_share", F.round("max_share", 9))


@query("a15_group_frequencies", WITH + f", {_BY_CLASS} SELECT specimen_label, v_gene, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY specimen_label), 9) AS frequency FROM down WHERE v_gene IN (SELECT v_gene FROM kept) GROUP BY specimen_label, v_gene")
def a15(spark, d):
    x = downsampled(spark, d)
    return features.group_frequencies(x, features.common_v_genes_by_class(x)).withColumn("frequency", F.round("frequency", 9))


@query("a15_isotype_shares", WITH + ", i AS (SELECT specimen_label, disease, CASE WHEN num_reads % 3 = 0 THEN 'IGHM' ELSE 'IGHG' END AS isotype_supergroup, count(*) AS n FROM down GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY specimen_label) AS share FROM i) SELECT specimen_label, disease, isotype_supergroup, n, round(share, 9) AS share, round(avg(share) OVER (PARTITION BY disease, isotype_supergroup), 9) AS class_share FROM s")
def a15_isotypes(spark, d):
    x = downsampled(spark, d).withColumn("isotype_supergroup", F.when(F.col("num_reads") % 3 == 0, "IGHM").otherwise("IGHG"))
    return features.isotype_shares(x).withColumns({c: F.round(c, 9) for c in ("share", "class_share")})


@query("a29_unscored_specimens", WITH + f", {_BY_CLASS} SELECT DISTINCT specimen_label FROM down WHERE specimen_label NOT IN (SELECT specimen_label FROM down WHERE v_gene IN (SELECT v_gene FROM kept))")
def a29(spark, d):
    x = downsampled(spark, d)
    scored = x.join(features.common_v_genes_by_class(x), "v_gene", "left_semi").select("specimen_label")
    return x.select("specimen_label").distinct().join(scored, "specimen_label", "left_anti")


@query("a25_class_weights", WITH + ", c AS (SELECT disease, count(*) AS n FROM meta GROUP BY 1) SELECT disease, n, round((1 / n) / sum(1 / n) OVER (), 9) AS weight FROM c")
def a25(spark, d):
    return metrics.class_weights(metadata(spark, d)).withColumn("weight", F.round("weight", 9))


# ---- probabilities of sequences: made of the first parts of the embeddings ---------------------

_P = """prob AS (SELECT vec_id, 'S' || CAST(vec_id % 20 AS VARCHAR) AS specimen_label, 'V' || CAST(label % 3 AS VARCHAR) AS v_gene, CAST(1 + vec_id % 7 AS DOUBLE) AS weight,
  [abs(CAST(embedding[1] AS DOUBLE)), abs(CAST(embedding[2] AS DOUBLE)), abs(CAST(embedding[3] AS DOUBLE))] AS p FROM embeddings),
ent AS (SELECT *, -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x / list_sum(p) * ln(x / list_sum(p)) ELSE 0 END)) AS h FROM prob),
each AS (SELECT *, unnest(p) AS x, unnest([0, 1, 2]) AS class_index FROM ent)"""


def _probabilities(spark, d) -> DataFrame:
    first = F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("S"), F.col("vec_id") % 20).alias("specimen_label"), F.concat(F.lit("V"), F.col("label") % 3).alias("v_gene"), (1 + F.col("vec_id") % 7).cast("double").alias("weight"), first.alias("p"))


@query("p29_entropy", f"WITH {_P} SELECT vec_id, round(h, 6) AS entropy FROM ent")
def p29(spark, d):
    return _probabilities(spark, d).select("vec_id", F.round(X.entropy(F.col("p")), 6).alias("entropy"))


@query("p30_link_functions", f"WITH {_P}, s AS (SELECT vec_id, p, list_sum(list_transform(p, lambda x: exp(x))) AS t FROM prob) SELECT vec_id, round(ln(1 + p[1]), 6) AS log1p, round(1 / (1 + exp(-p[1])), 6) AS sigmoid, round(exp(p[1]) / t, 6) AS softmax_first FROM s")
def p30(spark, d):
    first = F.element_at("p", 1)
    return _probabilities(spark, d).select("vec_id", F.round(F.log1p(first), 6).alias("log1p"), F.round(X.sigmoid(first), 6).alias("sigmoid"), F.round(F.element_at(X.softmax(F.col("p")), 1), 6).alias("softmax_first"))


@query("p31_argmax", f"WITH {_P} SELECT vec_id, arg_max(class_index, x) AS class_index FROM each GROUP BY 1")
def p31(spark, d):
    x = _probabilities(spark, d).select("vec_id", F.posexplode("p").alias("class_index", "score"))
    return x.groupBy("vec_id").agg(F.max_by("class_index", F.struct("score", -F.col("class_index"))).alias("class_index"))


_MEAN = "coalesce(CASE WHEN sum(weight) FILTER (WHERE ok) <> 0 THEN sum(weight * x) FILTER (WHERE ok) / sum(weight) FILTER (WHERE ok) ELSE avg(x) FILTER (WHERE ok) END, 1.0 / 3)"


def _strategy(name: str, condition: str, **options):
    sql = f"WITH {_P}, k AS (SELECT *, coalesce({condition}, false) AS ok FROM each) SELECT specimen_label, v_gene, class_index, round({_MEAN}, 6) AS probability, count(*) FILTER (WHERE ok) AS n_survived FROM k GROUP BY ALL"

    @query(name, sql)
    def run(spark, d):
        x = features.aggregated(_probabilities(spark, d), ["specimen_label", "v_gene"], 3, **options)
        return x.withColumn("probability", F.round("probability", 6))


_strategy("a13_mean", "true", strategy="mean")
_strategy("a13_entropy_cutoff", "h < CAST(0.8 AS DOUBLE) * ln(3.0)", strategy="entropy_cutoff", fraction=0.8)
_strategy("a13_entropy_cutoff_90", "h < CAST(0.9 AS DOUBLE) * ln(3.0)", strategy="entropy_cutoff", fraction=0.9)
_strategy("a13_entropy_bound", "h < 0.6", strategy="entropy_percentile_cutoff", threshold=0.6)


@query("a13_weighted_median", f"WITH {_P}, r AS (SELECT *, sum(weight) OVER (PARTITION BY specimen_label, v_gene, class_index ORDER BY x RANGE UNBOUNDED PRECEDING) AS run, sum(weight) OVER (PARTITION BY specimen_label, v_gene, class_index) AS total FROM each) SELECT specimen_label, v_gene, class_index, round(min(x) FILTER (WHERE run >= 0.5 * total), 6) AS probability, count(*) AS n_survived FROM r GROUP BY ALL")
def a13_median(spark, d):
    x = features.aggregated(_probabilities(spark, d), ["specimen_label", "v_gene"], 3, "median")
    return x.withColumn("probability", F.round("probability", 6))


@query("a14_featurized", f"WITH {_P}, k AS (SELECT *, h < CAST(0.8 AS DOUBLE) * ln(3.0) AS ok FROM each), a AS (SELECT specimen_label, v_gene, class_index, {_MEAN} AS probability, count(*) FILTER (WHERE ok) AS n_survived FROM k GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT specimen_label FROM prob), (SELECT DISTINCT v_gene FROM prob), (SELECT unnest([0, 1, 2]) AS class_index)) SELECT specimen_label, v_gene, class_index, round(coalesce(probability, 1.0 / 3), 6) AS probability, coalesce(n_survived, 0) AS n_survived FROM g LEFT JOIN a USING (specimen_label, v_gene, class_index)")
def a14(spark, d):
    p = _probabilities(spark, d)
    x = features.featurized(features.aggregated(p, ["specimen_label", "v_gene"], 3), p, p, 3)
    return x.withColumn("probability", F.round("probability", 6))


@query("a16_entropy_percentile", f"WITH {_P} SELECT round(quantile_cont(h, 0.05), 6) AS threshold FROM ent")
def a16(spark, d):
    return _probabilities(spark, d).agg(F.round(F.percentile(X.entropy(F.col("p")), F.lit(0.05)), 6).alias("threshold"))


@query("m05_stage_one_scores", f"WITH {_P}, w AS (SELECT 'V0' AS v_gene, [0.5, -0.25, 1.0] AS w UNION ALL SELECT 'V1', [-1.0, 0.5, 0.25]) SELECT vec_id, round(1 / (1 + exp(-(p[1] * w[1] + p[2] * w[2] + p[3] * w[3]))), 6) AS score FROM prob LEFT JOIN w USING (v_gene)")
def m05(spark, d):
    weights = spark.createDataFrame([("V0", [0.5, -0.25, 1.0], 0.0), ("V1", [-1.0, 0.5, 0.25], 0.0)], "v_gene string, coefficients array<double>, intercept double")
    return score_groups(_probabilities(spark, d), weights, "p").select("vec_id", F.round("score", 6).alias("score"))
