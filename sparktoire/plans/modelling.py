"""Estimators and caches end to end. Their rows have no SQL; tests check them in other ways."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from sparktoire.models import base, classifiers, embedding, external, store, training
from sparktoire.models.sequence_level import fit_groups
from sparktoire.operators import cleaning
from sparktoire.operators.storage import names, shared_folder, write_text, written
from sparktoire.plans.base import WITH, downsampled, metadata, query, repertoire, sequences, table
from sparktoire.plans.evaluation import _pairs
from sparktoire.plans.frequencies import a05
from sparktoire.sources import repertoires
from sparktoire.streaming import ingest


def _halves(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the other folds and those of fold 0; what makes them runs once."""
    x = written(x)
    return x.where("CV_fold <> 0"), x.where("CV_fold = 0")


def _embedded(spark, d) -> DataFrame:
    x = sequences(spark, d).withColumns({"row_id": F.col("ord"), "weight": F.col("weight").cast("double")})
    return classifiers.embedded(x)


@query("m01_repertoire_model")
def m01(spark, d):
    train, test = _halves(downsampled(spark, d))
    return classifiers.RepertoireModel().fit(train).predict(test)


@query("m02_cluster_model")
def m02(spark, d):
    train, test = _halves(sequences(spark, d))
    return classifiers.ClusterModel().fit(train).predict(test)


@query("m04_group_regressions")
def m04(spark, d):
    return fit_groups(_embedded(spark, d))


@query("m04_isotype_forests")
def m04_forests(spark, d):
    """B-cell models: a forest for each V gene and isotype, and the scores of held-out rows. The isotype is made of the row's label."""
    isotype = F.element_at(F.array(*map(F.lit, ("IGHG", "IGHA", "IGHD-M"))), F.pmod(F.crc32("ord"), F.lit(3)).cast("int") + 1)
    train, test = _halves(_embedded(spark, d).withColumn("isotype_supergroup", isotype))
    model = classifiers.SequenceModel(locus="BCR")
    model._fit_models(train)
    scored = model.sequence_scores(model._kept(test))
    return scored.select("row_id", "specimen_label", F.col("v_gene").alias("group"), F.posexplode(F.transform("p", lambda x: F.round(x, 9))).alias("class_index", "score"))


@query("m06_sequence_model")
def m06(spark, d):
    train, test = _halves(_embedded(spark, d))
    return classifiers.SequenceModel().fit(train).predict(test)


@query("m08_embeddings")
def m08(spark, d):
    return _embedded(spark, d).select("row_id", "cdr3", "embedding")


def _whole(spark, d) -> DataFrame:
    """Rows with what all models need."""
    return _embedded(spark, d).withColumn("isotype_supergroup", F.lit("TCRB"))


@query("s13_embedding_job", WITH + "SELECT participant_label, count(*) AS n_rows, 'ok' AS status FROM seqs GROUP BY 1")
def s13_job(spark, d):
    """All participants' sequences embedded by a job that was stopped and went on, and what the check says of each."""
    x = written(sequences(spark, d).select("participant_label", F.col("ord").alias("row_id"), "cdr3"))
    folder = f"{shared_folder(spark)}/embeddings/{uuid.uuid4().hex}"
    made = [embedding.embed(x, folder, classifiers.embedded, runs=3, stop_after=n) for n in (1, None, None)]
    if made != [1, 2, 0]:
        raise AssertionError(f"the runs of the job: {made}")
    rows = embedding.stored(spark, folder).groupBy("participant_label").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(embedding.verified(x, folder), "participant_label")


#: Trained ensembles of this process, by application and tables: several queries read them.
_TRAINED: dict[tuple[str, str], str] = {}


def _trained(spark, d) -> tuple[str, DataFrame]:
    """The folder of a saved ensemble and its base models, cross-fitted on two folds' rows, and the rows held out."""
    train, test = _halves(_whole(spark, d))
    key = (spark.sparkContext.applicationId, d)
    if key not in _TRAINED or not store.exists(spark, f"{_TRAINED[key]}/ensemble/model.json"):
        folder = f"{shared_folder(spark)}/models/{uuid.uuid4().hex}"
        training.cross_fitted(train, training.builders(), 2).save(spark, folder, {"locus": "TCR", "test_fold": 0})
        _TRAINED[key] = folder
    return _TRAINED[key], test


@query("m12_ensemble")
def m12(spark, d):
    """From rows to the scores of the ensemble, which learned from base models' scores of participants that they had not seen."""
    folder, test = _trained(spark, d)
    return training.Trained.load(spark, folder).predict(test).where("model = 'ensemble'")


@query("m12_cross_fitted_scores")
def m12_scores(spark, d):
    """What the ensemble learned from, with how many participants of each run had been seen by its models: none."""
    out = training.Trained.load(spark, _trained(spark, d)[0])
    leaks = training.seen(out.scores, out.trained).groupBy("run").agg(F.count(F.lit(1)).alias("n_seen"))
    return out.scores.join(leaks, "run", "left").withColumn("n_seen", F.coalesce("n_seen", F.lit(0)))


@query("m12_one_split")
def m12_split(spark, d):
    """The same with one split into roles; the test fold is scored."""
    return training.held_out_validation(written(_whole(spark, d)), training.builders(), 0, "fill_models13_mean")[1]


@query("m01_pairs")
def m01_pairs(spark, d):
    """Every disease against one, all at once: held-out scores and the measures of each pair."""
    train, test = _halves(downsampled(spark, d))
    pairs = training.pairs_of(base.classes_of(train), "multi-binary", "BUILDING")
    scores = written(training.fit_repertoire_pairs(train, pairs).predict(test))
    return scores.join(training.pair_metrics(scores, test, pairs), "pair")


@query("t04_importances")
def t04(spark, d):
    train, _ = _halves(_embedded(spark, d))
    return classifiers.SequenceModel(n_penalties=10).fit(train).importances(10)


@query("m09_penalty_path")
def m09(spark, d):
    """The mean held-out deviance along the repertoire model's penalties."""
    choice = classifiers.RepertoireModel().fit(downsampled(spark, d)).choice
    rows = [(i, float(p), float(m), bool(p == choice.best), bool(p == choice.within)) for i, (p, m) in enumerate(zip(choice.path, choice.mean, strict=True))]
    return spark.createDataFrame(rows, "position int, penalty double, mean_score double, best boolean, within_error boolean")


@query("m13_base_predictions")
def m13(spark, d):
    """Scores of all base models, saved and loaded."""
    folder, test = _trained(spark, d)
    return external.base_scores(external.load_models(spark, folder), test)


@query("m14_external_evaluation")
def m14(spark, d):
    """The saved base models and ensemble on the rows of another fold: load, check settings, align classes, measure."""
    folder, test = _trained(spark, d)
    return external.evaluate(spark, folder, metadata(spark, d), test, test_on_folds=[0], expected={"locus": "TCR"}).report


@query("s19_summary", WITH + "SELECT disease, count(DISTINCT participant_label) AS n_participants, count(DISTINCT specimen_label) AS n_specimens, 0 AS test_fold FROM down WHERE CV_fold <> 0 GROUP BY 1")
def s19(spark, d):
    """What a saved training's summary says of the classes that it learned from."""
    x = store.read_summary(spark, _trained(spark, d)[0], {"locus": "TCR", "test_fold": 0})
    rows = [(c, *n, x["config"]["test_fold"]) for c, n in x["results"]["trained_on"].items()]
    return spark.createDataFrame(rows, "disease string, n_participants long, n_specimens long, test_fold int")


@query("s07_specimen_iteration", WITH + "SELECT specimen_label, count(*) AS n_rows, min(ord) AS first_ord, max(ord) AS last_ord FROM down GROUP BY 1")
def s07(spark, d):
    """What a loop over specimens sees of each."""
    return downsampled(spark, d).groupBy("specimen_label").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


@query("s08_stage_cache", WITH + "SELECT participant_label, ord FROM clean")
def s08(spark, d):
    """A stage's cache: built, found, built again after a file of it was spoilt."""
    path, build = f"{shared_folder(spark)}/caches/{uuid.uuid4().hex}", lambda: cleaning.long_enough(cleaning.clean(repertoire(spark, d))).select("ord", "v_gene", "participant_label")
    made = [repertoires.cached(spark, path, {"stage": "clean"}, build)[1] for _ in range(2)]
    version = repertoires.cache_version(spark, path)
    write_text(spark, f"{version}/{next(n for n in names(spark, version) if n.endswith('.parquet'))}", "not Parquet")
    x, again = repertoires.cached(spark, path, {"stage": "clean"}, build)
    if (*made, again) != (True, False, True):
        raise AssertionError(f"the cache was built: {(*made, again)}")
    return x.select("participant_label", "ord")


@query("s09_participant_cache", WITH + "SELECT participant_label, count(*) AS n_rows FROM down GROUP BY 1")
def s09(spark, d):
    """The participants' cache, built again for other settings."""
    path, x = f"{shared_folder(spark)}/caches/{uuid.uuid4().hex}", downsampled(spark, d).select("ord", "participant_label")
    for least, expected in ((8, True), (8, False), (9, True)):
        found, made = repertoires.cached(spark, path, {"least_length": least}, lambda: x)
        if made != expected:
            raise AssertionError("a cache is built exactly if its settings are new")
    return repertoires.cache_report(found)


@query("s14_feature_matrix")
def s14(spark, d):
    path = f"{shared_folder(spark)}/matrices/{uuid.uuid4().hex}"
    x = a05(spark, d).select("specimen_label", "feature", "frequency")
    x.write.option("header", True).csv(path)
    return spark.read.schema(x.schema).option("header", True).csv(path)


@query("s15_prediction_files")
def s15(spark, d):
    path = f"{shared_folder(spark)}/predictions/{uuid.uuid4().hex}"
    x = _pairs(spark, d)
    repertoires.write_predictions(x, path)
    return spark.read.schema(x.schema).option("header", True).csv(path)


@query("s16_cache_report", WITH + "SELECT CAST(CV_fold AS VARCHAR) AS name, count(*) AS n_rows, true AS has_bytes FROM rep WHERE CV_fold <> 1 GROUP BY 1")
def s16(spark, d):
    """Caches of the folds, one of them cleared."""
    root = f"{shared_folder(spark)}/caches/{uuid.uuid4().hex}"
    repertoires.write_cache(repertoire(spark, d).select("ord", "participant_label", F.col("CV_fold").cast("string").alias("fold")), root, "fold")
    repertoires.clear_cache(spark, f"{root}/fold=1")
    rows = spark.read.parquet(root).groupBy(F.col("fold").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))
    sizes = repertoires.cache_sizes(spark, root).select(F.regexp_extract("name", "^fold=(.*)$", 1).alias("name"), (F.col("n_bytes") > 0).alias("has_bytes"))
    return rows.join(sizes, "name")


@query("x01_event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x01(spark, d):
    """An extension: tumbling windows over the events."""
    return ingest.windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))
