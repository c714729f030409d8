"""Every model on rows with a planted signal, held out by participant, saved and loaded."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktoire.models import classifiers, external, linear, store
from sparktoire.operators.clustering import BLOCK

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
SCHEMA = "participant_label string, specimen_label string, disease string, CV_fold int, v_gene string, j_gene string, isotype_supergroup string, cdr3 string, weight double, row_id string, ord string"


@pytest.fixture(scope="module")
def repertoires(spark):
    """60 participants of three classes; each class uses a gene more often and shares sequences of its own."""
    r = random.Random(3)
    shared = {c: ["".join(r.choices(LETTERS, k=12)) for _ in range(6)] for c in "ABC"}
    rows = []
    for p in range(60):
        c = "ABC"[p % 3]
        for i in range(60):
            v = f"V{'ABC'.index(c)}" if r.random() < 0.35 else f"V{r.randrange(5)}"
            own = i < 4
            text = list(r.choice(shared[c]) if own else "".join(r.choices(LETTERS, k=12)))
            if own and r.random() < 0.5:
                text[r.randrange(12)] = r.choice(LETTERS)
            # the class also shows in the letters that a sequence begins with
            if not own and r.random() < 0.6:
                text[:3] = {"A": "WWW", "B": "KKK", "C": "DDD"}[c]
            rows.append((f"P{p}", f"S{p}", c, (p // 3) % 3, v if not own else "V0", f"J{r.randrange(2)}" if not own else "J0", "TCRB", "".join(text), float(r.randint(1, 3)), f"{p}-{i}", f"{p:03d}-{i:03d}"))
    x = spark.createDataFrame(rows, SCHEMA).withColumn("cdr3_len", F.length("cdr3"))
    return x.where("CV_fold <> 0").cache(), x.where("CV_fold = 0").cache()


def accuracy(scores, test):
    best = scores.where("score IS NOT NULL").groupBy("specimen_label").agg(F.max_by("class", "score").alias("best"))
    rows = test.select("specimen_label", "disease").distinct().join(best, "specimen_label").collect()
    return np.mean([x.disease == x.best for x in rows]), len(rows)


def same(a, b):
    rows = lambda df: sorted((x["specimen_label"], x["class"], None if x["score"] is None else round(x["score"], 9)) for x in df.collect())
    assert rows(a) == rows(b)


def test_repertoire_model(spark, repertoires, tmp_path):
    train, test = repertoires
    model = classifiers.RepertoireModel(n_penalties=30).fit(train)
    scores = model.predict(test)
    hit, n = accuracy(scores, test)
    assert hit > 0.6 and n == 21 and len(model.choice.path) == 30
    assert all(abs(x[1] - 1) < 1e-9 for x in scores.groupBy("specimen_label").agg(F.sum("score")).collect())
    model.save(spark, str(tmp_path / "model1"))
    same(classifiers.load_model(spark, str(tmp_path), "model1").predict(test), scores)


def test_isotypes_have_their_own_components(spark, repertoires):
    train, test = ((x.withColumn("isotype_supergroup", F.when(F.col("ord").endswith("1"), "IGHM").otherwise("IGHG")) for x in repertoires))
    model = classifiers.RepertoireModel(components=3, locus="BCR", n_penalties=5).fit(train)
    assert sorted(model.parts) == ["IGHG", "IGHM"] and model.model.coefficients.shape == (3, 6)
    assert model.predict(test.where("isotype_supergroup = 'IGHG'")).count() == 63


def test_cluster_model_abstains_without_clusters(spark, repertoires, tmp_path):
    train, test = repertoires
    model = classifiers.ClusterModel(identity=0.85, n_penalties=20, refit=True).fit(train)
    alien = test.limit(3).withColumns({"specimen_label": F.lit("S999"), "cdr3": F.lit("CCCCCCCCCCCC"), "v_gene": F.lit("V9")})
    both = test.unionByName(alien)
    scores = model.predict(both)
    hit, n = accuracy(scores, test)
    assert hit > 0.85 and n >= 18
    assert [x.abstained for x in scores.where("specimen_label = 'S999'").collect()] == [True]
    model.save(spark, str(tmp_path))
    same(classifiers.load_model(spark, str(tmp_path), "model2").predict(both), scores)
    none = classifiers.ClusterModel(p_values=(1e-30,)).fit(train)
    assert none.best is None and {x.abstained for x in none.predict(test).collect()} == {True}
    none.save(spark, str(tmp_path / "none"))
    assert classifiers.ClusterModel.load(spark, str(tmp_path / "none")).predict(test).count() == 21


def test_sequence_model_tuned_and_its_importances(spark, repertoires, tmp_path):
    train, test = (classifiers.embedded(x) for x in repertoires)
    grid = (("entropy_cutoff", 0.95), ("entropy_percentile_cutoff", 0.5))
    model, means = classifiers.tuned(train.cache(), grid, folds=2, trees=15, n_penalties=8)
    assert [m[:2] for m in means] == list(grid) and (model.strategy, model.setting) in (*grid, classifiers.FALLBACK)
    scores = model.predict(test)
    hit, n = accuracy(scores, test)
    assert hit > 0.6 and n == 21
    top = model.importances(2).collect()
    assert len(top) == 6 and all(a.importance >= b.importance for a, b in zip(top[::2], top[1::2], strict=True))
    model.save(spark, str(tmp_path / "model3"))
    same(classifiers.load_model(spark, str(tmp_path), "model3").predict(test), scores)


def test_two_classes_share_one_forest(repertoires):
    train, test = (classifiers.embedded(x.where("disease <> 'C'")) for x in repertoires)
    model = classifiers.SequenceModel(trees=10, n_penalties=5).fit(train)
    assert [r[0] for r in model.forests.select("class_index").distinct().collect()] == [1]
    assert all(abs(x[1] - 1) < 1e-9 for x in model.predict(test).groupBy("specimen_label").agg(F.sum("score")).collect())


def test_saved_models_on_other_data(spark, repertoires, tmp_path):
    train, test = repertoires
    folder = str(tmp_path)
    models = {"model1": classifiers.RepertoireModel(n_penalties=10).fit(train), "model2": classifiers.ClusterModel(identity=0.85, n_penalties=10).fit(train)}
    for k, m in models.items():
        m.save(spark, f"{folder}/{k}")
    scores = external.base_scores(models, train).join(train.select("specimen_label", "participant_label", "disease").distinct(), "specimen_label")
    classifiers.Ensemble(n_penalties=10).fit(scores).save(spark, f"{folder}/ensemble")
    store.write_summary(spark, folder, "run", {"locus": "TCR"}, {})
    meta = test.select("participant_label", "specimen_label", "disease", "CV_fold").distinct()
    out = external.evaluate(spark, folder, meta, test, ("model1", "model2"), expected={"locus": "TCR"})
    report = {x.model: x for x in out.report.collect()}
    assert set(report) == {"model1", "model2", "ensemble"} and report["ensemble"].accuracy > 0.7 and report["model2"].mcc > 0.7
    assert out.dropped.count() == 0
    only = external.evaluate(spark, folder, meta.drop("disease"), test.drop("disease"), ("model1",), inference_only=True)
    assert only.report is None and only.scores.where("model = 'model1'").count() == 63
    with pytest.raises(ValueError):
        external.evaluate(spark, folder, meta.withColumn("disease", F.lit("Z")), test, ("model1",))
    with pytest.raises(ValueError):
        external.evaluate(spark, folder, meta, test, ("model1",), test_on_folds=[7])
    with pytest.raises(ValueError):
        external.evaluate(spark, folder, meta, test, ("model1",), expected={"locus": "BCR"})
    store.write_summary(spark, folder, "second", {}, {})
    with pytest.raises(ValueError):
        store.read_summary(spark, folder)
    with pytest.raises(FileNotFoundError):
        external.load_models(spark, folder, ("model3",))


def test_paths_reach_the_optimum_and_shrink():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 4)), rng.integers(0, 3, 300)
    x[:, 0] += y
    w = 1.0 / (3 * np.bincount(y)[y])
    path = linear.penalties(x, y, 3, 1.0, 12)
    b, c = linear.fit_path(x, y, 3, path, 1.0, rounds=2000, tol=1e-9)
    assert np.abs(b[0]).max() < 1e-6 and (np.diff([np.abs(v).sum() for v in b]) > -1e-6).all()
    for k in (3, 8):  # what a lasso's optimum fulfils
        slope = ((linear.softmax(x @ b[k].T + c[k]) - np.eye(3)[y]) * w[:, None]).T @ x
        on = np.abs(b[k]) > 1e-7
        assert np.allclose(slope[on], -path[k] * np.sign(b[k][on]), atol=1e-5) and (np.abs(slope[~on]) <= path[k] + 1e-5).all()
    b, c = linear.fit_path(x, y, 3, path, 0.0, rounds=2000, tol=1e-9)
    for k in (3, 8):  # and a ridge's
        slope = ((linear.softmax(x @ b[k].T + c[k]) - np.eye(3)[y]) * w[:, None]).T @ x
        assert np.allclose(slope, -path[k] * b[k], atol=1e-6)
    choice = linear.choose(x, y, rng.integers(0, 5, 300), 3, 0.0, n=12)
    assert choice.within >= choice.best and sorted(choice.folds) == [0, 1, 2, 3, 4]


def test_folds_without_a_class_and_scores():
    x, y = np.arange(8.0)[:, None], np.array([0, 0, 0, 0, 1, 1, 1, 1])
    choice = linear.choose(x, y, y, 2, 1.0, n=5)  # each fold leaves one class to learn from
    assert np.isnan(choice.mean).all() and choice.best == choice.path[2]
    p = np.array([[0.9, 0.1], [0.2, 0.8], [0.6, 0.4]])
    assert linear.roc(p, np.array([0, 1, 0])) == 1.0 and np.isnan(linear.roc(p, np.zeros(3, int)))
    assert linear.mcc(p, np.array([0, 1, 0])) == 1.0 and linear.mcc_of(np.full(3, linear.ABSTAINED), np.array([0, 1, 0])) == 0.0


def test_scores_made_of_sums_are_those_of_all_rows():
    rng = np.random.default_rng(4)
    p, y, w = rng.dirichlet(np.ones(3), (200, 2)).round(3), rng.integers(0, 3, 200), rng.random(200)
    for score, plain in ((linear.MCC, linear.mcc), (linear.ROC, linear.roc), (linear.DEVIANCE, lambda q, y: (w * np.log(np.maximum(q[np.arange(200), y], 1e-15))).sum() / w.sum())):
        sums = sum(score.partial(p[s], y[s], w[s]) for s in (slice(0, 90), slice(90, 200)))
        assert np.allclose([score.value(v, 3) for v in sums], [plain(p[:, i], y) for i in range(2)], atol=1e-9)
    assert np.isnan(linear.ROC.value(linear.ROC.partial(p, np.zeros(200, int), w)[0], 3))


def folded_rows(spark, n=240, seed=2):
    r = random.Random(seed)
    rows = [(f"S{i}", i % 4, "ABC"[i % 3], [r.gauss(i % 3, 0.9), r.gauss((i % 3) ** 2, 2.0), r.random()]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "specimen_label string, fold int, disease string, features array<double>")


@pytest.mark.parametrize(("l1_ratio", "score", "rule"), [(1.0, linear.DEVIANCE, "best"), (0.0, linear.MCC, "within"), (0.5, linear.ROC, "within")])
def test_spark_and_arrays_give_one_choice_at_any_number_of_tasks(spark, monkeypatch, l1_ratio, score, rule):
    rows, df = folded_rows(spark)
    x, y, fold = np.array([r[3] for r in rows]), np.array(["ABC".index(r[2]) for r in rows]), np.array([r[1] for r in rows])
    want = linear.choose(x, y, fold, 3, l1_ratio, score, 8)
    for cells in (2_000_000, 120):  # one task, and eight
        monkeypatch.setattr(linear, "PARTITION_CELLS", cells)
        found = linear.fit(df.repartition(8), ["A", "B", "C"], l1_ratio, score, 8, rule)
        assert np.allclose(found.choice.path, want.path) and np.allclose(found.choice.mean, want.mean) and (found.choice.best, found.choice.within) == pytest.approx((want.best, want.within))
    b, c = linear.fit_path(x, y, 3, np.array([getattr(want, rule)]), l1_ratio)
    assert np.allclose(found.model.coefficients, b[0], atol=1e-6) and accuracy(found.model.scores(df), df)[0] >= 0.65
    held = {r.specimen_label: r.probabilities for r in found.held_out(df).collect()}
    best = want.folds[rows[5][1]]
    assert len(held) == 240 and np.allclose(held["S5"], linear.softmax(best[:, :-1] @ x[5] + best[:, -1]), atol=1e-6)


def test_equal_rows_are_one_with_their_number(spark, monkeypatch):
    """Counts of clusters are few different rows: the fit is that of all rows, for much work too, which goes to several tasks."""
    r = random.Random(3)
    rows = [(i % 4, "AB"[i % 2], [float(r.randint(0, 1) + i % 2), float(r.randint(0, 1))]) for i in range(400)]
    df = spark.createDataFrame(rows, "fold int, disease string, features array<double>")
    x, y, fold = np.array([v[2] for v in rows]), np.array(["AB".index(v[1]) for v in rows]), np.array([v[0] for v in rows])
    few = linear.rows_of(df, ["A", "B"])
    assert isinstance(few, linear.ArrayRows) and len(few.x) <= 48 and few.n.sum() == 400
    assert np.allclose(few.grams(), linear.ArrayRows(x, y, fold, 2).grams())
    want = linear.choose(x, y, fold, 2, 1.0, linear.MCC, 5)
    monkeypatch.setattr(linear, "TASK_WORK", 100)
    assert isinstance(linear.rows_of(df, ["A", "B"], models=5), linear.SparkRows)
    found = linear.fit(df, ["A", "B"], 1.0, linear.MCC, 5)
    assert np.allclose(found.choice.path, want.path) and np.allclose(found.choice.mean, want.mean)


def test_parts_and_subsets_fitted_together_are_as_fitted_alone(spark):
    rows, df = folded_rows(spark)
    both = df.withColumn("part", F.lit(0)).unionByName(df.withColumn("part", F.lit(1)).withColumn("features", F.transform("features", lambda v: v * 2)))
    pairs = [("A", "C"), ("B", "C")]
    found = linear.fit_parts(both, ["A", "B", "C"], 1.0, n=6, part="part", subsets=pairs)
    assert len(found) == 4
    for (part, pair), f in found.items():
        alone = linear.fit(both.where((F.col("part") == part) & F.col("disease").isin(*pair)), list(pair), 1.0, n=6)
        assert np.allclose(alone.model.coefficients, f.model.coefficients, atol=1e-8) and alone.choice.best == pytest.approx(f.choice.best)
    assert linear.fit(df.where("disease = 'A'"), ["A"], 1.0).model.coefficients.shape == (1, 3)


def test_abstainers_keep_their_class_in_the_mcc(spark):
    """Two right answers in each of three classes, and abstainers of classes A, B, C and C."""
    model = classifiers.ClusterModel()
    model.classes = ["A", "B", "C"]
    everyone = spark.createDataFrame([(f"s{i}", f"p{i}", c) for i, c in enumerate("AABBCCABCC")], "specimen_label string, participant_label string, disease string")
    held = spark.createDataFrame([(f"s{i}", [float(i // 2 == k) for k in range(3)]) for i in range(6)] + [("s6", None)], "specimen_label string, probabilities array<double>")
    want = linear.mcc_of(np.array([0, 0, 1, 1, 2, 2] + [linear.ABSTAINED] * 4), np.array([0, 0, 1, 1, 2, 2, 0, 1, 2, 2]))
    assert model._mcc(held, everyone) == pytest.approx(want) == pytest.approx(0.580, abs=1e-3)
