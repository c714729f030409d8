import itertools
import math
import random
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktoire.functions import expressions as X
from sparktoire.models import classifiers, sequence_level
from sparktoire.models.sequence_level import choose_ridge, fit_groups, ridge_path, score_groups
from sparktoire.operators import cleaning, clustering, enrichment, features, metrics, predictions, splits


def test_threshold_uses_doubles(spark):
    df = spark.createDataFrame([(n,) for n in (10, 20, 30, 40)], "n int")
    got = {r.n: (r.a, r.b) for r in df.select("n", X.most_mismatches(F.col("n"), 0.9).alias("a"), X.most_mismatches(F.col("n"), 0.95).alias("b")).collect()}
    for n, (a, b) in got.items():
        assert a == max(d for d in range(n) if d / n <= 1 - 0.9) and b == max(d for d in range(n) if d / n <= 1 - 0.95)


def test_pairs_and_linkage_match_brute_force(spark):
    r = random.Random(1)
    rows = set()
    for _ in range(150):
        n = r.choice([10, 20, 21])
        rows.add((r.choice("AB"), "J", n, "".join(r.choices("AC", weights=[9, 1], k=n))))
    df = spark.createDataFrame(list(rows), "v_gene string, j_gene string, cdr3_len int, cdr3 string")
    near = lambda a, b: a[:3] == b[:3] and sum(x != y for x, y in zip(a[3], b[3], strict=True)) / a[2] <= 1 - 0.9
    want = {(a[3], b[3]) for a, b in itertools.product(rows, rows) if a[3] < b[3] and near(a, b)}
    assert {(p.a, p.b) for p in clustering.similar_pairs(df, 0.9).collect()} == want
    for method in ("single", "complete", "average"):
        got = clustering.hierarchical(df, 0.9, method).collect()
        assert len(got) == len(rows)
        groups = {}
        for g in got:
            groups.setdefault((g.v_gene, g.cdr3_len, g.cluster), []).append((g.v_gene, "J", g.cdr3_len, g.cdr3))
        if method == "complete":
            assert all(near(a, b) for m in groups.values() for a in m for b in m)


def test_hot_segments_lose_no_pair_and_fill_no_task(spark, monkeypatch):
    """One segment holds half of all rows of a block, and many rows differ in the last letters only."""
    r = random.Random(11)
    texts = {"".join(r.choices("ACDE", k=20)) for _ in range(300)}
    # 20 letters, two mismatches: part 0 has every third letter
    texts |= {"".join("A" if i % 3 == 0 else r.choice("AC") for i in range(20)) for _ in range(300)}
    texts |= {"W" * 14 + "".join(r.choices("ACDEFG", k=6)) for _ in range(150)}
    df = spark.createDataFrame([("V", "J", 20, t) for t in sorted(texts)], "v_gene string, j_gene string, cdr3_len int, cdr3 string")
    cut = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) / 20 <= 1 - 0.88
    want = {(a, b) for a in texts for b in texts if a < b and cut(a, b)}
    monkeypatch.setattr(clustering, "HOT", 40)
    assert {(p.a, p.b) for p in clustering.similar_pairs(df, 0.88).collect()} == want
    left, right = clustering._joinable([clustering._segments(df, clustering.BLOCK, 0.88)], clustering.BLOCK)
    keys = [*clustering.BLOCK, "part", "segment", "tile"]
    sizes = sorted(x["count"] for x in left.groupBy(*keys).count().collect())
    whole = clustering._segments(df, clustering.BLOCK, 0.88).groupBy("part", "segment").count().agg(F.max("count")).first()[0]
    assert whole > 250 and sizes[-1] <= 2 * 40
    assert right.count() >= left.count()
    # centroids: the nearest within the cut, the least rank on ties
    known = sorted(texts)[::7]
    centroids = spark.createDataFrame([("V", "J", 20, t, f"c{i}", i) for i, t in enumerate(known)], "v_gene string, j_gene string, cdr3_len int, centroid string, cluster string, rank int")
    got = {x.cdr3: x.cluster for x in clustering.nearest_centroids(df, centroids, 0.88).collect()}
    near = {t: min(((sum(x != y for x, y in zip(t, c, strict=True)), i) for i, c in enumerate(known) if cut(t, c)), default=None) for t in texts}
    assert got == {t: None if v is None else f"c{v[1]}" for t, v in near.items()}


def merged_greedily(d, cut, method):
    """Clusters by always merging the nearest two, from the definition."""
    groups = [[i] for i in range(len(d))]
    while True:
        best = min(((np.max(d[np.ix_(a, b)]) if method == "complete" else np.mean(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), default=None)
        if best is None or best[0] > cut:
            return {frozenset(g) for g in groups}
        groups[best[1]] += groups.pop(best[2])


@pytest.mark.parametrize("method", ["complete", "average"])
def test_chains_of_neighbours_give_the_tree_of_the_definition(method):
    rng = np.random.default_rng(7)
    for n in (1, 2, 9, 60):
        points = rng.normal(size=(n, 3)) + rng.integers(0, 3, (n, 1)) * 4
        d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))  # no ties
        for cut in (0.5, 1.5, 3.0, 99.0):
            label = clustering.linkage_labels(d.copy(), cut, method)
            assert {frozenset(np.flatnonzero(label == v).tolist()) for v in set(label.tolist())} == merged_greedily(d, cut, method)
            assert all(label[label[i]] == label[i] <= i for i in range(n))


def test_a_block_of_twenty_thousand_sequences(spark):
    """One block, of small components and a large one; every complete cluster is within the cut and no two could be merged."""
    r = random.Random(9)
    base = ["".join(r.choices("ACDEFGHIKLMNPQRS", k=14)) for _ in range(6000)]
    texts = {b[:k] + r.choice("ACDE") + b[k + 1 :] for b in base for k in r.choices(range(14), k=3)} | {"A" * 14}
    texts |= {"".join("C" if x & 1 << i else "A" for i in range(9)) + "WWWWW" for x in range(512)}
    df = spark.createDataFrame([("V", "J", 14, t) for t in sorted(texts)[:20000]], "v_gene string, j_gene string, cdr3_len int, cdr3 string")
    began = time.time()
    groups = {}
    for g in clustering.hierarchical(df, 0.9, "complete").collect():
        groups.setdefault(g.cluster, []).append(g.cdr3)
    assert sum(map(len, groups.values())) == df.count() and time.time() - began < 180
    differ = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    assert all(k == min(m) and differ(a, b) <= 1 for k, m in groups.items() for a in m for b in m)
    cube = {k: m for k, m in groups.items() if k.endswith("WWWWW")}
    assert not any(max(differ(a, b) for a in m for b in o) <= 1 for k, m in cube.items() for q, o in cube.items() if k < q)


def test_folds_are_even_with_participants_of_any_size(spark):
    r = random.Random(3)
    people = [(f"P{i}", "AB"[i % 3 == 0], r.choice([1, 1, 1, 2, 5, 40])) for i in range(200)]
    df = spark.createDataFrame(people, "participant_label string, disease string, n_specimens int")
    got = {x.participant_label: x.fold for x in splits.grouped_folds(df, 5, size="n_specimens").collect()}
    assert set(got) == {p for p, *_ in people}
    for c in "AB":
        sums = [sum(n for p, d, n in people if d == c and got[p] == f) for f in range(5)]
        assert max(sums) - min(sums) <= 40


def test_fisher_matches_integers(spark):
    cases = [(18, 20, 40, 100), (0, 5, 10, 50), (1, 1, 1, 1), (3, 4, 900, 2000), (2, 30, 25, 60)]
    df = spark.createDataFrame(cases, "a long, n long, k long, m long")
    for r in df.withColumn("p", enrichment.fisher_right_tail(F.col("a"), F.col("n"), F.col("k"), F.col("m"))).collect():
        exact = sum(math.comb(r.k, x) * math.comb(r.m - r.k, r.n - x) for x in range(r.a, min(r.n, r.k) + 1)) / math.comb(r.m, r.n) if r.a else 1
        assert r.p == pytest.approx(exact, rel=1e-9)


def test_aggregation_cases(spark):
    rows = [("s", "a", 1.0, [0.8, 0.1, 0.1])] + [("s", "b", 1.0, [1 / 3] * 3)] * 10 + [("s", "c", 0.0, [0.5, 0.25, 0.25]), ("s", "c", 0.0, [0.3, 0.35, 0.35])]
    df = spark.createDataFrame(rows, "specimen_label string, v_gene string, weight double, p array<double>")
    of = lambda **k: {(r.v_gene, r.class_index): r.probability for r in features.aggregated(df, ["specimen_label", "v_gene"], 3, **k).collect()}
    assert of(strategy="mean")["a", 0] == 0.8 and of(strategy="median")["a", 0] == 0.8
    assert of(strategy="entropy_cutoff")["b", 0] == pytest.approx(1 / 3)
    assert of(strategy="mean")["c", 0] == pytest.approx(0.4)


def test_splits_are_whole_and_stable(spark):
    people = spark.createDataFrame([(f"P{i}", f"S{i}", "AB"[i % 2], i % 3) for i in range(90)], "participant_label string, specimen_label string, disease string, CV_fold int")
    a = {r.participant_label: r.split_role for r in splits.split_roles(people, "cv_ensemble", 0).collect()}
    b = {r.participant_label: r.split_role for r in splits.split_roles(people.repartition(7), "cv_ensemble", 0).collect()}
    assert a == b and len(a) == 90 and sum(v == "test" for v in a.values()) == 30 and sum(v == "validation" for v in a.values()) == 20
    with pytest.raises(ValueError):
        splits.check_context("train_all", fold=1)
    with pytest.raises(ValueError):
        splits.cross_validation_cap(people.limit(1), 5)


def test_class_alignment(spark):
    t, m = (spark.createDataFrame([(c,) for c in cs], "disease string") for cs in ("AB", "AC"))
    with pytest.raises(ValueError):
        predictions.align_classes(t, m)
    assert [r.disease for r in predictions.align_classes(t, m, True).collect()] == ["A"]
    with pytest.raises(ValueError):
        predictions.align_classes(t.where("disease = 'B'"), m, True)
    with pytest.raises(ValueError):
        X.identity_threshold("TCR", True, 1.5)


def test_group_regressions_learn(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(float)
    penalty, b = choose_ridge(x, y, np.arange(200) % 5, 20)
    assert penalty > 0 and ((x @ b[:-1] + b[-1] > 0) == y).mean() > 0.85
    rows = [(f"r{i}", f"P{i % 40}", "V1" if i % 2 else "V2", "A" if y[i] else "B", x[i].tolist()) for i in range(200)] + [("z", "P0", "V9", "A", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "row_id string, participant_label string, v_gene string, disease string, embedding array<double>")
    models = fit_groups(df, n=20)
    assert {r.v_gene for r in models.collect()} == {"V1", "V2"}
    scored = score_groups(df, models).where("class = 'A' OR class IS NULL").collect()
    assert np.mean([(s.score > 0.5) == (s.disease == "A") for s in scored if s.score is not None]) > 0.85
    assert [s.score for s in scored if s.v_gene == "V9"] == [None]


def test_group_regressions_take_all_rows_of_a_group(spark):
    """A group of 260,000 rows with 48 vectors: the model is that of all its rows, of which equal ones are one with their number."""
    n, folds = 260_000, 5
    x = spark.range(n).select(F.col("id"), F.concat(F.lit("P"), F.col("id") % 31).alias("participant_label"), F.lit("V1").alias("v_gene"))
    v = [F.pmod(F.xxhash64("id", F.lit(j)), F.lit(m)) for j, m in ((0, 4), (1, 3), (2, 4))]
    x = x.withColumn("embedding", F.array(*[c.cast("float") for c in v]))
    x = x.withColumn("disease", F.when(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(9)) < 2 + F.col("embedding")[0] + F.col("embedding")[1], "A").otherwise("B")).cache()
    rows = x.toPandas()
    assert len(rows) == n and rows["embedding"].map(tuple).nunique() == 48
    z = np.stack(rows["embedding"].to_list()).astype(float)
    scale = z.std(0)
    y, fold = (rows["disease"] == "A").to_numpy(float), rows["participant_label"].map(lambda p: zlib.crc32(p.encode()) % folds).to_numpy()
    penalty, b = choose_ridge((z - z.mean(0)) / scale, y, fold, 10)
    got = {r["class"]: r for r in fit_groups(x, n=10, folds=folds).collect()}
    assert sorted(got) == ["A", "B"] and got["A"].penalty == pytest.approx(penalty, rel=1e-9)
    assert np.allclose(got["A"].coefficients, b[:-1] / scale, atol=1e-7) and got["A"].intercept == pytest.approx(b[-1] - b[:-1] / scale @ z.mean(0), abs=1e-6)
    assert np.allclose(got["A"].coefficients, -np.array(got["B"].coefficients), atol=1e-6)


def test_all_penalties_of_a_ridge_path_are_solved_together(monkeypatch):
    """Every slope is 0 at the end, also where the classes can be told apart and neighbours are far from each other; the rows are
    passed fewer times than there are penalties."""
    rng = np.random.default_rng(1)
    for noise, path in ((0.0, np.array([1.0, 1e-3, 1e-7])), (2.0, np.geomspace(10.0, 1e-7, 100))):
        x = rng.normal(size=(500, 4))
        y = (x[:, 0] + noise * rng.normal(size=500) > 0).astype(float)
        w, passes = sequence_level._balanced(y), []
        monkeypatch.setattr(sequence_level.np, "clip", lambda v, *a, f=np.clip: passes.append(np.ndim(v)) or f(v, *a))
        b = ridge_path(x, y, w, path)
        monkeypatch.undo()
        p = 1 / (1 + np.exp(-np.clip(x @ b[:, :-1].T + b[:, -1], -30, 30)))
        slope = ((y[:, None] - p) * w[:, None]).T @ np.hstack([x, np.ones((500, 1))])
        slope[:, :-1] -= path[:, None] * b[:, :-1]
        assert np.abs(slope).max() < 1e-8
        assert len(passes) < 100


def test_ensemble_follows_its_models(spark):
    rows = [(f"S{i}", f"P{i}", m, c, 0.8 if (c == "A") == (i % 2 == 0) else 0.2, "AB"[i % 2]) for i in range(40) for m in (1, 2) for c in "AB"]
    df = spark.createDataFrame([*rows, ("S99", "P99", 1, "A", None, "A")], "specimen_label string, participant_label string, model int, class string, score double, disease string")
    scores = classifiers.Ensemble(n_penalties=10).fit(df).predict(df).where("class = 'A'").collect()
    assert all((s.score > 0.5) == (int(s.specimen_label[1:]) % 2 == 0) for s in scores) and len(scores) == 40


def test_clones_are_assigned_on_nucleotides_if_there_are_any(spark):
    rows = [("P1", "V1", "J1", "CASSLAPGETQYF", "ACGTACGTACGTACGTACGT"), ("P1", "V1", "J1", "CASSLAPGETQYW", "acgtacgtacgt-acgtacgt"), ("P1", "V1", "J1", "CASSLAPGETQYF", "TTTTACGTACGTACGTAAAA"), ("P2", "V1", "J1", "CASSLAPGETQYF", "ACGN")]
    df = spark.createDataFrame(rows, "participant_label string, v_gene string, j_gene string, cdr3_aa string, cdr3 string")
    on_nt = sorted(((r.participant_label, r.cdr3, r.clone_id) for r in clustering.assigned_clones(df).collect()), key=repr)
    assert on_nt == [("P1", "ACGTACGTACGTACGTACGT", "Clone_1"), ("P1", "TTTTACGTACGTACGTAAAA", "Clone_2"), ("P1", "acgtacgtacgt-acgtacgt", "Clone_1"), ("P2", "ACGN", "Unknown")]
    on_aa = clustering.assigned_clones(df.drop("cdr3"), "TCR").collect()
    assert {r.clone_id for r in on_aa} == {"Clone_1"}
    named = df.withColumn("clone_id", F.lit("mine"))
    assert {r.clone_id for r in clustering.assigned_clones(named).collect()} == {"mine"}
    assert "mine" not in {r.clone_id for r in clustering.assigned_clones(named, force=True).collect()}


def test_segments_skip_common_ends(spark):
    r = random.Random(4)
    texts = ["CASS" + "".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=7)) + "EQYF" for _ in range(300)]
    df = spark.createDataFrame([("V", "J", 15, t) for t in texts], "v_gene string, j_gene string, cdr3_len int, cdr3 string")
    segments = clustering._segments(df, clustering.BLOCK, 0.85)
    assert segments.groupBy("part", "segment").count().agg({"count": "max"}).first()[0] < 60
    want = {(a, b) for a, b in itertools.combinations(sorted(set(texts)), 2) if sum(x != y for x, y in zip(a, b, strict=True)) / 15 <= 1 - 0.85}
    assert {(p.a, p.b) for p in clustering.similar_pairs(df, 0.85).collect()} == want


def test_scores_of_missing_classes_and_thresholds(spark):
    scores = spark.createDataFrame([("S1", "A", "A", 0, 0.7), ("S1", "A", "B", 1, 0.3), ("S2", "C", "A", 0, 0.6), ("S2", "C", "B", 1, 0.4)], "specimen_label string, true_class string, class string, class_index int, score double")
    full = metrics.with_all_classes(scores)
    assert sorted((x.specimen_label, x.score) for x in full.where("class = 'C'").collect()) == [("S1", 0.0), ("S2", 0.0)]
    areas = {x["class"]: x.auroc for x in metrics.auroc(metrics.one_vs_rest(full), ["class"]).collect()}
    assert areas == {"A": 1.0, "B": None, "C": 0.5}
    half = {x["class"]: (x.sensitivity, x.specificity) for x in metrics.at_threshold(metrics.one_vs_rest(full), ["class"]).collect()}
    assert half == {"A": (1.0, 0.0), "B": (None, 1.0), "C": (0.0, 1.0)}


def test_duplicates_and_clones_against_plain_loops(spark):
    """Ties, unknown reads, null keys, and a sequence and a clone that hold most rows."""
    r = random.Random(5)
    rows = []
    for i in range(900):
        hot = i % 3 > 0
        rows.append((f"{i:04d}", "P0" if hot else f"P{r.randrange(3)}", "ACGT" if hot else f"AC{r.randrange(40)}", "R0", r.choice([None, 1, 2, 2]), r.choice([None, "S0", "S1"]), None if r.random() < 0.1 else "c0" if hot else f"c{r.randrange(5)}", "TCRB"))
    x = spark.createDataFrame(rows, "ord string, participant_label string, sequence string, replicate_label string, num_reads int, repertoire_id string, igh_or_tcrb_clone_id string, isotype_supergroup string")
    groups: dict[tuple, list] = {}
    for row in sorted(rows):
        groups.setdefault(row[1:4], []).append(row)

    def first(values):
        return next((v for v in values if v is not None), None)

    def total(values):
        known = [v for v in values if v is not None]
        return sum(known) if known else None

    want = [(g[0][0], *k, total([v[4] for v in g]), first([v[5] for v in g]), first([v[6] for v in g])) for k, g in groups.items()]
    got = [(v.ord, v.participant_label, v.sequence, v.replicate_label, v.num_reads, v.repertoire_id, v.igh_or_tcrb_clone_id) for v in cleaning.collapse_duplicates(x).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    clones: dict[tuple, list] = {}
    for row in rows:
        if row[5] is not None and row[6] is not None:
            clones.setdefault((row[5], row[6]), []).append(row)
    best = {k: min(g, key=lambda v: (v[4] is None, -(v[4] or 0), v[0])) for k, g in clones.items()}
    out = cleaning.downsample(x)
    assert out.columns == [*(c if c != "repertoire_id" else "specimen_label" for c in x.columns), "num_clone_members", "total_clone_num_reads"]
    assert {(v.specimen_label, v.igh_or_tcrb_clone_id): (v.ord, v.num_reads, v.num_clone_members, v.total_clone_num_reads) for v in out.collect()} == {k: (best[k][0], best[k][4], len(g), total([v[4] for v in g])) for k, g in clones.items()}
    assert cleaning.downsample(x.limit(0)).count() == 0 and cleaning.collapse_duplicates(x.limit(0)).count() == 0


def test_collapsed_rows_take_the_first_value_of_each_column_whatever_is_null(spark):
    rng = random.Random(5)
    rows = [(f"P{rng.randrange(3)}", f"s{rng.randrange(6)}", "R", rng.randrange(9), f"{i:03}", rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 3])) for i in rng.sample(range(200), 200)]
    df = spark.createDataFrame(rows, "participant_label string, sequence string, replicate_label string, num_reads int, ord string, x string, y int").repartition(7)
    want = {}
    for p, s, _, n, o, x, y in sorted(rows, key=lambda r: r[4]):
        old = want.get((p, s), (0, o, None, None))
        want[p, s] = (old[0] + n, old[1], x if old[2] is None else old[2], y if old[3] is None else old[3])
    got = {(r.participant_label, r.sequence): (r.num_reads, r.ord, r.x, r.y) for r in cleaning.collapse_duplicates(df).collect()}
    assert got == want


def test_downsampled_rows_of_queries_carry_only_what_is_read(spark):
    from sparktoire.plans import base

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = base.downsampled(spark, "/root/testdata/sf0.001")
        assert not {"sequence", "v_call", "productive"} & set(x.columns)
        plan = base.repertoire(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        # customers meet the orders, not the lines
        assert "o_custkey" in next(line for line in plan.splitlines() if "Join" in line and "c_custkey" in line)
        joins = [line for line in plan.splitlines() if "Join Inner" in line]
        assert "l_orderkey" in joins[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rounds_of_components_carry_only_sequences_with_a_pair(spark, monkeypatch):
    """A cluster of one needs no round, and a side of the pairs' join without tiles is shuffled once."""
    rows = [("V1", "J1", 20, t) for t in ["A" * 20, "A" * 19 + "C", "A" * 18 + "CC"] + [c * 10 + d * 10 for c in "DEFGHIKL" for d in "MNPQRSTV"]]
    df = spark.createDataFrame([*rows, rows[0]], "v_gene string, j_gene string, cdr3_len int, cdr3 string")
    sizes, written = [], clustering.written
    monkeypatch.setattr(clustering, "written", lambda x: sizes.append((set(x.columns) >= {"cluster"}, (out := written(x)).count())) or out)
    found = {r.cdr3: r.cluster for r in clustering.single_linkage(df, 0.95).collect()}
    assert found == {t: "A" * 20 if t.startswith("A") else t for *_, t in rows}
    rounds = [n for labels, n in sizes if labels]
    assert rounds and set(rounds) == {3}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = clustering.similar_pairs(df, 0.95)
        assert pairs.count() == 2
        pairs.collect()
        assert "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_consensus_counts_copies_once_and_sorts_no_letters(spark):
    rows = [("a", "ACD", 1, "o1"), ("a", "AGD", 1, "o0"), ("a", "ACD", 2, "o9"), ("b", "CC", 5, "o3"), ("b", "CC", 1, "o2"), ("c", "CA", 2, "o5"), ("c", "CG", 2, "o4"), (None, "DD", 1, "o6"), (None, "DE", 3, "o7"), ("d", None, 1, "o8"), ("e", "", 1, "o8")]
    got = clustering.consensus(spark.createDataFrame(rows, "k string, cdr3 string, weight long, ord string"), ["k"])
    # of "c" both letters weigh 2; the one with the earlier row wins
    assert {r.k: r.centroid for r in got.collect()} == {"a": "ACD", "b": "CC", "c": "CG", None: "DE", "e": ""}
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
