"""The three base models and the ensemble over them, each with its own folder when saved."""

from __future__ import annotations

import copy
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, FloatType

from sparktoire.models import base, forests, linear, store
from sparktoire.models.forests import TREES
from sparktoire.models.sequence_level import class_arrays, fit_group_forests, fit_groups
from sparktoire.operators import clustering, enrichment, features, predictions, splits
from sparktoire.operators.clustering import BLOCK
from sparktoire.operators.storage import written

#: Mixes of the elastic nets: lasso 1, ridge 0; by locus for the repertoire model.
MIXES = {"lasso": 1.0, "elasticnet0.75": 0.75, "elasticnet": 0.5, "elasticnet0.25": 0.25, "ridge": 0.0}
LOCUS_MIX = {"TCR": MIXES["lasso"], "BCR": MIXES["elasticnet0.25"]}
P_VALUES = (0.0005, 0.001, 0.005, 0.01, 0.05)
#: What the tuning of the sequence model tries, and what it takes if nothing helps.
TUNING = (*(("entropy_cutoff", v) for v in (0.80, 0.90, 0.95)), *(("entropy_percentile_cutoff", v) for v in (0.01, 0.05, 0.1, 0.5)))
FALLBACK = ("entropy_percentile_cutoff", 0.01)


class RepertoireModel(base.Model):
    """V-J frequencies of each isotype: log, scaling, principal components, scaling, and an elastic net over all of them."""

    def __init__(self, components: int = 15, locus: str = "TCR", n_penalties: int = linear.PENALTIES, folds: int = linear.FOLDS, rule: str = "best"):
        self.components, self.locus, self.n_penalties, self.folds, self.rule = components, locus, n_penalties, folds, rule

    @staticmethod
    def frequencies(df: DataFrame) -> DataFrame:
        """``specimen_label, isotype_supergroup, feature, frequency``; the frequencies are in logarithms."""
        return features.vj_frequencies(df).select("specimen_label", "isotype_supergroup", "feature", F.log1p("frequency").alias("frequency"))

    def _vectors(self, frequencies: DataFrame, isotype: str) -> DataFrame:
        return base.assembled(frequencies.where(F.col("isotype_supergroup") == isotype), self.parts[isotype]["features"])

    def _transformed(self, frequencies: DataFrame) -> DataFrame:
        """The components of all isotypes in a row; a specimen that lacks an isotype has zeros, the mean, there."""
        out, width = frequencies.select("specimen_label").distinct(), []
        for i, (isotype, part) in enumerate(sorted(self.parts.items())):
            center, turn = linear.Scaling(np.array(part["mean"]), np.array(part["scale"])), np.array(part["components"])
            z = linear.mapped(self._vectors(frequencies, isotype), "specimen_label", lambda x, center=center, turn=turn: center(x) @ turn)
            out = out.join(z.withColumnRenamed("features", f"part_{i}"), "specimen_label", "left")
            width.append(F.coalesce(f"part_{i}", F.array_repeat(F.lit(0.0), turn.shape[1])))
        return out.select("specimen_label", F.concat(*width).alias("features"))

    def _prepare(self, frequencies: DataFrame) -> None:
        """Features, scaling and principal components of each isotype."""
        self.parts = {}
        for isotype in base.classes_of(frequencies, "isotype_supergroup"):
            # V-J pairs are bounded by the genes of the locus
            self.parts[isotype] = {"features": sorted(r[0] for r in frequencies.where(F.col("isotype_supergroup") == isotype).select("feature").distinct().collect())}
            n, mean, covariance = linear.moments(self._vectors(frequencies, isotype), len(self.parts[isotype]["features"]))
            scaling = linear.Scaling.of(mean, np.diag(covariance))
            values, vectors = np.linalg.eigh(covariance / np.outer(scaling.scale, scaling.scale))
            k = max(1, min(self.components, len(mean), n - 1))
            turn = vectors[:, ::-1][:, :k] / np.sqrt(np.maximum(values[::-1][:k], 1e-12))
            turn[:, values[::-1][:k] < 1e-10] = 0
            self.parts[isotype] |= {"mean": mean.tolist(), "scale": scaling.scale.tolist(), "components": turn.tolist()}

    def _rows(self, frequencies: DataFrame, people: DataFrame) -> DataFrame:
        return base.folded(self._transformed(frequencies).join(people, "specimen_label"), self.folds)

    def fit(self, df: DataFrame) -> RepertoireModel:
        self.classes, frequencies = base.classes_of(df), written(self.frequencies(df))
        self._prepare(frequencies)
        found = linear.fit(written(self._rows(frequencies, base.people(df))), self.classes, LOCUS_MIX[self.locus], n=self.n_penalties, rule=self.rule)
        self.model, self.choice = found.model, found.choice
        return self

    @classmethod
    def fit_pairs(cls, df: DataFrame, pairs: list[tuple[str, str]], **settings) -> dict[tuple[str, str], RepertoireModel]:
        """A model of each pair of classes ``(disease, reference)``, as ``fit`` gives it of the pair's rows.

        Frequencies are made once, and the penalty paths of all pairs and folds advance together.
        """
        people = written(base.people(df))
        frequencies, models, rows = written(cls.frequencies(df).join(people.drop("participant_label"), "specimen_label")), {}, None
        for i, pair in enumerate(pairs):
            mine = written(frequencies.where(F.col("disease").isin(*pair)).drop("disease"))
            models[pair] = model = cls(**settings)
            model.classes = list(pair[::-1])
            model._prepare(mine)
            part = written(model._rows(mine, people).withColumns({"part": F.lit(i), "y": F.when(F.col("disease") == pair[0], "1").otherwise("0")}))
            rows = part.withColumn("width", F.size("features")) if rows is None else rows.unionByName(part.withColumn("width", F.size("features")))
        # a pair of few specimens has fewer components; the others' places are zeros
        most = rows.agg(F.max("width")).first()[0]
        same = rows.withColumn("features", F.concat("features", F.array_repeat(F.lit(0.0), F.lit(most) - F.col("width"))))
        first = models[pairs[0]]
        found = linear.fit_parts(same, ["0", "1"], LOCUS_MIX[first.locus], n=first.n_penalties, rule=first.rule, label="y", part="part")
        for i, pair in enumerate(pairs):
            width = sum(np.shape(p["components"])[1] for p in models[pair].parts.values())
            if (i, ("0", "1")) not in found:
                raise ValueError(f"nothing to learn for {pair}: a class has no rows")
            fit = found[i, ("0", "1")]
            models[pair].model, models[pair].choice = linear.Linear(models[pair].classes, fit.model.coefficients[:, :width], fit.model.intercepts), fit.choice
        return models

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.scores(self._transformed(written(self.frequencies(df))))

    def save(self, spark: SparkSession, folder: str) -> None:
        store.write_json(spark, f"{folder}/model.json", {"parts": self.parts, "model": self.model.to_json(), "locus": self.locus, "components": self.components})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> RepertoireModel:
        x = store.read_json(spark, f"{folder}/model.json")
        out = cls(x["components"], x["locus"])
        out.parts, out.model = x["parts"], linear.Linear.of_json(x["model"])
        out.classes = out.model.classes
        return out


class ClusterModel(base.Model):
    """Distinct convergent clusters per class, chosen by p-value; specimens without one abstain."""

    def __init__(self, identity: float = 0.9, p_values: tuple[float, ...] = P_VALUES, mix: str = "lasso", n_penalties: int = linear.PENALTIES, folds: int = linear.FOLDS, refit: bool = False):
        self.identity, self.p_values, self.mix, self.n_penalties, self.folds, self.refit = identity, p_values, mix, n_penalties, folds, refit

    def _features(self, hits: DataFrame, p_values: tuple[float, ...]) -> DataFrame:
        """``specimen_label, part, features``: for each threshold, the specimens with a predictive cluster."""
        thresholds = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.lit(float(p)).alias("most")) for i, p in enumerate(p_values)])).alias("t")
        chosen = self.scores.select(*BLOCK, "cluster", "disease", "p_value", thresholds).where(F.col("p_value") <= F.col("t.most")).select(*BLOCK, "cluster", "disease", "t.part")
        counts = hits.where("cluster IS NOT NULL").join(chosen, [*BLOCK, "cluster"]).groupBy("specimen_label", "part", "disease").agg(F.countDistinct(*BLOCK, "cluster").alias("n"))
        x = base.assembled(counts.withColumn("__key", F.concat_ws(":", "part", "specimen_label")), self.classes, "__key", "disease", "n")
        return x.select(F.expr("substring(__key, instr(__key, ':') + 1)").alias("specimen_label"), F.substring_index("__key", ":", 1).cast("int").alias("part"), "features")

    def hits(self, df: DataFrame) -> DataFrame:
        """Every row with its nearest cluster, or null; written, as each threshold reads it."""
        return written(enrichment.assigned(df, self.centroids, self.identity).select("specimen_label", *BLOCK, "cluster"))

    def fit(self, df: DataFrame, second: DataFrame | None = None) -> ClusterModel:
        """Clusters come from ``df``; the classifier and the threshold from ``second``, or ``df`` too.

        With ``refit`` the classifier of the best threshold is fitted again on both.
        """
        both = df if second is None else df.unionByName(second)
        second = df if second is None else second
        self.classes, keys = base.classes_of(df), [*BLOCK, "cluster"]
        clustered = written(df.join(clustering.single_linkage(df, self.identity), [*BLOCK, "cdr3"]))
        scores = written(enrichment.fisher_scores(clustered, keys))
        kept = enrichment.significant(scores, keys, max(self.p_values))
        self.scores = written(scores.join(kept, keys, "left_semi"))
        self.centroids = written(enrichment.centroids(clustered.join(kept, keys, "left_semi")).withColumn("rank", F.col("cluster")))
        found = self._fit_thresholds(self.hits(second), base.people(second), self.p_values)
        # of equal ones the first threshold
        self.best = max(found, key=lambda x: x["mcc"], default=None)
        if self.refit and self.best:
            again = self._fit_thresholds(self.hits(both), base.people(both), (self.best["p_value"],))
            self.best |= {k: again[0][k] for k in ("scaling", "model")} if again else {}
        return self

    def _fit_thresholds(self, hits: DataFrame, everyone: DataFrame, p_values: tuple[float, ...]) -> list[dict]:
        """``p_value, mcc, scaling, model`` of each threshold, all fitted together.

        A threshold is left out where there is nothing to learn from: no cluster, one class, fewer participants than
        folds, or no variance. The MCC is that of held-out predictions; every specimen without a score counts as a
        prediction that is wrong for its own class.
        """
        known = everyone.where(F.col("disease").isin(self.classes))
        x = written(base.folded(known, self.folds).join(self._features(hits, p_values), "specimen_label"))
        about = x.groupBy("part").agg(F.countDistinct("disease").alias("classes"), F.countDistinct("participant_label").alias("people"), F.countDistinct("features").alias("rows"))
        kept = sorted(r["part"] for r in about.collect() if r["classes"] > 1 and r["people"] >= self.folds and r["rows"] > 1)
        if not kept:
            return []
        scalings = {p: linear.Scaling(np.zeros(len(self.classes)), np.ones(len(self.classes))) for p in range(len(p_values))}
        for r in x.select("part", F.posexplode("features").alias("i", "v")).groupBy("part", "i").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance")).collect():
            one = linear.Scaling.of(np.array(r["mean"]), np.array(r["variance"]))
            scalings[r["part"]].mean[r["i"]], scalings[r["part"]].scale[r["i"]] = one.mean, one.scale
        of = lambda name: F.array(*[F.array(*map(F.lit, getattr(scalings[p], name).tolist())) for p in range(len(p_values))])[F.col("part")]
        centred = F.zip_with("features", of("mean"), lambda v, m: v - m)
        z = written(x.where(F.col("part").isin(kept)).withColumn("features", F.zip_with(centred, of("scale"), lambda v, m: v / m)))
        fits = {p: f for (p, _), f in linear.fit_parts(z, self.classes, MIXES[self.mix], n=self.n_penalties, part="part").items()}
        return [{"p_value": p_values[p], "mcc": self._mcc(f.held_out(z.where(F.col("part") == p)), everyone), "scaling": scalings[p], "model": f.model} for p, f in sorted(fits.items())]

    def _mcc(self, held_out: DataFrame, everyone: DataFrame) -> float:
        """MCC over all specimens; those without a score are predicted as a class that there is not."""
        best = F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1
        cells = everyone.join(held_out.select("specimen_label", best.alias("best")), "specimen_label", "left").groupBy("disease", "best").count().collect()
        names = sorted({r["disease"] for r in cells} | set(self.classes))
        table = np.zeros((len(names) + 1, len(names) + 1))
        for r in cells:
            table[names.index(r["disease"]), len(names) if r["best"] is None else names.index(self.classes[r["best"]])] += r["count"]
        return linear.mcc_of_cells(table)

    def predict(self, df: DataFrame) -> DataFrame:
        """Scores, null for specimens that abstain; without any predictive cluster all do."""
        if self.best is None:
            return base.no_scores(df)
        z = linear.mapped(self._features(self.hits(df), (self.best["p_value"],)), "specimen_label", self.best["scaling"])
        scored = self.best["model"].scores(z)
        return df.select("specimen_label").distinct().join(scored, "specimen_label", "left").withColumn("abstained", F.col("score").isNull())

    def save(self, spark: SparkSession, folder: str) -> None:
        """A model without a predictive cluster is saved as such: all abstain."""
        best = self.best and {"p_value": self.best["p_value"], "mcc": self.best["mcc"], "mean": self.best["scaling"].mean.tolist(), "scale": self.best["scaling"].scale.tolist(), "model": self.best["model"].to_json()}
        store.write_table(self.scores, f"{folder}/scores")
        store.write_table(self.centroids, f"{folder}/centroids")
        store.write_json(spark, f"{folder}/model.json", {"identity": self.identity, "mix": self.mix, "classes": self.classes, "best": best})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> ClusterModel:
        x = store.read_json(spark, f"{folder}/model.json")
        out = cls(x["identity"], mix=x["mix"])
        out.classes, best = x["classes"], x["best"]
        out.best = best and {"p_value": best["p_value"], "mcc": best["mcc"], "scaling": linear.Scaling(np.array(best["mean"]), np.array(best["scale"])), "model": linear.Linear.of_json(best["model"])}
        out.scores, out.centroids = (spark.read.parquet(f"{folder}/{t}") for t in ("scores", "centroids"))
        return out


class SequenceModel(base.Model):
    """A model per gene group over embeddings, its scores aggregated per specimen, and a forest per class over these.

    T cells: a group is a V gene, its models are ridge regressions. B cells: a group is a V gene and an
    isotype, its model is a forest, and the strategy is the mean; a group's share is that within its isotype.
    """

    def __init__(self, strategy: str | None = None, setting: float | None = None, trees: int = TREES, n_penalties: int = linear.PENALTIES, locus: str = "TCR", group_trees: int = TREES):
        default = FALLBACK if locus == "TCR" else ("mean", 0.0)
        self.strategy, self.setting = strategy or default[0], default[1] if setting is None else setting
        self.trees, self.n_penalties, self.locus, self.group_trees = trees, n_penalties, locus, group_trees

    @property
    def _share_keys(self) -> tuple[str, ...]:
        return () if self.locus == "TCR" else ("isotype_supergroup",)

    def _kept(self, df: DataFrame, common: DataFrame | None = None) -> DataFrame:
        """The rows of groups that are common (those of training, unless some are given), with the group in ``v_gene``."""
        plain = lambda c: F.replace(F.col(c), F.lit("_"), F.lit("-"))
        x = df.withColumn("v_gene", plain("v_gene"))
        if common is not None:
            x = x.join(common.select(plain("v_gene").alias("v_gene")), "v_gene", "left_semi")
        if self.locus != "TCR":
            x = x.withColumn("v_gene", F.concat_ws("_", "v_gene", plain("isotype_supergroup")))
        return x if common is not None else x.where(F.col("v_gene").isin(self.genes))

    def sequence_scores(self, kept: DataFrame) -> DataFrame:
        """``p``: an array over all classes per row; a class that the group's model lacks has 0, rows of groups without a model go."""
        columns = ["row_id", "specimen_label", "v_gene", "weight"]
        if self.locus == "TCR":
            return class_arrays(kept.select(*columns, "embedding"), self.models, self.classes).select(*columns, "p")
        scored = forests.score_forests(kept, self.models, ["v_gene"], "row_id", self.classes, "embedding").select("row_id", "p")
        return kept.select(*columns).join(scored, "row_id")

    def _group_features(self, p: DataFrame, kept: DataFrame, threshold: float | None) -> DataFrame:
        n = len(self.classes)
        x = features.aggregated(p, ["specimen_label", "v_gene"], n, self.strategy, self.setting, threshold)
        full = features.featurized(x, kept, kept.sparkSession.createDataFrame([(g,) for g in self.genes], "v_gene string"), n)
        shares = features.group_frequencies(kept, full.select("v_gene").distinct(), within=self._share_keys).select("specimen_label", "v_gene", "frequency")
        return full.join(shares, ["specimen_label", "v_gene"], "left").withColumn("frequency", F.coalesce("frequency", F.lit(0.0)))

    def _inputs(self, x: DataFrame) -> DataFrame:
        """``specimen_label, class_index, features``: scaled probabilities times shares, scaled again, in the order of the groups."""
        keys = ["class_index", "v_gene"]
        scaled = lambda v, name: (v - F.col(f"{name}_mean")) / F.col(f"{name}_scale")
        value = scaled(scaled(F.col("probability"), "first") * F.col("frequency"), "second")
        each = x.join(self.scalings, keys).select("specimen_label", "class_index", F.struct("v_gene", value.alias("value")).alias("s"))
        return each.groupBy("specimen_label", "class_index").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["value"]).alias("features"))

    def _fit_models(self, df: DataFrame) -> DataFrame:
        """The groups' models; the kept rows, written."""
        self.classes = base.classes_of(df)
        kept = written(self._kept(df, features.common_v_genes_by_class(df)))
        self.genes = sorted(r[0] for r in kept.select("v_gene").distinct().collect())
        self.models = written(fit_groups(kept, n=self.n_penalties) if self.locus == "TCR" else fit_group_forests(kept, trees=self.group_trees))
        return kept

    def _fit_scores(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Stage one: the kept rows and their scores, written."""
        kept = self._fit_models(df)
        return kept, written(self.sequence_scores(kept))

    def _fit_forests(self, kept: DataFrame, p: DataFrame) -> SequenceModel:
        """Stage two. With two classes there is one forest; the other class has what is left."""
        self.threshold = features.entropy_threshold(p, self.setting) if self.strategy == "entropy_percentile_cutoff" else None
        x, everyone = written(self._group_features(p, kept, self.threshold)), base.people(kept)
        keys = ["class_index", "v_gene"]
        moments = lambda df, value, name: df.groupBy(*keys).agg(F.avg(value).alias(f"{name}_mean"), F.when(F.var_pop(value) > 1e-24, F.stddev_pop(value)).otherwise(1.0).alias(f"{name}_scale"))
        first = written(moments(x, F.col("probability"), "first"))
        product = (F.col("probability") - F.col("first_mean")) / F.col("first_scale") * F.col("frequency")
        self.scalings = written(first.join(moments(x.join(first, keys), product, "second"), keys))
        fitted = [i for i in range(len(self.classes)) if len(self.classes) > 2 or i > 0]
        own = F.element_at(F.array(*map(F.lit, self.classes)), F.col("class_index") + 1)
        rows = self._inputs(x).where(F.col("class_index").isin(fitted)).join(everyone, "specimen_label").withColumn("label", F.when(F.col("disease") == own, "1").otherwise("0"))
        self.forests = written(forests.fit_forests(rows, ["class_index"], "label", trees=self.trees, order="specimen_label"))
        return self

    def fit(self, df: DataFrame, second: DataFrame | None = None) -> SequenceModel:
        """Groups and their models come from ``df``; the forests from ``second``, or ``df`` too."""
        kept = self._fit_models(df)
        if second is not None:
            kept = written(self._kept(second))
        return self._fit_forests(kept, written(self.sequence_scores(kept)))

    def predict(self, df: DataFrame) -> DataFrame:
        """One score per class; with more than two classes they need not sum to 1."""
        kept = self._kept(df)
        return self._predicted(written(self._group_features(self.sequence_scores(kept), kept, self.threshold)))

    def _predicted(self, x: DataFrame) -> DataFrame:
        rows = self._inputs(x).withColumn("__row", F.concat_ws(":", "class_index", "specimen_label"))
        p = forests.score_forests(rows, self.forests, ["class_index"], "__row", ["1"])
        scored = p.select(F.expr("substring(__row, instr(__row, ':') + 1)").alias("specimen_label"), "class_index", F.col("p")[0].alias("score"))
        if len(self.classes) == 2:
            scored = scored.unionByName(scored.select("specimen_label", F.lit(0).alias("class_index"), (1 - F.col("score")).alias("score")))
        return scored.select("specimen_label", F.element_at(F.array(*map(F.lit, self.classes)), F.col("class_index") + 1).alias("class"), "class_index", "score")

    def importances(self, n: int = 10) -> DataFrame:
        """``class, position, v_gene, importance``: the ``n`` groups that matter most to each class's forest."""
        each = forests.importances(self.forests, ["class_index"], self.genes)
        ranked = each.groupBy("class_index").agg(F.sort_array(F.collect_list(F.struct("importance", "feature")), asc=False).alias("all"))
        name = F.element_at(F.array(*map(F.lit, self.classes)), F.col("class_index") + 1).alias("class")
        return ranked.select(name, F.posexplode(F.slice("all", 1, n)).alias("position", "x")).select("class", (F.col("position") + 1).alias("position"), F.col("x.feature").alias("v_gene"), "x.importance")

    def save(self, spark: SparkSession, folder: str) -> None:
        for name in ("models", "forests", "scalings"):
            store.write_table(getattr(self, name), f"{folder}/{name}")
        store.write_json(spark, f"{folder}/model.json", {"strategy": self.strategy, "setting": self.setting, "trees": self.trees, "group_trees": self.group_trees, "locus": self.locus, "classes": self.classes, "genes": self.genes, "threshold": self.threshold})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> SequenceModel:
        x = store.read_json(spark, f"{folder}/model.json")
        out = cls(x["strategy"], x["setting"], x["trees"], locus=x["locus"], group_trees=x["group_trees"])
        out.classes, out.genes, out.threshold = x["classes"], x["genes"], x["threshold"]
        for name in ("models", "forests", "scalings"):
            setattr(out, name, spark.read.parquet(f"{folder}/{name}"))
        return out


def tuned(df: DataFrame, grid=TUNING, folds: int = 3, trees: int = TREES, n_penalties: int = linear.PENALTIES) -> tuple[SequenceModel, list[tuple[str, float, float]]]:
    """The sequence model with the strategy of the best mean MCC over participant folds, and the means.

    Stage one is fitted once per fold and shared by all candidates. If none is better than chance,
    the fallback is taken; ties go to the first of the grid.
    """
    x = written(base.folded(df, folds))
    sums = dict.fromkeys(grid, 0.0)
    for f in range(folds):
        train, test = x.where(F.col("fold") != f).drop("fold"), x.where(F.col("fold") == f).drop("fold")
        model = SequenceModel(trees=trees, n_penalties=n_penalties)
        kept, p = model._fit_scores(train)
        inner = written(model._kept(test))
        q, truth = written(model.sequence_scores(inner)), base.people(test)

        def score(candidate: tuple[str, float], model=model, kept=kept, p=p, q=q, inner=inner, truth=truth) -> float:
            own = copy.copy(model)
            own.strategy, own.setting = candidate
            own._fit_forests(kept, p)
            best = own._predicted(written(own._group_features(q, inner, own.threshold))).groupBy("specimen_label").agg(F.max_by("class", F.struct("score", -F.col("class_index"))).alias("predicted"))
            rows = truth.join(best, "specimen_label").select("disease", "predicted").collect()
            number = {c: i for i, c in enumerate(sorted({v for r in rows for v in r}))}
            return linear.mcc_of(np.array([number[r["predicted"]] for r in rows], np.int64), np.array([number[r["disease"]] for r in rows], np.int64)) if rows else 0.0

        # the candidates' jobs are small and wait for each other; side by side they fill the executors
        with ThreadPoolExecutor(len(grid)) as pool:
            for candidate, value in zip(grid, pool.map(score, grid), strict=True):
                sums[candidate] += value / folds
    best = max(grid, key=lambda c: (sums[c], -grid.index(c)))
    strategy, setting = best if sums[best] > 0 else FALLBACK
    return SequenceModel(strategy, setting, trees, n_penalties).fit(df), [(*c, v) for c, v in sums.items()]


class Ensemble(base.Model):
    """A ridge regression over the base models' scores, its penalty chosen by MCC over folds of participants.

    ``strategy`` says what becomes of the cluster model's abstentions; specimens with a gap are left out.
    ``reference``: a class whose scores are no features. There are at most as many folds as the rarest class has
    participants.
    """

    def __init__(self, n_penalties: int = linear.PENALTIES, folds: int = linear.FOLDS, strategy: str = "ensemble_abstain", reference: str | None = None):
        self.n_penalties, self.folds, self.strategy, self.reference = n_penalties, folds, strategy, reference

    def _named(self, df: DataFrame) -> DataFrame:
        x = df.where(F.col("class") != self.reference) if self.reference is not None else df
        return x.withColumn("feature", F.concat_ws(":", F.col("model").cast("string"), "class"))

    def _vectors(self, df: DataFrame) -> DataFrame:
        own = self._named(df).where(F.col("feature").isin(self.names))
        filled = predictions.meta_features(own, self.strategy, "model2", drop_inactive=False)
        whole = filled.groupBy("specimen_label").agg(F.countDistinct("feature").alias("n")).where(F.col("n") == len(self.names))
        return base.assembled(filled.join(whole, "specimen_label", "left_semi"), self.names, value="score")

    def fit(self, df: DataFrame) -> Ensemble:
        """``df``: ``specimen_label, participant_label, model, class, score, disease``. A model that abstains everywhere is no feature."""
        self.classes = base.classes_of(df)
        self.names = sorted(r[0] for r in self._named(df).where("score IS NOT NULL").select("feature").distinct().collect())
        people = base.people(df)
        self.folds = splits.cross_validation_cap(people, self.folds)
        x = written(base.folded(self._vectors(df).join(people, "specimen_label"), self.folds))
        _, mean, covariance = linear.moments(x, len(self.names))
        self.scaling = linear.Scaling.of(mean, np.diag(covariance))
        z = written(linear.mapped(x, "specimen_label", self.scaling).join(x.drop("features"), "specimen_label"))
        found = linear.fit(z, self.classes, MIXES["ridge"], score=linear.MCC, n=self.n_penalties)
        self.model, self.choice = found.model, found.choice
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.scores(linear.mapped(self._vectors(df), "specimen_label", self.scaling))

    def save(self, spark: SparkSession, folder: str) -> None:
        store.write_json(spark, f"{folder}/model.json", {"names": self.names, "model": self.model.to_json(), "mean": self.scaling.mean.tolist(), "scale": self.scaling.scale.tolist(), "strategy": self.strategy, "reference": self.reference})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Ensemble:
        x = store.read_json(spark, f"{folder}/model.json")
        out = cls(strategy=x["strategy"], reference=x["reference"])
        out.names, out.model, out.scaling = x["names"], linear.Linear.of_json(x["model"]), linear.Scaling(np.array(x["mean"]), np.array(x["scale"]))
        out.classes = out.model.classes
        return out


KINDS = {"model1": RepertoireModel, "model2": ClusterModel, "model3": SequenceModel, "ensemble": Ensemble}


def load_model(spark: SparkSession, root: str, kind: str) -> base.Model:
    """A saved model, from ``root`` or its folder of that kind."""
    return KINDS[kind].load(spark, store.model_folder(spark, root, kind))


@F.arrow_udf(ArrayType(FloatType()))
def _shares(bins: pa.Array, size: pa.Array) -> pa.Array:
    """How often each number below ``size`` is among each row's numbers, as shares of the row."""
    n = size[0].as_py() if len(size) else 0
    length = np.diff(np.asarray(bins.offsets)).astype(np.int64)
    row = np.repeat(np.arange(len(length)), length)
    counts = np.bincount(row * n + bins.flatten().to_numpy(), minlength=len(length) * n).reshape(len(length), n)
    shares = (counts / np.maximum(length, 1)[:, None]).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(length) + 1) * n, pa.int32()), pa.array(shares.ravel()))


def embedded(df: DataFrame, text: str = "cdr3", size: int = 32) -> DataFrame:
    """A stand-in for a protein language model: hashed residues and pairs, deterministic.

    Each residue and pair is hashed once, in the JVM; the hashes are counted in Arrow batches.
    """
    letters = F.split(text, "")
    grams = F.concat(letters, F.zip_with(F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0))), F.slice(letters, 2, F.greatest(F.size(letters) - 1, F.lit(0))), lambda a, b: F.concat(a, b)))
    bins = F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(size)))
    shares = _shares(F.coalesce(bins, F.array().cast("array<bigint>")), F.lit(size))
    return df.withColumn("embedding", F.coalesce(F.when(F.col(text).isNotNull(), shares), F.array_repeat(F.lit(None).cast("float"), size)))
