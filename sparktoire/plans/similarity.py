"""Clusters, centroids, enrichment and specimen scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sparktoire.functions import expressions as X
from sparktoire.operators import clustering, enrichment, metrics
from sparktoire.operators.clustering import BLOCK
from sparktoire.operators.storage import written
from sparktoire.plans.base import WITH, cleaned, downsampled, query, sequences

IDENTITY = 0.9
_CUT = "(CAST(1.0 AS DOUBLE) - CAST(0.9 AS DOUBLE))"
_BLOCK = "v_gene, j_gene, cdr3_len"

_PAIRS = f"""u AS (SELECT DISTINCT {_BLOCK}, cdr3 FROM seqs),
pairs AS (SELECT a.v_gene, a.j_gene, a.cdr3_len, a.cdr3 AS a, b.cdr3 AS b, hamming(a.cdr3, b.cdr3) AS distance FROM u a JOIN u b ON a.v_gene = b.v_gene AND a.j_gene = b.j_gene AND a.cdr3_len = b.cdr3_len AND a.cdr3 < b.cdr3
          WHERE CAST(hamming(a.cdr3, b.cdr3) AS DOUBLE) / a.cdr3_len <= {_CUT})"""
_CLUSTERS = f"""{_PAIRS}, both_ways AS (SELECT {_BLOCK}, a, b FROM pairs UNION ALL SELECT {_BLOCK}, b, a FROM pairs),
reach AS (SELECT {_BLOCK}, cdr3 AS node, cdr3 AS label FROM u UNION SELECT r.v_gene, r.j_gene, r.cdr3_len, e.b, r.label FROM reach r JOIN both_ways e ON e.v_gene = r.v_gene AND e.j_gene = r.j_gene AND e.cdr3_len = r.cdr3_len AND e.a = r.node),
clus AS (SELECT {_BLOCK}, node AS cdr3, min(label) AS cluster FROM reach GROUP BY ALL)"""
_WITH = WITH.replace("WITH rep", "WITH RECURSIVE rep", 1)


@query("j08_similar_pairs", WITH + f", {_PAIRS} SELECT {_BLOCK}, a, b, CAST(distance AS INT) AS distance FROM pairs")
def j08(spark, d):
    return clustering.similar_pairs(_sequences(spark, d), IDENTITY)


@query("c06_convergent_clusters", _WITH + f", {_CLUSTERS} SELECT * FROM clus")
def c06(spark, d):
    return clustering.single_linkage(_sequences(spark, d), IDENTITY).select(*BLOCK, "cdr3", "cluster")


def _sequences(spark, d) -> DataFrame:
    """Written once: pairs, clusters, rows and counts all read them."""
    return written(sequences(spark, d))


def _clustered(spark, d) -> DataFrame:
    x = _sequences(spark, d)
    return written(_joined(x))


def _joined(x: DataFrame) -> DataFrame:
    return x.join(clustering.single_linkage(x, IDENTITY), [*BLOCK, "cdr3"])


_ROWS = f"{_CLUSTERS}, crow AS (SELECT s.*, c.cluster FROM seqs s JOIN clus c USING ({_BLOCK}, cdr3))"


@query("j05_reexpanded", _WITH + f", {_ROWS} SELECT ord, cluster FROM crow")
def j05(spark, d):
    return _clustered(spark, d).select("ord", "cluster")


@query("a09_cluster_participants", _WITH + f", {_ROWS} SELECT {_BLOCK}, cluster, disease, count(DISTINCT participant_label) AS n_participants FROM crow GROUP BY ALL")
def a09(spark, d):
    return enrichment.cluster_participants(_clustered(spark, d), [*BLOCK, "cluster"])


_CONSENSUS = f"""lets AS (SELECT {_BLOCK}, cluster, weight, ord, unnest(string_split(cdr3, '')) AS ch, unnest(range(length(cdr3))) AS pos FROM crow),
wts AS (SELECT {_BLOCK}, cluster, pos, ch, sum(weight) AS w, min(ord) AS o FROM lets GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_BLOCK}, cluster, pos ORDER BY w DESC, o, ch) AS r FROM wts) WHERE r = 1),
cent AS (SELECT {_BLOCK}, cluster, string_agg(ch, '' ORDER BY pos) AS centroid FROM top GROUP BY ALL)"""


@query("a10_consensus", _WITH + f", {_ROWS}, {_CONSENSUS} SELECT * FROM cent")
def a10(spark, d):
    return enrichment.centroids(_clustered(spark, d))


@query("a12_size_ranks", _WITH + f", {_ROWS}, named AS (SELECT disease, v_gene || '|' || cluster AS cluster FROM crow) SELECT disease, cluster, count(*) AS n_members, 'Clone_' || row_number() OVER (PARTITION BY disease ORDER BY count(*) DESC, cluster) AS clone_id FROM named GROUP BY disease, cluster")
def a12(spark, d):
    x = _clustered(spark, d).withColumn("cluster", F.concat_ws("|", "v_gene", "cluster"))
    return clustering.ranked_by_size(x, "cluster", ("disease",))


_CLONES = f"""cu AS (SELECT DISTINCT participant_label, {_BLOCK}, cdr3_aa AS cdr3 FROM clean),
cp AS (SELECT a.participant_label AS p, a.v_gene, a.j_gene, a.cdr3 AS a, b.cdr3 AS b FROM cu a JOIN cu b ON a.participant_label = b.participant_label AND a.v_gene = b.v_gene AND a.j_gene = b.j_gene AND a.cdr3_len = b.cdr3_len AND a.cdr3 <> b.cdr3 WHERE CAST(hamming(a.cdr3, b.cdr3) AS DOUBLE) / a.cdr3_len <= {_CUT}),
cr AS (SELECT participant_label AS p, v_gene, j_gene, cdr3_len, cdr3 AS node, cdr3 AS label FROM cu UNION SELECT r.p, r.v_gene, r.j_gene, r.cdr3_len, e.b, r.label FROM cr r JOIN cp e ON e.p = r.p AND e.v_gene = r.v_gene AND e.j_gene = r.j_gene AND e.a = r.node),
cc AS (SELECT p AS participant_label, {_BLOCK}, node AS cdr3_aa, concat_ws('|', v_gene, j_gene, cdr3_len, min(label)) AS cluster FROM cr GROUP BY p, {_BLOCK}, node),
ci AS (SELECT participant_label, cluster, 'Clone_' || row_number() OVER (PARTITION BY participant_label ORDER BY count(*) DESC, cluster) AS id FROM clean JOIN cc USING (participant_label, {_BLOCK}, cdr3_aa) GROUP BY participant_label, cluster),
clo AS (SELECT c.participant_label, c.ord, ci.id AS clone_id FROM clean c JOIN cc USING (participant_label, {_BLOCK}, cdr3_aa) JOIN ci USING (participant_label, cluster))"""


def _with_clones(spark, d) -> DataFrame:
    x = written(cleaned(spark, d).select("participant_label", "ord", "v_gene", "j_gene", F.col("cdr3_aa").alias("cdr3"), "replicate_label"))
    return clustering.clones(x, IDENTITY)


@query("c01_clones", _WITH + f", {_CLONES} SELECT * FROM clo")
def c01(spark, d):
    return _with_clones(spark, d).select("participant_label", "ord", "clone_id")


@query("c02_paired_clones", _WITH + f", {_CLONES}, pr AS (SELECT participant_label, ord, CASE WHEN substr(ord, 1, 1) = '9' THEN 'Unknown' ELSE clone_id || '|' || 'Clone_' || (length(ord) % 3) END AS pair FROM clo), pi AS (SELECT participant_label, pair, 'Clone_' || row_number() OVER (PARTITION BY participant_label ORDER BY count(*) DESC, pair) AS id FROM pr WHERE pair <> 'Unknown' GROUP BY participant_label, pair) SELECT pr.participant_label, pr.ord, coalesce(pi.id, 'Unknown') AS paired_clone_id FROM pr LEFT JOIN pi USING (participant_label, pair)")
def c02(spark, d):
    light = F.when(F.col("ord").startswith("9"), "Unknown").otherwise(F.concat(F.lit("Clone_"), F.length("ord") % 3))
    return clustering.paired_clones(_with_clones(spark, d).withColumn("light_id", light), "clone_id", "light_id").select("participant_label", "ord", "paired_clone_id")


@query("c03_identity_thresholds", WITH + """, p AS (SELECT participant_label, CASE WHEN CV_fold = 2 THEN 'BCR' ELSE 'TCR' END AS locus, max(cdr3_len) AS longest FROM seqs GROUP BY ALL),
t(locus, nucleotides, identity) AS (VALUES ('TCR', true, 0.95::DOUBLE), ('BCR', true, 0.90::DOUBLE), ('TCR', false, 0.90::DOUBLE), ('BCR', false, 0.85::DOUBLE))
SELECT participant_label, locus, nucleotides, identity, longest, CAST(list_max(list_filter(range(0, longest + 1), lambda m: m / longest <= CAST(1 AS DOUBLE) - identity)) AS INT) AS mismatches FROM p JOIN t USING (locus)""")
def c03(spark, d):
    """For each participant the identity of its locus, by what is compared, and how many letters of its longest CDR3 may differ."""
    people = sequences(spark, d).groupBy("participant_label", F.when(F.col("CV_fold") == 2, "BCR").otherwise("TCR").alias("locus")).agg(F.max("cdr3_len").alias("longest"))
    out = None
    for locus in ("TCR", "BCR"):
        for nucleotides in (True, False):
            identity = X.identity_threshold(locus, nucleotides)
            part = people.where(F.col("locus") == locus).select("participant_label", "locus", F.lit(nucleotides).alias("nucleotides"), F.lit(identity).alias("identity"), "longest", X.most_mismatches(F.col("longest"), identity).alias("mismatches"))
            out = part if out is None else out.unionByName(part)
    return out


@query("c01_complete_linkage")
def c01_complete(spark, d):
    """Clusters of all participants' sequences by complete linkage."""
    return clustering.hierarchical(written(sequences(spark, d)), IDENTITY, "complete")


@query("c01_average_linkage")
def c01_average(spark, d):
    return clustering.hierarchical(written(sequences(spark, d)), IDENTITY, "average")


@query("c05_nucleotide_clones", WITH + ", nt AS (SELECT participant_label, ord, v_gene, j_gene, upper(substr(translate(sequence, '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 15)) AS s FROM clean), u AS (SELECT DISTINCT participant_label, v_gene, j_gene, s FROM nt), id AS (SELECT participant_label, v_gene, j_gene, s, row_number() OVER (PARTITION BY participant_label ORDER BY (SELECT count(*) FROM nt n WHERE n.participant_label = u.participant_label AND n.v_gene = u.v_gene AND n.j_gene = u.j_gene AND n.s = u.s) DESC, concat_ws('|', v_gene, j_gene, 15, s)) AS r FROM u) SELECT nt.participant_label, nt.ord, 'Clone_' || r AS clone_id FROM nt JOIN id USING (participant_label, v_gene, j_gene, s)")
def c05(spark, d):
    """Clones of all participants in one job, on nucleotides at the identity for them; of 15 letters, no mismatch is allowed."""
    letters = F.substr(F.translate("sequence", "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(1), F.lit(15))
    x = written(cleaned(spark, d).select("participant_label", "ord", "v_gene", "j_gene", "clone_id", letters.alias("cdr3")))
    return clustering.assigned_clones(x, "TCR", force=True).select("participant_label", "ord", "clone_id")


@query("c04_participant_clones", _WITH + f", {_CLONES} SELECT participant_label, count(*) AS n_rows, count(DISTINCT clone_id) AS n_clones FROM clo GROUP BY 1")
def c04(spark, d):
    return _with_clones(spark, d).groupBy("participant_label").agg(F.count("*").alias("n_rows"), F.countDistinct("clone_id").alias("n_clones"))


_FISHER = f"""cnt AS (SELECT {_BLOCK}, cluster, disease, count(DISTINCT participant_label) AS a FROM crow GROUP BY ALL), siz AS (SELECT {_BLOCK}, cluster, sum(a) AS n FROM cnt GROUP BY ALL),
cls AS (SELECT disease, count(DISTINCT participant_label) AS k FROM crow GROUP BY 1), tot AS (SELECT sum(k) AS m FROM cls),
cells AS (SELECT {_BLOCK}, cluster, disease, a FROM cnt UNION ALL SELECT {_BLOCK}, cluster, cls.disease, 0 FROM siz CROSS JOIN cls),
fg AS (SELECT {_BLOCK}, cluster, c.disease, siz.n, cls.k, tot.m, c.a FROM (SELECT {_BLOCK}, cluster, disease, max(a) AS a FROM cells GROUP BY ALL) c JOIN siz USING ({_BLOCK}, cluster) JOIN cls ON cls.disease = c.disease CROSS JOIN tot),
fish AS (SELECT {_BLOCK}, cluster, disease, a AS n_participants, CAST(n AS BIGINT) AS in_cluster, k AS in_class, CASE WHEN a = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(a, CAST(least(n, k) AS BIGINT) + 1), lambda x:
  CASE WHEN n - x <= m - k THEN exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(m - k + 1) - lgamma(n - x + 1) - lgamma(m - k - n + x + 1) - lgamma(m + 1) + lgamma(n + 1) + lgamma(m - n + 1)) ELSE 0 END))) END AS p_value FROM fg)"""


def _fisher(spark, d) -> DataFrame:
    return enrichment.fisher_scores(_clustered(spark, d), [*BLOCK, "cluster"])


@query("c07_fisher", _WITH + f", {_ROWS}, {_FISHER} SELECT * REPLACE (round(p_value, 6) AS p_value) FROM fish")
def c07(spark, d):
    return _fisher(spark, d).withColumn("p_value", F.round("p_value", 6))


@query("c08_significant", _WITH + f", {_ROWS}, {_FISHER} SELECT {_BLOCK}, cluster, round(min(p_value), 6) AS least_p FROM fish GROUP BY ALL HAVING min(p_value) <= 0.05")
def c08(spark, d):
    return enrichment.significant(_fisher(spark, d), [*BLOCK, "cluster"], 0.05).withColumn("least_p", F.round("least_p", 6))


@query("c09_centroid_table", _WITH + f", {_ROWS}, {_CONSENSUS}, {_FISHER} SELECT {_BLOCK}, cluster, centroid, disease, round(p_value, 6) AS p_value FROM cent JOIN fish USING ({_BLOCK}, cluster)")
def c09(spark, d):
    x = _clustered(spark, d)
    keys = [*BLOCK, "cluster"]
    p = enrichment.fisher_scores(x, keys).select(*keys, "disease", F.round("p_value", 6).alias("p_value"))
    return enrichment.centroids(x).join(p, keys)


@query("j04_one_to_one", _WITH + f", {_ROWS}, {_CONSENSUS} SELECT count(*) AS n, count(DISTINCT ({_BLOCK}, cluster)) AS n_keys FROM cent")
def j04(spark, d):
    return enrichment.centroids(_clustered(spark, d)).agg(F.count("*").alias("n"), F.countDistinct(*BLOCK, "cluster").alias("n_keys"))


_KNOWN = f"kn AS (SELECT {_BLOCK}, cdr3 AS centroid, cdr3 AS cluster, row_number() OVER (PARTITION BY {_BLOCK} ORDER BY cdr3) AS rank FROM (SELECT DISTINCT {_BLOCK}, cdr3 FROM seqs WHERE CV_fold <> 0)), q AS (SELECT DISTINCT {_BLOCK}, cdr3 FROM seqs WHERE CV_fold = 0)"
_NEAR = f"{_KNOWN}, nr AS (SELECT q.v_gene, q.j_gene, q.cdr3_len, q.cdr3, k.cluster, hamming(q.cdr3, k.centroid) AS distance, row_number() OVER (PARTITION BY q.v_gene, q.j_gene, q.cdr3_len, q.cdr3 ORDER BY hamming(q.cdr3, k.centroid), k.rank) AS r FROM q JOIN kn k ON k.v_gene = q.v_gene AND k.j_gene = q.j_gene AND k.cdr3_len = q.cdr3_len WHERE CAST(hamming(q.cdr3, k.centroid) AS DOUBLE) / q.cdr3_len <= {_CUT}), near AS (SELECT q.*, nr.cluster, CAST(nr.distance AS INT) AS distance FROM q LEFT JOIN nr ON nr.r = 1 AND nr.v_gene = q.v_gene AND nr.j_gene = q.j_gene AND nr.cdr3_len = q.cdr3_len AND nr.cdr3 = q.cdr3)"


def _known(x: DataFrame) -> DataFrame:
    seen = x.where("CV_fold <> 0").select(*BLOCK, F.col("cdr3").alias("centroid")).distinct()
    return seen.select("*", F.col("centroid").alias("cluster"), F.row_number().over(Window.partitionBy(*BLOCK).orderBy("centroid")).alias("rank"))


@query("j07_nearest_centroid", WITH + f", {_NEAR} SELECT * FROM near")
def j07(spark, d):
    x = _sequences(spark, d)
    return clustering.nearest_centroids(x.where("CV_fold = 0"), _known(x), IDENTITY)


_HITS = f"{_NEAR}, dis AS (SELECT {_BLOCK}, cdr3 AS cluster, min(disease) AS disease FROM seqs WHERE CV_fold <> 0 GROUP BY ALL), hit AS (SELECT s.specimen_label, s.v_gene, s.j_gene, s.cdr3_len, n.cluster, s.ord FROM seqs s JOIN near n USING ({_BLOCK}, cdr3) WHERE s.CV_fold = 0 AND n.cluster IS NOT NULL)"


def _hits(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    hits = enrichment.assigned(x.where("CV_fold = 0"), _known(x), IDENTITY).where("cluster IS NOT NULL")
    disease = x.where("CV_fold <> 0").groupBy(*BLOCK, F.col("cdr3").alias("cluster")).agg(F.min("disease").alias("disease"))
    return hits, disease


@query("j06_hit_diseases", WITH + f", {_HITS} SELECT ord, cluster, disease FROM hit JOIN dis USING ({_BLOCK}, cluster)")
def j06(spark, d):
    hits, disease = _hits(_sequences(spark, d))
    return hits.drop("disease").join(disease, [*BLOCK, "cluster"]).select("ord", "cluster", "disease")


@query("a11_distinct_clusters", WITH + f", {_HITS} SELECT specimen_label, disease, count(DISTINCT ({_BLOCK}, cluster)) AS score FROM hit JOIN dis USING ({_BLOCK}, cluster) GROUP BY ALL")
def a11(spark, d):
    hits, disease = _hits(_sequences(spark, d))
    x = hits.drop("disease").join(disease, [*BLOCK, "cluster"])
    return x.groupBy("specimen_label", "disease").agg(F.countDistinct(*BLOCK, "cluster").alias("score"))


@query("c10_specimen_scores", WITH + f", {_HITS}, sc AS (SELECT specimen_label, disease, count(DISTINCT ({_BLOCK}, cluster)) AS score FROM hit JOIN dis USING ({_BLOCK}, cluster) GROUP BY ALL) SELECT s.specimen_label, c.disease, coalesce(sc.score, 0) AS score, s.specimen_label NOT IN (SELECT specimen_label FROM sc) AS abstained FROM (SELECT DISTINCT specimen_label FROM seqs WHERE CV_fold = 0) s CROSS JOIN (SELECT DISTINCT disease FROM dis) c LEFT JOIN sc ON sc.specimen_label = s.specimen_label AND sc.disease = c.disease")
def c10(spark, d):
    x = _sequences(spark, d)
    hits, disease = _hits(x)
    return enrichment.specimen_scores(hits.drop("disease"), disease, x.where("CV_fold = 0"))


@query("j02_group_statistics", WITH + "SELECT ord, num_clone_members, total_clone_num_reads FROM down")
def j02(spark, d):
    return downsampled(spark, d).select("ord", "num_clone_members", "total_clone_num_reads")


@query("c11_abstain_label", WITH + f", {_HITS}, sc AS (SELECT specimen_label, disease, count(DISTINCT ({_BLOCK}, cluster)) AS score FROM hit JOIN dis USING ({_BLOCK}, cluster) GROUP BY ALL), best AS (SELECT specimen_label, arg_max(disease, score * 1000 - ascii(disease)) AS label FROM sc GROUP BY 1) SELECT s.specimen_label, coalesce(best.label, 'UNKNOWN99') AS label FROM (SELECT DISTINCT specimen_label FROM seqs WHERE CV_fold = 0) s LEFT JOIN best USING (specimen_label)")
def c11(spark, d):
    """The class of the most predictive clusters of each specimen; those that hit none get a class that nobody has."""
    x = _sequences(spark, d)
    hits, disease = _hits(x)
    scores = enrichment.specimen_scores(hits.drop("disease"), disease, x.where("CV_fold = 0"))
    best = scores.groupBy("specimen_label").agg(F.max_by("disease", F.col("score") * 1000 - F.ascii("disease")).alias("best"), F.bool_or("abstained").alias("abstained"))
    return best.select("specimen_label", F.when(F.col("abstained"), metrics.ABSTAINED).otherwise(F.col("best")).alias("label"))
