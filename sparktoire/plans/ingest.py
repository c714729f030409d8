"""Scans, cleaning, downsampling, joins, set operations and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparktoire.functions import expressions as X
from sparktoire.operators import cleaning, predictions, selection, splits
from sparktoire.operators.storage import shared_folder, write_text, written
from sparktoire.plans.base import WITH, cleaned, downsampled, metadata, query, repertoire, sequences, table
from sparktoire.sources import repertoires

# ---- projections and predicates ---------------------------------------------------------------


@query("p01_rename_fold_column", WITH + "SELECT participant_label, repertoire_id AS specimen_label, CV_fold AS fold_id, count(*) AS n FROM rep GROUP BY ALL")
def p01(spark, d):
    return repertoire(spark, d).withColumnsRenamed({"repertoire_id": "specimen_label", "CV_fold": "fold_id"}).groupBy("participant_label", "specimen_label", "fold_id").agg(F.count("*").alias("n"))


@query("p02_identifiers_as_text", WITH + "SELECT DISTINCT CAST(CV_fold AS VARCHAR) AS fold_text, CAST(clone_id AS VARCHAR) AS clone_text FROM rep")
def p02(spark, d):
    return repertoire(spark, d).select(F.col("CV_fold").cast("string").alias("fold_text"), F.col("clone_id").cast("string").alias("clone_text")).distinct()


@query("p03_airr_boolean", WITH + "SELECT upper(productive) AS productive, count(*) AS n FROM rep GROUP BY 1")
def p03(spark, d):
    return repertoire(spark, d).groupBy(X.airr_boolean(F.col("productive")).alias("productive")).agg(F.count("*").alias("n"))


@query("p04_productive_only", WITH + "SELECT disease, count(*) AS n FROM rep WHERE upper(productive) = 'T' GROUP BY 1")
def p04(spark, d):
    return cleaning.productive_only(repertoire(spark, d)).groupBy("disease").agg(F.count("*").alias("n"))


@query("p05_v_score_above", WITH + "SELECT ord, v_score FROM rep WHERE v_score > 80")
def p05(spark, d):
    return cleaning.v_score_above(repertoire(spark, d)).select("ord", "v_score")


@query("p06_clean_texts", WITH + "SELECT nullif(nullif(upper(replace(cdr3_aa, ' ', '')), ''), 'NAN') AS cdr3_aa, count(*) AS n, count(*) FILTER (WHERE cdr3_aa <> upper(replace(cdr3_aa, ' ', ''))) AS n_changed FROM rep GROUP BY 1")
def p06(spark, d):
    clean = X.clean_sequence(F.col("cdr3_aa"))
    return repertoire(spark, d).select(clean.alias("cdr3_aa"), (F.col("cdr3_aa") != clean).alias("changed")).groupBy("cdr3_aa").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"))


@query("p07_other_residues", WITH + ", c AS (SELECT nullif(upper(replace(cdr3_aa, ' ', '')), '') AS s FROM rep) SELECT residue, count(*) AS n_rows FROM (SELECT unnest(list_distinct(string_split(regexp_replace(s, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g'), ''))) AS residue FROM c) WHERE residue <> '' GROUP BY 1")
def p07(spark, d):
    return cleaning.other_residue_counts(cleaning.clean_texts(repertoire(spark, d)))


@query("p08_exact_allele_fix", WITH + "SELECT CASE WHEN v_call = 'TRBV6-2*02' THEN 'TRBV6-2*01' ELSE v_call END AS v_call, count(*) AS n FROM rep GROUP BY 1")
def p08(spark, d):
    return repertoire(spark, d).groupBy(X.fix_allele(F.col("v_call")).alias("v_call")).agg(F.count("*").alias("n"))


@query("p09_prefix_gene_fix", WITH + ", f AS (SELECT v_call AS was, CASE WHEN v_call = 'TRBV6-2*02' THEN 'TRBV6-2*01' WHEN v_call LIKE 'TRBV12-4*%' THEN 'TRBV12-3*01' WHEN v_call LIKE 'TRBV6-3*%' THEN 'TRBV6-2*01' ELSE v_call END AS fixed FROM rep) SELECT was, fixed, count(*) AS n_rows FROM f WHERE was <> fixed GROUP BY ALL")
def p09(spark, d):
    return cleaning.gene_fix_counts(repertoire(spark, d))


@query("p10_gene_blocklist", WITH + "SELECT v_call, count(*) AS n FROM fixed WHERE v_call <> 'TRBV25/OR9-2*01' GROUP BY 1")
def p10(spark, d):
    x = cleaning.collapse_duplicates(cleaning.standard_residues(cleaning.clean_texts(cleaning.v_score_above(cleaning.productive_only(repertoire(spark, d))))))
    return cleaning.fix_genes(x).groupBy("v_call").agg(F.count("*").alias("n"))


@query("p11_reference_values", "SELECT p_partkey, nullif(upper(translate(p_name || '.-', '.- *', '')), '') AS fwr1_aa FROM part")
def p11(spark, d):
    return table(spark, d, "part").select("p_partkey", X.clean_reference(F.concat("p_name", F.lit(".-"))).alias("fwr1_aa"))


@query("p12_genes_without_alleles", WITH + "SELECT split_part(v_call, '*', 1) AS v_gene, split_part(j_call, '*', 1) AS j_gene, count(*) AS n FROM rep GROUP BY ALL")
def p12(spark, d):
    return cleaning.split_alleles(repertoire(spark, d)).groupBy("v_gene", "j_gene").agg(F.count("*").alias("n"))


@query("p13_required_columns", WITH + "SELECT count(*) AS n, count(*) FILTER (WHERE cdr3_aa IS NULL OR cdr3_aa = '') AS n_without FROM rep")
def p13(spark, d):
    x = repertoire(spark, d)
    kept = cleaning.required_only(cleaning.split_alleles(x)).agg(F.count("*").alias("kept"))
    return x.agg(F.count("*").alias("n")).crossJoin(kept).select("n", (F.col("n") - F.col("kept")).alias("n_without"))


@query("p14_derived_columns", WITH + "SELECT isotype_supergroup, cdr3_len AS cdr3_aa_sequence_trim_len, clone_id AS igh_or_tcrb_clone_id, count(*) AS n FROM clean GROUP BY ALL")
def p14(spark, d):
    return cleaned(spark, d).groupBy("isotype_supergroup", "cdr3_aa_sequence_trim_len", "igh_or_tcrb_clone_id").agg(F.count("*").alias("n"))


@query("p15_cdr3_length", WITH + "SELECT cdr3_len AS length, count(*) AS n FROM clean WHERE cdr3_len >= 12 GROUP BY 1")
def p15(spark, d):
    return cleaning.long_enough(cleaned(spark, d), 12).groupBy(F.col("cdr3_aa_sequence_trim_len").alias("length")).agg(F.count("*").alias("n"))


@query("p16_isotype", WITH + "SELECT count(*) AS n FROM clean WHERE isotype_supergroup = 'TCRB'")
def p16(spark, d):
    return cleaning.isotype_only(cleaned(spark, d)).agg(F.count("*").alias("n"))


@query("p17_nucleotides", "SELECT x AS cdr3, count(*) AS n FROM (SELECT upper(replace(translate(substr(md5(p_name), 1, CAST(6 + p_partkey % 5 AS INT)), '0123456789abcdef', 'ACGTACGTacgt-ACG'), '-', '')) || CASE WHEN p_partkey % 9 = 0 THEN 'N' ELSE '' END AS x FROM part) WHERE regexp_full_match(x, '[ACGT]+') GROUP BY 1")
def p17(spark, d):
    raw = F.concat(F.translate(F.substr(F.md5("p_name"), F.lit(1), (6 + F.col("p_partkey") % 5).cast("int")), "0123456789abcdef", "ACGTACGTacgt-ACG"), F.when(F.col("p_partkey") % 9 == 0, "N").otherwise(""))
    return table(spark, d, "part").select(X.clean_nucleotides(raw).alias("cdr3")).where("cdr3 IS NOT NULL").groupBy("cdr3").agg(F.count("*").alias("n"))


@query("p18_locus", "SELECT c_custkey FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'GeneLocus.BCR' ELSE 'GeneLocus.BCR|TCR' END AS available_gene_loci FROM customer) WHERE coalesce(regexp_matches(available_gene_loci, 'TCR'), false)")
def p18(spark, d):
    loci = F.when(F.col("c_custkey") % 4 == 0, None).when(F.col("c_custkey") % 4 == 1, "GeneLocus.BCR").otherwise("GeneLocus.BCR|TCR")
    return cleaning.locus_only(table(spark, d, "customer").select("c_custkey", loci.alias("available_gene_loci")), "TCR").select("c_custkey")


@query("p20_sanitized_keys", "SELECT replace(event_type || '_' || CAST(user_id % 7 AS VARCHAR), '_', '-') AS key, count(*) AS n FROM events GROUP BY 1")
def p20(spark, d):
    key = X.sanitized(F.concat("event_type", F.lit("_"), (F.col("user_id") % 7).cast("string")))
    return table(spark, d, "events").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("p21_vj_keys", WITH + "SELECT v_gene || '|' || j_gene || ':TCRB' AS feature, count(*) AS n FROM clean GROUP BY 1")
def p21(spark, d):
    return cleaned(spark, d).groupBy(X.vj_key(F.col("v_gene"), F.col("j_gene"), F.col("isotype_supergroup")).alias("feature")).agg(F.count("*").alias("n"))


@query("p22_feature_names", WITH + "SELECT disease AS class, replace(v_gene, '_', '-') AS \"group\", disease || '_' || replace(v_gene, '_', '-') AS feature FROM (SELECT DISTINCT disease, v_gene FROM clean)")
def p22(spark, d):
    x = cleaned(spark, d).select("disease", "v_gene").distinct().select(F.col("disease").alias("class"), X.sanitized(F.col("v_gene")).alias("group"))
    return x.withColumn("feature", F.concat_ws("_", "class", "group"))


@query("p23_binary_pair", WITH + "SELECT * FROM meta WHERE participant_label IN (SELECT participant_label FROM meta WHERE disease IN ('BUILDING', 'MACHINERY'))")
def p23(spark, d):
    return predictions.binary_pair(metadata(spark, d), "BUILDING", "MACHINERY")


@query("p24_test_folds", WITH + "SELECT * FROM meta WHERE CV_fold IN (0, 2)")
def p24(spark, d):
    return predictions.only_folds(metadata(spark, d), [0, 2])


@query("p25_class_alignment", WITH + ", t AS (SELECT DISTINCT disease FROM meta WHERE disease <> 'BUILDING'), m AS (SELECT DISTINCT disease FROM meta WHERE disease <> 'MACHINERY') SELECT coalesce(t.disease, m.disease) AS disease, CASE WHEN t.disease IS NULL THEN 'missing' WHEN m.disease IS NULL THEN 'extra' ELSE 'shared' END AS status FROM t FULL JOIN m ON t.disease = m.disease")
def p25(spark, d):
    x = metadata(spark, d)
    return predictions.class_differences(x.where("disease <> 'BUILDING'"), x.where("disease <> 'MACHINERY'"))


@query("p26_kept_genes", WITH + ", k AS (SELECT v_gene FROM clean GROUP BY 1 HAVING count(*) > 100) SELECT specimen_label, v_gene, count(*) AS n FROM down WHERE v_gene IN (SELECT v_gene FROM k) GROUP BY ALL")
def p26(spark, d):
    kept = cleaned(spark, d).groupBy("v_gene").count().where("count > 100")
    return downsampled(spark, d).join(kept, "v_gene", "left_semi").groupBy("specimen_label", "v_gene").agg(F.count("*").alias("n"))


@query("p27_hamming_identity", WITH + "SELECT DISTINCT participant_label, cdr3, round(1 - hamming(cdr3, least) / cdr3_len, 9) AS identity FROM (SELECT *, min(cdr3) OVER (PARTITION BY participant_label, cdr3_len) AS least FROM seqs)")
def p27(spark, d):
    """Of each sequence with the first one of its participant and length."""
    x = sequences(spark, d).select("participant_label", "cdr3_len", "cdr3").distinct()
    least = x.groupBy("participant_label", "cdr3_len").agg(F.min("cdr3").alias("least"))
    return x.join(least, ["participant_label", "cdr3_len"]).select("participant_label", "cdr3", F.round(X.hamming_identity(F.col("cdr3"), F.col("least")), 9).alias("identity"))


@query("p28_ordinals", "SELECT p_partkey, i - 1 AS position, ascii(substr(p_brand, CAST(i AS INT), 1)) AS code FROM (SELECT p_partkey, p_brand, unnest(range(1, length(p_brand) + 1)) AS i FROM part)")
def p28(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_brand", "")).alias("position", "ch"))
    return x.select("p_partkey", F.col("position").cast("long").alias("position"), F.ascii("ch").alias("code"))


@query("p32_pair_names", WITH + "SELECT DISTINCT regexp_replace(a.disease || '_vs_' || b.disease, '[^A-Za-z0-9_.-]+', '_', 'g') AS name FROM meta a, meta b WHERE a.CV_fold = 0 AND b.CV_fold = 0 AND a.disease < b.disease")
def p32(spark, d):
    x = metadata(spark, d).select("disease").distinct()
    pairs = x.join(x.withColumnRenamed("disease", "reference"), F.col("disease") < F.col("reference"))
    return pairs.select(X.pair_name(F.col("disease"), F.col("reference")).alias("name"))


# ---- scans ------------------------------------------------------------------------------------


@query("s01_metadata", WITH + "SELECT * FROM meta")
def s01(spark, d):
    return metadata(spark, d)


@query("s02_participant_raw", WITH + "SELECT ord, repertoire_id, v_call, j_call, cdr3_aa FROM rep WHERE participant_label = 'P7'")
def s02(spark, d):
    """Read from the participants' own files."""
    columns = ["repertoire_id", "v_call", "j_call", "cdr3_aa", "clone_id"]
    x = repertoire(spark, d).select("participant_label", *columns[:-1], F.col("ord").alias("clone_id"))
    folder = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    for name in ("P7", "P8"):
        text = "\n".join("\t".join("" if v is None else v for v in r) for r in [columns, *x.where(F.col("participant_label") == name).select(*columns).collect()])
        write_text(spark, f"{folder}/part_table_{name}.tsv", text + "\n")
    return repertoires.read_sequences(spark, folder, participants=["P7"]).where("participant_label = 'P7'").select(F.col("clone_id").alias("ord"), *columns[:-1])


@query("s03_stages", WITH + "SELECT 'raw' AS stage, count(*) AS n FROM rep UNION ALL SELECT 'clean', count(*) FROM clean UNION ALL SELECT 'downsampled', count(*) FROM down")
def s03(spark, d):
    """Every stage is made once, of the one before it, and counted where it was written."""
    raw = written(repertoire(spark, d))
    clean = written(cleaning.isotype_only(cleaning.long_enough(cleaning.clean(raw))))
    parts = [x.agg(F.count("*").alias("n")).select(F.lit(s).alias("stage"), "n") for s, x in (("raw", raw), ("clean", clean), ("downsampled", cleaning.downsample(clean)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s04_specimen", WITH + "SELECT specimen_label, v_gene, j_gene, cdr3_aa, num_reads FROM down WHERE specimen_label = 'S7-A'")
def s04(spark, d):
    return downsampled(spark, d).where("specimen_label = 'S7-A'").select("specimen_label", "v_gene", "j_gene", "cdr3_aa", "num_reads")


@query("s05_fold_train", WITH + "SELECT participant_label, count(*) AS n FROM down WHERE participant_label IN (SELECT participant_label FROM meta WHERE CV_fold <> 1) GROUP BY 1")
def s05(spark, d):
    people = metadata(spark, d).where("CV_fold <> 1").select("participant_label").distinct()
    return downsampled(spark, d).join(people, "participant_label", "left_semi").groupBy("participant_label").agg(F.count("*").alias("n"))


@query("s06_all_data", WITH + "SELECT specimen_label, count(*) AS n, CAST(sum(total_clone_num_reads) AS BIGINT) AS reads FROM down GROUP BY 1")
def s06(spark, d):
    return downsampled(spark, d).groupBy("specimen_label").agg(F.count("*").alias("n"), F.sum("total_clone_num_reads").alias("reads"))


@query("s10_split_check", WITH + ", s AS (SELECT DISTINCT participant_label FROM meta WHERE CV_fold < 2) SELECT DISTINCT participant_label, 'missing' AS status FROM meta WHERE participant_label NOT IN (SELECT participant_label FROM s)")
def s10(spark, d):
    """Splits that lack a fold's participants are found out and made again."""
    x, path = metadata(spark, d), f"{shared_folder(spark)}/splits/{uuid.uuid4().hex}"
    old, _ = repertoires.checked_splits(spark, path, x.where("CV_fold < 2"), fold=0)
    old = written(old)
    new, made = repertoires.checked_splits(spark, path, x, fold=0)
    if not made or repertoires.checked_splits(spark, path, x, fold=0)[1]:
        raise AssertionError("splits are made again exactly if they don't fit")
    return repertoires.completeness(new, old).select("participant_label", F.lit("missing").alias("status"))


@query("s11_gene_reference", "SELECT DISTINCT p_brand AS v_call, nullif(upper(p_brand), '') AS fwr1_aa FROM part")
def s11(spark, d):
    brand = table(spark, d, "part").select(F.col("p_brand").alias("v_call"), *(F.col("p_brand").alias(c) for c in ("fwr1_aa", "cdr1_aa", "fwr2_aa", "cdr2_aa", "fwr3_aa"))).distinct()
    path = f"{shared_folder(spark)}/references/{uuid.uuid4().hex}"
    brand.write.option("sep", "\t").option("header", True).csv(path)
    return repertoires.read_gene_reference(spark, path).select("v_call", X.clean_reference(F.col("fwr1_aa")).alias("fwr1_aa"))


@query("s12_embedding_checks", "SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64) AS n_sized, count(*) FILTER (WHERE len(list_filter(embedding, lambda x: isnan(x))) = 0) AS n_finite FROM embeddings")
def s12(spark, d):
    repertoires.check_embeddings(table(spark, d, "embeddings"), 64)
    finite = F.forall("embedding", lambda x: ~F.isnan(x))
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") == 64).alias("n_sized"), F.count_if(finite).alias("n_finite"))


@query("s13_embedding_completeness", "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings)")
def s13(spark, d):
    return repertoires.completeness(table(spark, d, "documents"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("s17_subset", WITH + "SELECT ord, participant_label FROM rep WHERE participant_label IN (SELECT participant_label FROM meta WHERE CV_fold = 0 AND disease = 'BUILDING')")
def s17(spark, d):
    people = metadata(spark, d).where("CV_fold = 0 AND disease = 'BUILDING'").select("participant_label").distinct()
    kept = repertoires.write_subset(repertoire(spark, d).select("ord", "participant_label"), people, f"{shared_folder(spark)}/subsets/{uuid.uuid4().hex}")
    return kept.select("ord", "participant_label")


@query("s18_merged_sources", WITH + "SELECT specimen_label, participant_label, disease, 'a' AS origin, NULL::INT AS CV_fold FROM meta WHERE CV_fold = 0 UNION ALL SELECT specimen_label, participant_label, disease, 'b', CV_fold FROM meta WHERE CV_fold = 1")
def s18(spark, d):
    x = metadata(spark, d)
    return repertoires.merged({"a": x.where("CV_fold = 0").drop("CV_fold"), "b": x.where("CV_fold = 1")})


@query("s18_merged_caches", WITH + """, m AS (SELECT participant_label, CASE WHEN CV_fold = 0 THEN 'a' ELSE 'b' END AS origin FROM meta WHERE CV_fold < 2 GROUP BY ALL),
r AS (SELECT participant_label, CASE WHEN CV_fold = 0 THEN 'a' ELSE 'b' END AS origin, count(*) AS n_rows FROM rep GROUP BY ALL)
SELECT participant_label, origin, n_rows, CASE WHEN m.origin IS NULL THEN 'unused' ELSE 'merged' END AS status FROM r LEFT JOIN m USING (participant_label, origin)""")
def s18_caches(spark, d):
    """Two datasets merged by a manifest, which leaves a fold unused: the report, with the rows that are in the merged cache."""
    x = repertoire(spark, d).select("ord", "participant_label", "CV_fold")
    manifest = x.where("CV_fold < 2").select("participant_label", F.when(F.col("CV_fold") == 0, "a").otherwise("b").alias("origin")).distinct()
    cache, report = repertoires.merge_caches(spark, {"a": x.where("CV_fold = 0"), "b": x.where("CV_fold <> 0")}, manifest, f"{shared_folder(spark)}/caches/{uuid.uuid4().hex}")
    counted = cache.groupBy("participant_label").agg(F.count(F.lit(1)).alias("n_cached"))
    return report.join(counted, "participant_label", "left").select("participant_label", "origin", F.when(F.col("status") == "merged", F.coalesce("n_cached", F.lit(0))).otherwise(F.col("n_rows")).alias("n_rows"), "status")


# ---- joins and set operations -----------------------------------------------------------------


@query("j01_gene_reference_join", WITH + ", r AS (SELECT v_call, any_value(f) AS fwr1_aa FROM (SELECT v_call, upper(replace(v_call, '*', '')) AS f FROM rep) GROUP BY 1) SELECT c.v_call, nullif(upper(translate(r.fwr1_aa, '.- *', '')), '') AS fwr1_aa, count(*) AS n FROM clean c LEFT JOIN r USING (v_call) GROUP BY ALL")
def j01(spark, d):
    reference = repertoire(spark, d).select("v_call", F.upper(F.replace("v_call", F.lit("*"), F.lit(""))).alias("fwr1_aa")).distinct()
    return cleaning.with_reference(cleaned(spark, d), reference).groupBy("v_call", "fwr1_aa").agg(F.count("*").alias("n"))


@query("j03_labels", WITH + "SELECT d.specimen_label, m.disease AS label, count(*) AS n FROM down d JOIN meta m USING (specimen_label) GROUP BY ALL")
def j03(spark, d):
    labels = metadata(spark, d).select("specimen_label", F.col("disease").alias("label"))
    return downsampled(spark, d).join(labels, "specimen_label").groupBy("specimen_label", "label").agg(F.count("*").alias("n"))


@query("j09_semi_join", WITH + "SELECT disease, count(*) AS n FROM clean WHERE v_gene IN (SELECT v_gene FROM clean WHERE num_reads >= 49) GROUP BY 1")
def j09(spark, d):
    x = cleaned(spark, d)
    return x.join(x.where("num_reads >= 49").select("v_gene").distinct(), "v_gene", "left_semi").groupBy("disease").agg(F.count("*").alias("n"))


@query("j10_anti_join", WITH + "SELECT specimen_label FROM meta WHERE specimen_label NOT IN (SELECT specimen_label FROM down)")
def j10(spark, d):
    return metadata(spark, d).join(downsampled(spark, d), "specimen_label", "left_anti").select("specimen_label")


@query("j11_report_join", WITH + ", s AS (SELECT participant_label, count(*) AS n_clean FROM clean GROUP BY 1) SELECT m.disease, count(DISTINCT m.participant_label) AS n_participants, CAST(sum(n_clean) AS BIGINT) AS n_rows FROM (SELECT DISTINCT participant_label, disease FROM meta) m JOIN s USING (participant_label) GROUP BY 1")
def j11(spark, d):
    stats = cleaned(spark, d).groupBy("participant_label").agg(F.count("*").alias("n_clean"))
    people = metadata(spark, d).select("participant_label", "disease").distinct()
    return people.join(stats, "participant_label").groupBy("disease").agg(F.countDistinct("participant_label").alias("n_participants"), F.sum("n_clean").alias("n_rows"))


@query("p19_with_files", WITH + "SELECT specimen_label, participant_label FROM meta WHERE participant_label IN (SELECT participant_label FROM rep WHERE num_reads >= 45)")
def p19(spark, d):
    files = repertoire(spark, d).where("num_reads >= 45")
    return repertoires.with_files(metadata(spark, d), files).select("specimen_label", "participant_label")


@query("j12_embedding_alignment", WITH + ", k AS (SELECT specimen_label, clone_id, amplification_label, CAST('0x' || substr(md5(specimen_label || clone_id || amplification_label), 1, 6) AS BIGINT) % (SELECT count(*) FROM embeddings) AS i FROM down) SELECT k.specimen_label, k.clone_id AS igh_or_tcrb_clone_id, CAST(e.embedding[1] AS DOUBLE) AS x0 FROM k JOIN embeddings e ON e.vec_id = k.i")
def j12(spark, d):
    digest = F.md5(F.concat("specimen_label", "igh_or_tcrb_clone_id", "amplification_label"))
    keys = ["specimen_label", "igh_or_tcrb_clone_id", "amplification_label"]
    x = written(downsampled(spark, d).select(*keys, "v_gene", "j_gene", "cdr3_aa"))
    n = table(spark, d, "embeddings").count()
    made = x.withColumn("vec_id", F.conv(F.substr(digest, F.lit(1), F.lit(6)), 16, 10).cast("long") % n).join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    both = repertoires.aligned_embeddings(x, made, keys, ("v_gene", "j_gene", "cdr3_aa"))
    return both.select("specimen_label", "igh_or_tcrb_clone_id", F.element_at("embedding", 1).cast("double").alias("x0"))


@query("u01_union_all", WITH + "SELECT specimen_label, role FROM (SELECT specimen_label, 'test' AS role FROM meta WHERE CV_fold = 0 UNION ALL SELECT specimen_label, 'train' FROM meta WHERE CV_fold <> 0)")
def u01(spark, d):
    x = metadata(spark, d)
    return x.where("CV_fold = 0").select("specimen_label", F.lit("test").alias("role")).unionByName(x.where("CV_fold <> 0").select("specimen_label", F.lit("train").alias("role")))


@query("u02_side_by_side", WITH + "SELECT a.specimen_label, a.n AS n_raw, b.n AS n_down FROM (SELECT repertoire_id AS specimen_label, count(*) AS n FROM rep GROUP BY 1) a JOIN (SELECT specimen_label, count(*) AS n FROM down GROUP BY 1) b USING (specimen_label)")
def u02(spark, d):
    a = repertoire(spark, d).groupBy(F.col("repertoire_id").alias("specimen_label")).agg(F.count("*").alias("n_raw"))
    return a.join(downsampled(spark, d).groupBy("specimen_label").agg(F.count("*").alias("n_down")), "specimen_label")


@query("u03_intersect", WITH + "SELECT v_gene FROM clean WHERE disease = 'BUILDING' INTERSECT SELECT v_gene FROM clean WHERE disease = 'MACHINERY'")
def u03(spark, d):
    x = cleaned(spark, d)
    return x.where("disease = 'BUILDING'").select("v_gene").intersect(x.where("disease = 'MACHINERY'").select("v_gene"))


@query("u04_except", WITH + "SELECT cdr3_aa FROM clean WHERE disease = 'BUILDING' EXCEPT SELECT cdr3_aa FROM clean WHERE disease <> 'BUILDING'")
def u04(spark, d):
    x = cleaned(spark, d)
    return x.where("disease = 'BUILDING'").select("cdr3_aa").subtract(x.where("disease <> 'BUILDING'").select("cdr3_aa"))


@query("u05_union", WITH + "SELECT specimen_label FROM meta WHERE CV_fold = 0 UNION SELECT specimen_label FROM down WHERE num_clone_members > 1")
def u05(spark, d):
    return metadata(spark, d).where("CV_fold = 0").select("specimen_label").union(downsampled(spark, d).where("num_clone_members > 1").select("specimen_label")).distinct()


@query("u06_distinct", WITH + "SELECT DISTINCT v_gene, j_gene, cdr3_aa FROM clean")
def u06(spark, d):
    return cleaned(spark, d).select("v_gene", "j_gene", "cdr3_aa").distinct()


# ---- aggregations of the cleaning chain -------------------------------------------------------


@query("a01_duplicates", WITH + "SELECT participant_label, sequence, replicate_label, num_reads, ord, cdr3_aa, v_call, amplification_label FROM dedup")
def a01(spark, d):
    x = cleaning.standard_residues(cleaning.clean_texts(cleaning.v_score_above(cleaning.productive_only(repertoire(spark, d)))))
    return cleaning.collapse_duplicates(x).select("participant_label", "sequence", "replicate_label", "num_reads", "ord", "cdr3_aa", "v_call", "amplification_label")


@query("a02_clone_counts", WITH + "SELECT repertoire_id, count(DISTINCT clone_id) AS n_clones, count(*) AS n_sequences FROM clean GROUP BY 1")
def a02(spark, d):
    return cleaning.clone_counts(cleaned(spark, d))


_GATE = "gate AS (SELECT repertoire_id, count(DISTINCT clone_id) AS n_clones, count(*) AS n_sequences FROM clean GROUP BY 1), gated AS (SELECT *, CASE WHEN n_clones < 5 THEN 'few clones' WHEN n_sequences < 8 THEN 'few sequences' END AS reason FROM gate)"


@query("a03_specimen_gate", WITH + f", {_GATE} SELECT *, reason IS NULL AS passes FROM gated")
def a03(spark, d):
    return cleaning.specimen_gate(cleaned(spark, d), 5, 8)


@query("a04_downsample", WITH + "SELECT specimen_label, amplification_label, clone_id AS igh_or_tcrb_clone_id, ord, num_reads, num_clone_members, total_clone_num_reads, v_gene, j_gene, cdr3_aa FROM down")
def a04(spark, d):
    return downsampled(spark, d).select("specimen_label", "amplification_label", "igh_or_tcrb_clone_id", "ord", "num_reads", "num_clone_members", "total_clone_num_reads", "v_gene", "j_gene", "cdr3_aa")


@query("a17_class_counts", WITH + "SELECT disease, count(DISTINCT participant_label) AS n_participants, count(*) AS n_rows FROM meta GROUP BY 1")
def a17(spark, d):
    return selection.class_counts(metadata(spark, d))


_STEPS = "steps AS (SELECT participant_label, count(*) AS n_raw, count(*) FILTER (WHERE NOT p) AS dropped_productive, count(*) FILTER (WHERE p AND NOT v) AS dropped_v_score, count(*) FILTER (WHERE p AND v AND x) AS dropped_residues, count(*) FILTER (WHERE p AND v AND NOT x) AS n_kept FROM (SELECT participant_label, upper(productive) = 'T' AS p, v_score > 80 AS v, regexp_matches(upper(replace(cdr3_aa, ' ', '')), '[^ACDEFGHIKLMNPQRSTVWY]') AS x FROM rep) GROUP BY 1)"


@query("a19_summary_report", WITH + f", {_STEPS} SELECT 'dataset' AS category, unnest(['participants', 'specimens', 'diseases']) AS metric, unnest([count(DISTINCT participant_label), count(DISTINCT specimen_label), count(DISTINCT disease)])::DOUBLE AS value FROM meta UNION ALL SELECT 'rows', unnest(['n_raw', 'dropped_productive', 'dropped_v_score', 'dropped_residues', 'n_kept']), unnest([sum(n_raw), sum(dropped_productive), sum(dropped_v_score), sum(dropped_residues), sum(n_kept)])::DOUBLE FROM steps")
def a19(spark, d):
    return selection.summary_report(*selection.people_and_steps(repertoire(spark, d)))


@query("a20_detailed_report", WITH + "SELECT disease, round(avg(num_reads), 6) AS mean, round(median(num_reads), 6) AS median, min(num_reads) AS least, max(num_reads) AS most, round(stddev_samp(num_reads), 6) AS deviation FROM down GROUP BY 1")
def a20(spark, d):
    x = selection.stage_report(downsampled(spark, d), "disease", "num_reads")
    return x.withColumns({c: F.round(c, 6) for c in ("mean", "median", "deviation")})


@query("a20_filter_effectiveness", WITH + f", {_STEPS}, t AS (SELECT CAST(sum(n_raw) AS BIGINT) AS r, CAST(sum(dropped_productive) AS BIGINT) AS p, CAST(sum(dropped_v_score) AS BIGINT) AS v, CAST(sum(dropped_residues) AS BIGINT) AS x FROM steps) SELECT 'productive' AS step, p AS n_dropped, round(p / r, 9) AS share FROM t UNION ALL SELECT 'v_score', v, round(v / (r - p), 9) FROM t UNION ALL SELECT 'residues', x, round(x / (r - p - v), 9) FROM t")
def a20_filters(spark, d):
    return selection.filter_effectiveness(selection.step_counts(repertoire(spark, d))).withColumn("share", F.round("share", 9))


@query("a20_all_reports", WITH + f""", {_STEPS}, t AS (SELECT sum(n_raw) AS r, sum(dropped_productive) AS p, sum(dropped_v_score) AS v, sum(dropped_residues) AS x, sum(n_kept) AS k FROM steps)
SELECT 'summary' AS report, '' AS key, unnest(['participants', 'specimens', 'diseases']) AS metric, unnest([count(DISTINCT participant_label), count(DISTINCT specimen_label), count(DISTINCT disease)])::DOUBLE AS value FROM meta
UNION ALL SELECT 'summary', '', unnest(['n_raw', 'dropped_productive', 'dropped_v_score', 'dropped_residues', 'n_kept']), unnest([r, p, v, x, k])::DOUBLE FROM t
UNION ALL SELECT 'filter', unnest(['productive', 'v_score', 'residues']), 'n_dropped', unnest([p, v, x])::DOUBLE FROM t
UNION ALL SELECT 'filter', unnest(['productive', 'v_score', 'residues']), 'share', round(unnest([p / r, v / (r - p), x / (r - p - v)])::DOUBLE, 9) FROM t
UNION ALL SELECT 'participants', disease, 'fold ' || CV_fold, count(DISTINCT participant_label)::DOUBLE FROM meta GROUP BY ALL
UNION ALL SELECT 'rows', m.disease, 'n_kept', sum(s.n_kept)::DOUBLE FROM steps s JOIN (SELECT DISTINCT participant_label, disease FROM meta) m USING (participant_label) GROUP BY ALL""")
def a20_all(spark, d):
    """The summary, the filters' effectiveness and the classes' sizes, all from one pass over the rows."""
    people, steps = selection.people_and_steps(repertoire(spark, d))
    value = F.col("value").cast("double").alias("value")
    summary = selection.summary_report(people, steps).select(F.lit("summary").alias("report"), F.lit("").alias("key"), "metric", value)
    filters = selection.filter_effectiveness(steps).select(F.lit("filter").alias("report"), F.col("step").alias("key"), F.expr("stack(2, 'n_dropped', CAST(n_dropped AS double), 'share', round(share, 9)) AS (metric, value)"))
    folds = people.groupBy("disease", "CV_fold").agg(F.countDistinct("participant_label").alias("value")).select(F.lit("participants").alias("report"), F.col("disease").alias("key"), F.concat(F.lit("fold "), "CV_fold").alias("metric"), value)
    kept = steps.join(people.select("participant_label", "disease").distinct(), "participant_label").groupBy("disease").agg(F.sum("n_kept").alias("value")).select(F.lit("rows").alias("report"), F.col("disease").alias("key"), F.lit("n_kept").alias("metric"), value)
    return summary.unionByName(filters).unionByName(folds).unionByName(kept)


@query("a20_fold_by_disease", WITH + 'SELECT CV_fold, count(DISTINCT participant_label) FILTER (WHERE disease = \'AUTOMOBILE\') AS "AUTOMOBILE", count(DISTINCT participant_label) FILTER (WHERE disease = \'BUILDING\') AS "BUILDING", count(DISTINCT participant_label) FILTER (WHERE disease = \'FURNITURE\') AS "FURNITURE", count(DISTINCT participant_label) FILTER (WHERE disease = \'HOUSEHOLD\') AS "HOUSEHOLD", count(DISTINCT participant_label) FILTER (WHERE disease = \'MACHINERY\') AS "MACHINERY" FROM meta GROUP BY 1')
def a20_folds(spark, d):
    return selection.fold_by_disease(metadata(spark, d), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@query("a21_first_value", WITH + "SELECT specimen_label, min(disease) AS disease FROM down GROUP BY 1")
def a21(spark, d):
    return downsampled(spark, d).groupBy("specimen_label").agg(F.min("disease").alias("disease"))


@query("a22_constraints", WITH + "SELECT clone_id AS key, count(DISTINCT v_gene) AS n_values FROM clean GROUP BY 1 HAVING count(DISTINCT v_gene) > 1")
def a22(spark, d):
    return splits.many_valued(cleaned(spark, d).withColumnRenamed("clone_id", "key"), "key", "v_gene")


@query("a27_specimen_statistics", WITH + f", {_STEPS}, {_GATE} SELECT s.*, m.specimen_label, m.CV_fold, g.n_clones, g.n_sequences, g.reason, g.n_clones IS NOT NULL AND g.reason IS NULL AS passes FROM steps s LEFT JOIN meta m USING (participant_label) LEFT JOIN gated g ON g.repertoire_id = m.specimen_label")
def a27(spark, d):
    x = selection.specimen_statistics(*selection.people_and_steps(repertoire(spark, d)), cleaning.specimen_gate(cleaned(spark, d), 5, 8))
    return x.withColumn("passes", F.coalesce("passes", F.lit(False)))


@query("t01_sorted_people", WITH + "SELECT DISTINCT participant_label, disease FROM meta ORDER BY 1")
def t01(spark, d):
    return metadata(spark, d).select("participant_label", "disease").distinct().orderBy("participant_label")


@query("t02_sorted_sequences", WITH + "SELECT v_gene, j_gene, cdr3 FROM seqs ORDER BY 1, 2, 3")
def t02(spark, d):
    return sequences(spark, d).select("v_gene", "j_gene", "cdr3").orderBy("v_gene", "j_gene", "cdr3")


@query("t07_per_class_sample", WITH + "SELECT participant_label, specimen_label, disease, CV_fold FROM (SELECT *, row_number() OVER (PARTITION BY disease ORDER BY md5(specimen_label || '#0'), specimen_label) AS r FROM meta) WHERE r <= 20")
def t07(spark, d):
    return selection.per_class_sample(metadata(spark, d), 20)


_ITEMS = "items AS (SELECT disease, cdr3_aa, count(DISTINCT repertoire_id) AS n_specimens FROM clean GROUP BY ALL HAVING count(DISTINCT repertoire_id) >= 3)"


@query("t08_biased_sample", WITH + f", {_ITEMS}, m AS (SELECT c.*, CAST(i.cdr3_aa IS NOT NULL AS INT) AS hit FROM clean c LEFT JOIN items i ON i.disease = c.disease AND i.cdr3_aa = c.cdr3_aa), n AS (SELECT *, row_number() OVER (PARTITION BY repertoire_id, hit ORDER BY md5(ord || '#0'), ord) AS k FROM m) SELECT repertoire_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY repertoire_id ORDER BY CASE WHEN hit = 1 AND k <= 2 THEN 0 ELSE 1 END, md5(ord || '#0'), ord) AS r FROM n) WHERE r <= 5")
def t08(spark, d):
    x = cleaned(spark, d)
    return selection.biased_sample(x, selection.convergent_items(x, 3), 2, 5).select("repertoire_id", "ord")


@query("t09_stratified_people", WITH + ", p AS (SELECT participant_label, disease, CV_fold, count(DISTINCT specimen_label) AS n_specimens FROM meta GROUP BY ALL) SELECT participant_label, disease, CV_fold, n_specimens FROM (SELECT *, row_number() OVER (PARTITION BY disease, CV_fold ORDER BY (n_specimens > 1) DESC, md5(participant_label || '#0'), participant_label) AS r FROM p) WHERE r <= 4")
def t09(spark, d):
    return selection.stratified_people(metadata(spark, d), 4)


@query("t10_convergent_items", WITH + f", {_ITEMS} SELECT * FROM items")
def t10(spark, d):
    return selection.convergent_items(cleaned(spark, d), 3)
