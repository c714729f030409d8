import gzip
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparktoire.operators import cleaning, storage
from sparktoire.sources import repertoires as r
from sparktoire.streaming import ingest

HEADER = "repertoire_id\tv_call\tj_call\tcdr3_aa\tproductive\tv_score\tsequence\treplicate_label\tclone_id\tnum_reads\n"


def write_metadata(path, rows, header="participant_label\tspecimen_label\tdisease\tCV_fold"):
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path)


def test_metadata_is_checked(spark, tmp_path):
    good = write_metadata(tmp_path / "a.tsv", ["310101\tS1\tHIV\t0", "310101\tS2\tHIV\t0", "2\tS3\tHealthy\t1"])
    df = r.read_metadata(spark, good)
    assert dict(df.dtypes)["participant_label"] == "string" and dict(df.dtypes)["CV_fold"] == "int" and df.count() == 3
    legacy = write_metadata(tmp_path / "b.tsv", ["1\tS1\tHIV\t2"], f"participant_label\tspecimen_label\tdisease\tany_{r.LEGACY_FOLD}")
    assert r.read_metadata(spark, legacy).first()["CV_fold"] == 2
    for rows in (["1\tS1\tHIV\t0", "1\tS2\tT1D\t0"], ["1\tS1\tHIV\t0", "1\tS2\tHIV\t1"], ["1\tS1\tHIV\t0", "2\tS1\tHIV\t0"], ["1\tS1\t\t0"], ["1\tS1\tHIV\t0.5"], ["1\tS1\tHIV\tx"]):
        with pytest.raises(ValueError):
            r.read_metadata(spark, write_metadata(tmp_path / "bad.tsv", rows))
    with pytest.raises(ValueError, match="missing"):
        r.read_metadata(spark, write_metadata(tmp_path / "c.tsv", ["1\tS1"], "participant_label\tspecimen_label"))


def test_sequences_are_read_and_cleaned(spark, tmp_path):
    folder = tmp_path / "tables"
    folder.mkdir()
    rows = ["S1\tTRBV6-2*02\tTRBJ1*01\t cassl\tT\t90\tACG\tR0\t1\t3", "S1\tTRBV6-2*02\tTRBJ1*01\tCASSLAPG\tt\t90\tACG\tR1\t1\t3", "S1\tTRBV6-2*02\tTRBJ1*01\tCASSLAPG\tt\t90\tACG\tR1\t1\t4", "S1\tTRBV1\tTRBJ1\tCA*SLAPG\tT\t90\tA\tR0\t1\t1", "S1\tTRBV1\tTRBJ1\tCASSLAPG\tF\t90\tA\tR0\t1\t1", "S1\tTRBV1\tTRBJ1\tCASSLAPG\tT\t80\tA\tR0\t1\t1", "S1\tTRBV25/OR9-2*01\tTRBJ1\tCASSLAPG\tT\t81\tB\tR0\t1\t1"]
    with gzip.open(folder / "part_table_P1.tsv.gz", "wt") as f:
        f.write(HEADER + "\n".join(rows) + "\n")
    df = r.read_sequences(spark, str(folder))
    assert df.count() == 7 and df.first()["participant_label"] == "P1"
    got = sorted((x.cdr3_aa, x.v_gene, x.v_gene_w_allele, x.num_reads) for x in cleaning.clean(df).collect())
    assert got == [("CASSL", "TRBV6-2", "TRBV6-2*01", 3), ("CASSLAPG", "TRBV6-2", "TRBV6-2*01", 7)]
    assert cleaning.long_enough(cleaning.clean(df)).count() == 1
    metadata = spark.createDataFrame([("P1", "S1"), ("P2", "S2")], "participant_label string, specimen_label string")
    assert [x.participant_label for x in r.with_files(metadata, df).collect()] == ["P1"]
    with pytest.raises(FileNotFoundError):
        r.with_files(metadata.where("participant_label = 'P2'"), df)


def test_optional_columns_switch_steps_off(spark):
    df = spark.createDataFrame([("P1", "S1", "TRBV1*01", "TRBJ1", "CASSLAPG", "7")], "participant_label string, repertoire_id string, v_call string, j_call string, cdr3_aa string, clone_id string")
    assert cleaning.clean(df).count() == 1
    assert cleaning.clean(df.limit(0)).count() == 0


def test_caches_merge_and_checks(spark, tmp_path):
    x = spark.createDataFrame([("P1", "S1", 1), ("P2", "S2", 2)], "participant_label string, specimen_label string, n int")
    path = str(tmp_path / "cache")
    r.write_cache(x, path)
    r.write_cache(x.where("participant_label = 'P2'").withColumn("n", x.n + 10), path)
    schema = x.schema
    assert sorted((c.participant_label, c.n) for c in r.read_cache(spark, path, schema).collect()) == [("P1", 1), ("P2", 12)]
    r.clear_cache(spark, path, ["P1"])
    assert [c.participant_label for c in r.read_cache(spark, path, schema).collect()] == ["P2"]
    merged = r.merged({"a": x.where("n = 1"), "b": x.where("n = 2").drop("n")})
    assert sorted((c.origin, c.n) for c in merged.collect()) == [("a", 1), ("b", None)]
    with pytest.raises(ValueError):
        r.merged({"a": x, "b": x})
    bad = spark.createDataFrame([([1.0, float("nan")],)], "embedding array<float>")
    with pytest.raises(ValueError):
        r.check_embeddings(bad, 2)
    r.check_embeddings(bad.limit(0), 2)


def test_caches_of_many_participants_have_few_folders(spark, tmp_path):
    """Participants share folders; one is rewritten or deleted without the others of its folder, null ones too."""
    path, n = str(tmp_path / "cache"), 3 * r.PARTS
    x = spark.range(n).selectExpr("IF(id = 0, NULL, concat('P', id)) AS participant_label", "CAST(id AS int) AS n")
    r.write_cache(x, path)
    assert len([f for f in storage.names(spark, path) if "=" in f]) <= r.PARTS
    r.write_cache(x.where("n < 9").withColumn("n", x.n - 9), path)
    r.clear_cache(spark, path, ["P20", "P21", "nobody"])
    expected = sorted([*range(-9, 0), *(set(range(9, n)) - {20, 21})])
    assert sorted(c.n for c in r.read_cache(spark, path, x.schema).collect()) == expected
    r.clear_cache(spark, path, [f"P{i}" for i in range(1, n)])
    assert [tuple(c) for c in r.read_cache(spark, path, x.schema).collect()] == [(None, -9)]


def test_caches_by_few_keys_are_written_by_many_tasks(spark, tmp_path):
    """A key with most of the rows is more than one task's work."""
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k")
    try:
        r.write_cache(spark.range(0, 200_000, 1, 8).selectExpr("id", "md5(CAST(id AS string)) AS t", "'0' AS fold"), str(tmp_path / "folds"), "fold")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len([f for f in storage.names(spark, str(tmp_path / "folds" / "fold=0")) if f.endswith(".parquet")]) > 1
    assert spark.read.parquet(str(tmp_path / "folds")).count() == 200_000


def test_stream_cleans_each_file_once(spark, tmp_path):
    row = [("P1", "S1", "TRBV1*01", "TRBJ1", "CASSLAPG", "T", 90.0, "1", "o1")]
    schema = "participant_label string, repertoire_id string, v_call string, j_call string, cdr3_aa string, productive string, v_score double, clone_id string, ord string"
    x = spark.createDataFrame(row, schema)
    src, target, checkpoint = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for expected in (1, 2):
        x.write.mode("append").parquet(src)
        ingest.clean_new_files(spark, src, x.schema, target, checkpoint)
        ingest.clean_new_files(spark, src, x.schema, target, checkpoint)
        assert spark.read.parquet(target).count() == expected


def test_caches_are_built_again_when_spoilt(spark, tmp_path):
    x, path = spark.range(10).selectExpr("id", "CAST(id AS string) AS label"), str(tmp_path / "cache")
    built = lambda settings: r.cached(spark, path, settings, lambda: x)[1]
    assert [built({"a": 1}), built({"a": 1}), built({"a": 2}), built({"a": 2})] == [True, False, True, False]
    part = next(p for p in Path(r.cache_version(spark, path)).iterdir() if p.suffix == ".parquet")
    part.write_bytes(part.read_bytes()[:20])
    assert [built({"a": 2}), built({"a": 2})] == [True, False]
    spark.range(3).selectExpr("id", "'x' AS label").write.mode("append").parquet(r.cache_version(spark, path))
    assert [built({"a": 2}), built({"a": 2})] == [True, False]
    assert {x.name for x in r.cache_sizes(spark, str(tmp_path)).where("n_bytes > 0").collect()} == {"cache"}
    assert len(list((tmp_path / "cache").glob("version-*"))) == len(list((tmp_path / "cache").glob("commit-*.json"))) == 2


def test_a_writer_that_dies_half_way_leaves_the_old_cache(spark, tmp_path):
    path, old, new = str(tmp_path / "cache"), spark.range(10).toDF("id"), spark.range(20).toDF("id")
    first, _ = r.cached(spark, path, {"a": 1}, lambda: old)

    def dies():  # rows are written until one fails
        return new.select(F.when(F.col("id") < 15, F.col("id")).otherwise(F.raise_error(F.lit("died")).cast("long")).alias("id"))

    with pytest.raises(Exception, match="died"):
        r.cached(spark, path, {"a": 2}, dies)
    again, built = r.cached(spark, path, {"a": 1}, lambda: new)
    assert not built and again.count() == 10
    # one that dies while it commits leaves half a file
    (tmp_path / "cache" / "commit-00000002.json").write_text('{"version": "vers')
    again, built = r.cached(spark, path, {"a": 1}, lambda: new)
    assert not built and again.count() == 10
    got, built = r.cached(spark, path, {"a": 2}, lambda: new)
    assert built and got.count() == 20 and first.count() == 10  # who reads the old version still can
    assert len(r.sweep_cache(spark, path)) == 1 and r.sweep_cache(spark, path) == [] and got.count() == 20


def test_writers_at_once_each_commit_a_whole_version(spark, tmp_path):
    path = str(tmp_path / "cache")

    def late(inner):  # another writer commits while this one writes
        r.cached(spark, path, {"who": "b"}, lambda: spark.range(7).toDF("id"))
        return inner

    mine, built = r.cached(spark, path, {"who": "a"}, lambda: late(spark.range(5).toDF("id")))
    assert built and mine.count() == 5
    assert r.cached(spark, path, {"who": "a"}, lambda: spark.range(1).toDF("id"))[1] is False
    assert storage.create_text(spark, f"{path}/commit-00000002.json", "x") is False
    assert sorted(p.name for p in (tmp_path / "cache").glob("commit-*.json")) == ["commit-00000001.json", "commit-00000002.json"]


def test_caches_are_merged_by_a_manifest(spark, tmp_path):
    a = spark.createDataFrame([("P1", 1), ("P1", 2), ("P2", 3)], "participant_label string, n int")
    b = spark.createDataFrame([("P3", 4, "x"), ("P4", 5, "y")], "participant_label string, n int, more string")
    manifest = lambda rows: spark.createDataFrame(rows, "participant_label string, origin string")
    merged, report = r.merge_caches(spark, {"a": a, "b": b}, manifest([("P1", "a"), ("P3", "b")]), str(tmp_path / "m"))
    assert sorted((x.participant_label, x.origin, x.n, x.more) for x in merged.collect()) == [("P1", "a", 1, None), ("P1", "a", 2, None), ("P3", "b", 4, "x")]
    assert sorted(tuple(x) for x in report.collect()) == [("P1", "a", 2, "merged"), ("P2", "a", 1, "unused"), ("P3", "b", 1, "merged"), ("P4", "b", 1, "unused")]
    for bad in ([("P1", "a"), ("P9", "b")], [("P1", "b")], [("P1", "c")], [("P1", "a"), ("P1", "b")]):
        with pytest.raises(ValueError):
            r.merge_caches(spark, {"a": a, "b": b}, manifest(bad), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_splits_are_checked(spark, tmp_path):
    people = spark.createDataFrame([(f"P{i}", f"S{i}", "AB"[i % 2], i % 3) for i in range(30)], "participant_label string, specimen_label string, disease string, CV_fold int")
    path = str(tmp_path / "splits")
    made = lambda m: r.checked_splits(spark, path, m, "cv_ensemble", 0)[1]
    assert [made(people), made(people), made(people.where("participant_label <> 'P3'")), made(people), made(people)] == [True, False, True, True, False]
    for f in (tmp_path / "splits").glob("*.csv"):
        f.write_text(f.read_text().replace("test", "unknown"))
    for f in (tmp_path / "splits").glob(".*.crc"):
        f.unlink()
    assert [made(people), made(people)] == [True, False]


def test_embeddings_are_aligned_and_checked(spark):
    s = spark.createDataFrame([("S1", "1", None, "V1"), ("S1", "1", "x", "V2")], "specimen_label string, clone string, isotype string, v_gene string")
    e = s.withColumn("embedding", F.array(F.lit(1.0)))
    keys = ["specimen_label", "clone", "isotype"]
    assert r.aligned_embeddings(s, e, keys, ("v_gene",)).where("embedding IS NOT NULL").count() == 2
    for a, b in ((s, e.limit(1)), (s, e.unionByName(e)), (s.unionByName(s), e), (s, e.withColumn("v_gene", F.lit("V9")))):
        with pytest.raises(ValueError):
            r.aligned_embeddings(a, b, keys, ("v_gene",))


def test_the_check_of_embeddings_makes_no_vector(spark):
    s = spark.createDataFrame([("S1", "1", "V1"), ("S1", "2", "V2")], "specimen_label string, clone string, v_gene string")
    e = s.withColumn("embedding", F.array(F.raise_error(F.col("v_gene")).cast("double")))
    # the vectors would fail if they were made; what is checked is who has one
    assert r.aligned_embeddings(s, e, ["specimen_label", "clone"], ("v_gene",)).select("clone").count() == 2


def test_bad_files_and_subsets(spark, tmp_path):
    folder = tmp_path / "tables"
    folder.mkdir()
    for p in ("P1", "P2", "P3"):
        with gzip.open(folder / f"part_table_{p}.tsv.gz", "wt") as f:
            f.write(HEADER + f"S{p}\tTRBV1\tTRBJ1\tCASSLAPG\tT\t90\tA\tR0\t1\t1\n" * 3)
    (folder / "part_table_P3.tsv.gz").write_bytes(b"not a gzip file at all")
    with pytest.raises(Exception):
        r.read_sequences(spark, str(folder)).count()
    df = r.read_sequences(spark, str(folder), skip_bad=True)
    assert {x.participant_label for x in df.collect()} == {"P1", "P2"} and df.select("ord").distinct().count() == 6
    assert {x.participant_label for x in r.read_sequences(spark, str(folder), participants=["P2"]).collect()} == {"P2"}
    kept = r.write_subset(df, df.where("participant_label = 'P1'"), str(tmp_path / "subset"))
    assert kept.count() == 3
    with pytest.raises(ValueError):
        r.write_subset(df, spark.createDataFrame([("P9",)], "participant_label string"), str(tmp_path / "none"))


def test_the_setting_of_writes_is_put_back_after_writes_at_once(spark):
    key, before = storage._CLEANUP, spark.conf.get(storage._CLEANUP, "false")
    first, second = storage.without_leftovers(spark), storage.without_leftovers(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(key) == "true"
    second.__exit__(None, None, None)
    assert spark.conf.get(key) == before
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(lambda n: storage.written(spark.range(n)).count(), range(1, 9))) == list(range(1, 9))
    assert spark.conf.get(key) == before
