"""Repertoire files: specimen metadata, sequence tables, the gene reference, and caches of them.

Schemas are declared, never inferred, so that labels such as ``310101`` stay text. Checks run as
aggregations; only their few results come to the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparktoire.operators import splits, storage

#: Fixed value: what the legacy name of the fold column ends with. Any column with that ending counts as it.
LEGACY_FOLD = "cross_validation_fold_id_when_in_test_set"
#: Folders of a cache of participants, and the column that numbers them.
PARTS, PART = 256, "participant_part"
#: The columns of a sequence table.
REQUIRED_SEQUENCE = ("repertoire_id", "v_call", "j_call", "cdr3_aa")
OPTIONAL_SEQUENCE = {
    "cdr3": "string", "clone_id": "string", "productive": "string", "v_score": "double", "sequence": "string", "replicate_label": "string", "extracted_isotype": "string",
    "num_reads": "long", "amplification_label": "string", "stop_codon": "string", "vj_in_frame": "string", "fwr1_aa": "string", "cdr1_aa": "string", "fwr2_aa": "string", "cdr2_aa": "string", "fwr3_aa": "string", "fwr4_aa": "string",
}


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; empty fields are nulls."""
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)


def missing_columns(df: DataFrame, names) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def read_metadata(spark: SparkSession, path: str, require_disease: bool = True) -> DataFrame:
    """One row per specimen, checked: labels, one disease and one whole fold per participant."""
    df = _tsv(spark, path)
    for legacy in [c for c in df.columns if c.endswith(LEGACY_FOLD)]:
        if "CV_fold" in df.columns:
            raise ValueError("more than one fold column is there")
        df = df.withColumnRenamed(legacy, "CV_fold")
    missing_columns(df, ("participant_label", "specimen_label", *(("disease",) if require_disease else ())))
    if "CV_fold" in df.columns:
        number = F.expr("try_cast(CV_fold AS double)")
        df = df.withColumns({"CV_fold": F.when(number == F.floor(number), number.cast("int")), "__bad": F.col("CV_fold").isNotNull() & ~F.coalesce(number == F.floor(number), F.lit(False))})
    else:
        df = df.withColumn("__bad", F.lit(False))
    needed = [c for c in ("participant_label", "specimen_label", "disease") if c in df.columns and (require_disease or c != "disease")]
    counts = df.agg(F.count_if("__bad").alias("folds"), *(F.count_if(F.col(c).isNull()).alias(c) for c in needed), (F.count("specimen_label") - F.countDistinct("specimen_label")).alias("repeated")).first().asDict()
    if bad := {k: v for k, v in counts.items() if v}:
        raise ValueError(f"bad metadata rows: {bad}")
    df = df.drop("__bad")
    for c in ("disease", "CV_fold"):
        if c in df.columns and not df.groupBy("participant_label").agg(F.countDistinct(c).alias("n")).where("n > 1").isEmpty():
            raise ValueError(f"a participant has more than one {c}")
    return df


def read_sequences(spark: SparkSession, path: str, partitions: int | None = None, participants: list[str] | None = None, skip_bad: bool = False) -> DataFrame:
    """All participants' tables of a folder, or those of some; the participant comes from the file name.

    Compressed files can't be split, so the rows may be dealt into ``partitions`` right away. With
    ``skip_bad`` what can't be read of a file is left out, with a warning of Spark's, instead of an error.
    ``ord`` follows the place in the file, however it is split.
    """
    reader = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).option("ignoreCorruptFiles", skip_bad)
    if participants is not None:
        reader = reader.option("pathGlobFilter", "part_table_{" + ",".join(participants) + "}.tsv*")
    df = reader.csv(path)
    missing_columns(df, REQUIRED_SEQUENCE)
    at = F.concat_ws("-", F.input_file_name(), F.lpad(F.col("_metadata.file_block_start").cast("string"), 14, "0"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    name = F.regexp_extract(F.input_file_name(), r"part_table_([^/]+?)(\.tsv)?(\.gz)?$", 1)
    df = df.select(*(F.col(c).cast(OPTIONAL_SEQUENCE.get(c, "string")).alias(c) for c in df.columns if c != "participant_label"), name.alias("participant_label"), at.alias("ord"))
    return df.repartition(partitions, "participant_label") if partitions else df


def read_gene_reference(spark: SparkSession, path: str) -> DataFrame:
    df = _tsv(spark, path)
    missing_columns(df, ("v_call", "fwr1_aa", "cdr1_aa", "fwr2_aa", "cdr2_aa", "fwr3_aa"))
    return df


def with_files(metadata: DataFrame, sequences: DataFrame) -> DataFrame:
    """Specimens of participants that have a sequence table; none at all is an error."""
    kept = metadata.join(sequences.select("participant_label").distinct(), "participant_label", "left_semi")
    if kept.isEmpty():
        raise FileNotFoundError("no participant has a sequence table")
    return kept


def check_embeddings(df: DataFrame, size: int, column: str = "embedding") -> None:
    """Vectors of one size, finite and not null."""
    bad = F.col(column).isNull() | (F.size(column) != size) | F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if n := df.agg(F.count_if(bad)).first()[0]:
        raise ValueError(f"{n} embeddings are not {size} finite numbers")


# ---- caches -----------------------------------------------------------------------------------


def write_cache(df: DataFrame, path: str, key: str = "participant_label") -> None:
    """A Parquet table partitioned by participant, or another key; rewriting some participants leaves the others.

    Participants are dealt to ``PARTS`` folders by a hash, as a folder each would be as many files as there are participants;
    any other key has a folder for each value. Tasks that write have about one size, however few the folders are.
    """
    if key != "participant_label":
        _write_parts(df, path, key)
        return
    x, spark = df.withColumn(PART, _part()), df.sparkSession
    if storage.names(spark, path):
        x = storage.written(x)
        others = _parts_of(spark, path, df.schema, x.select(PART)).join(x.select(F.col(key).alias("__key")).distinct(), F.col(key).eqNullSafe(F.col("__key")), "left_anti")
        x = storage.written(x.unionByName(others))
    _write_parts(x, path, PART)


def _part() -> Column:
    return F.pmod(F.xxhash64(F.col("participant_label").cast("string")), F.lit(PARTS)).cast("int")


def _write_parts(df: DataFrame, path: str, column: str) -> None:
    df.hint("rebalance", F.col(column)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def _parts_of(spark: SparkSession, path: str, schema: T.StructType, parts: DataFrame) -> DataFrame:
    """The rows of some folders of a cache of participants, with the folder's number."""
    whole = spark.read.schema(T.StructType([*schema, T.StructField(PART, T.IntegerType())])).parquet(path)
    return whole.join(parts.distinct(), PART, "left_semi").select(*schema.names, PART)


def read_cache(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def cache_report(cached: DataFrame) -> DataFrame:
    return cached.groupBy("participant_label").agg(F.count("*").alias("n_rows"))


def _commits(spark: SparkSession, path: str) -> list[tuple[int, dict]]:
    """The commits of a cache that can be read, the newest first."""
    found = []
    for name in storage.names(spark, path):
        if name.startswith("commit-") and name.endswith(".json"):
            try:
                found.append((int(name[7:-5]), storage.read_json(spark, f"{path}/{name}")))
            except Exception as e:  # half a file of a writer that has died
                print(f"{path}/{name} is no commit: {str(e).splitlines()[0][:200]}")
    return sorted(found, key=lambda c: c[0], reverse=True)


def _version(spark: SparkSession, path: str, commit: dict) -> DataFrame | None:
    """The table of a commit if it has the rows and columns that were written."""
    try:
        df = spark.read.schema(T.StructType.fromJson(commit["schema"])).parquet(f"{path}/{commit['version']}")
        # every column is read, so that a spoilt file shows
        return df if df.agg(F.count(F.lit(1)), *(F.count(c) for c in df.columns)).first()[0] == commit["rows"] else None
    except Exception as e:  # whatever makes a cache unreadable, it is built again
        print(f"the cache {path} can't be read: {str(e).splitlines()[0][:200]}")
        return None


def cached(spark: SparkSession, path: str, settings: dict, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """``(table, whether it was built)``: the newest commit of a cache, if it has these settings and can be read.

    A version is written aside, under a name of its own, and then committed by a numbered file, which only one
    writer can create; so readers see the old version or the new one, and a writer that dies leaves
    neither. Of writers at once each commits a whole version, the last one counts. The version before the newest
    stays, for those who still read it; older ones go.
    """
    commits = _commits(spark, path)
    if commits and commits[0][1]["settings"] == settings:
        df = _version(spark, path, commits[0][1])
        if df is not None:
            return df, False
    version, df = f"version-{uuid.uuid4().hex}", build()
    df.write.parquet(f"{path}/{version}")
    written = spark.read.schema(df.schema).parquet(f"{path}/{version}")
    note = json.dumps({"version": version, "settings": settings, "schema": df.schema.jsonValue(), "rows": written.count()}, sort_keys=True)
    number = 1 + max((int(n[7:-5]) for n in storage.names(spark, path) if n.startswith("commit-")), default=0)
    while not storage.create_text(spark, f"{path}/commit-{number:08d}.json", note):
        number += 1
    for n, old in commits[1:]:
        storage.delete(spark, f"{path}/{old['version']}")
        storage.delete(spark, f"{path}/commit-{n:08d}.json")
    return written, True


def cache_version(spark: SparkSession, path: str) -> str:
    """The folder of the newest version of a cache."""
    return f"{path}/{_commits(spark, path)[0][1]['version']}"


def sweep_cache(spark: SparkSession, path: str) -> list[str]:
    """Delete versions that no commit names, those of writers that have died; not to be run beside a writer."""
    known = {c["version"] for _, c in _commits(spark, path)}
    gone = [n for n in storage.names(spark, path) if n.startswith("version-") and n not in known]
    for n in gone:
        storage.delete(spark, f"{path}/{n}")
    return gone


def cache_sizes(spark: SparkSession, root: str) -> DataFrame:
    """``name, n_bytes`` of everything in a folder of caches."""
    rows = [(n, storage.size(spark, f"{root}/{n}")) for n in storage.names(spark, root)]
    return spark.createDataFrame(rows, "name string, n_bytes long")


def checked_splits(spark: SparkSession, path: str, metadata: DataFrame, context: str = "cv_ensemble", fold: int | None = None, seed: int = 0) -> tuple[DataFrame, bool]:
    """``(participant_label, disease, split_role, whether they were made)`` from a CSV folder.

    Splits that can't be read, or don't hold exactly the metadata's participants, each once, with their
    disease and a role of the context, are made and written again.
    """
    schema, people = "participant_label string, disease string, split_role string", splits.participants(metadata)
    if storage.exists(spark, path):
        df = spark.read.schema(schema).option("header", True).csv(path)
        try:
            known = df.where(F.col("split_role").isin(*splits.CONTEXTS[context][0])).select("participant_label", "disease")
            if df.count() == known.count() and known.exceptAll(people).isEmpty() and people.exceptAll(known).isEmpty():
                return df, False
        except Exception as e:  # a file that isn't CSV at all
            print(f"the splits {path} can't be read and are made again: {str(e).splitlines()[0][:200]}")
    splits.split_roles(metadata, context, fold, seed).select("participant_label", "disease", "split_role").write.mode("overwrite").option("header", True).csv(path)
    return spark.read.schema(schema).option("header", True).csv(path), True


def aligned_embeddings(sequences: DataFrame, embeddings: DataFrame, keys: list[str], same: tuple[str, ...] = ()) -> DataFrame:
    """Every sequence with its embedding, by a key in which nulls are equal.

    A key that isn't unique on either side, a sequence without an embedding, and a pair that differs in one
    of the columns ``same`` are errors.
    """
    for name, df in (("sequences", sequences), ("embeddings", embeddings)):
        if not df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"the keys of the {name} are not unique")
    right = embeddings.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(c).alias(f"__{c}") for c in same), "embedding")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = sequences.join(right, on, "left")
    # the check needs no vectors, so none are shuffled for it
    there = right.select(*(c for c in right.columns if c != "embedding"), F.col("embedding").isNotNull().alias("__there"))
    found = F.coalesce("__there", F.lit(False))
    differ = [F.count_if(found & ~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(c) for c in same]
    counts = sequences.join(there, on, "left").agg(F.count_if(~found).alias("missing"), *differ).first().asDict()
    if bad := {k: n for k, n in counts.items() if n}:
        raise ValueError(f"sequences and embeddings don't fit: {bad}")
    return both.drop(*(f"__{c}" for c in (*keys, *same)))


def clear_cache(spark: SparkSession, path: str, participants: list[str] | None = None) -> None:
    """Delete the cache, or the rows of some participants, through the file system of the path."""
    if participants is None:
        storage.delete(spark, path)
        return
    if not storage.names(spark, path):
        return
    schema = T.StructType([f for f in spark.read.parquet(path).schema if f.name != PART])
    gone = spark.createDataFrame([(p,) for p in participants], "participant_label string")
    parts = gone.select(_part().alias(PART))
    kept = storage.written(_parts_of(spark, path, schema, parts).join(gone, "participant_label", "left_anti"))
    _write_parts(kept, path, PART)
    for r in parts.distinct().join(kept.select(PART), PART, "left_anti").collect():
        storage.delete(spark, f"{path}/{PART}={r[0]}")


def subset(cached: DataFrame, participants: DataFrame) -> DataFrame:
    return cached.join(participants.select("participant_label").distinct(), "participant_label", "left_semi")


def write_subset(cached: DataFrame, participants: DataFrame, path: str) -> DataFrame:
    """A subset as a dataset of its own; a participant without rows is an error."""
    if missing := [r[0] for r in completeness(participants, cached).limit(5).collect()]:
        raise ValueError(f"participants without rows, such as {missing}")
    write_cache(subset(cached, participants), path)
    return read_cache(cached.sparkSession, path, cached.schema)


def merged(sources: dict[str, DataFrame]) -> DataFrame:
    """The union of datasets with their ``origin``; a specimen in two of them is an error."""
    out = None
    for origin, df in sources.items():
        part = df.withColumn("origin", F.lit(origin))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    for key in ("specimen_label", "participant_label"):
        if key in out.columns and not out.groupBy(key).agg(F.countDistinct("origin").alias("n")).where("n > 1").isEmpty():
            raise ValueError(f"a {key} comes from more than one source")
    return out


def merge_caches(spark: SparkSession, sources: dict[str, DataFrame], manifest: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """``(merged cache, report)`` of the participants that a manifest takes from each source.

    ``manifest``: ``participant_label, origin``, each participant once. The report has a row per participant of the
    manifest or of a source: ``participant_label, origin, n_rows, status``, which is ``merged``, ``missing`` (the
    manifest wants it and the source hasn't got it) or ``unused`` (it is not in the manifest). Missing participants
    and origins that aren't there are an error, after the report is written beside the cache.
    """
    twice = manifest.groupBy("participant_label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("a participant is in the manifest more than once")
    rows = None
    for origin, df in sources.items():
        part = df.withColumn("origin", F.lit(origin))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        raise ValueError("no sources")
    wanted = manifest.select("participant_label", "origin")
    found = rows.groupBy("participant_label", "origin").agg(F.count(F.lit(1)).alias("n_rows"))
    status = F.when(F.col("wanted").isNull(), "unused").when(F.col("n_rows").isNull(), "missing").otherwise("merged")
    both = found.join(wanted.withColumn("wanted", F.lit(True)), ["participant_label", "origin"], "full")
    report = both.select("participant_label", "origin", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), status.alias("status"))
    report.write.mode("overwrite").parquet(f"{path}-report")
    report = spark.read.schema(report.schema).parquet(f"{path}-report")
    if missing := [tuple(r)[:2] for r in report.where("status = 'missing'").orderBy("participant_label").limit(5).collect()]:
        raise ValueError(f"participants that their source hasn't got, such as {missing}; see {path}-report")
    kept = rows.join(wanted, ["participant_label", "origin"], "left_semi")
    write_cache(kept, path)
    return read_cache(spark, path, kept.schema), report


def completeness(expected: DataFrame, present: DataFrame, key: str = "participant_label") -> DataFrame:
    """Keys that should be there and aren't."""
    return expected.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def write_predictions(df: DataFrame, path: str, as_csv: bool = True) -> None:
    (df.write.mode("overwrite").option("header", True).csv if as_csv else df.write.mode("overwrite").json)(path)
