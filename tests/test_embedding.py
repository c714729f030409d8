"""The embedding job goes on where it was stopped, and its check finds each way in which a triple can be wrong."""

import shutil
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparktoire.models import classifiers, embedding


@pytest.fixture(scope="module")
def sequences(spark):
    rows = [(f"P{i % 12}", f"r{i}", "ACDEFGHIKL"[i % 7 :] + "MNP"[: i % 3]) for i in range(300)]
    return spark.createDataFrame(rows, "participant_label string, row_id string, cdr3 string").cache()


def status(sequences, folder):
    return {r.participant_label: r.status for r in embedding.verified(sequences, folder).collect()}


def test_a_stopped_run_goes_on(spark, sequences, tmp_path):
    folder, seen = str(tmp_path), []

    def counted(df):
        seen.append({r[0] for r in df.select("participant_label").distinct().collect()})
        return classifiers.embedded(df)

    assert embedding.embed(sequences, folder, counted, runs=4, stop_after=1) == 1
    assert set(status(sequences, folder).values()) == {"ok", "missing"}

    def fails(df):  # a run dies after some of its rows are written
        return classifiers.embedded(df).withColumn("embedding", F.when(F.col("row_id") != "r7", F.col("embedding")).otherwise(F.raise_error(F.lit("lost")).cast("array<float>")))

    with pytest.raises(Exception, match="lost"):
        embedding.embed(sequences, folder, fails, runs=1)
    assert embedding.embed(sequences, folder, counted, runs=4) > 0 and embedding.embed(sequences, folder, counted, runs=4) == 0
    assert set(status(sequences, folder).values()) == {"ok"}
    assert sum(map(len, seen)) == len(set().union(*seen)) == 12  # none was embedded twice
    got = {r.row_id: r.embedding for r in embedding.stored(spark, folder).collect()}
    assert got == {r.row_id: r.embedding for r in classifiers.embedded(sequences).collect()}


def test_rows_without_vectors_are_not_committed(spark, sequences, tmp_path):
    bad = lambda df: classifiers.embedded(df).withColumn("embedding", F.when(F.col("row_id") != "r7", F.col("embedding")))
    with pytest.raises(ValueError, match="no vector"):
        embedding.embed(sequences, str(tmp_path), bad)
    assert embedding.commits(spark, str(tmp_path)) == [] and set(status(sequences, str(tmp_path)).values()) == {"missing"}


def test_wrong_triples_are_found(spark, sequences, tmp_path):
    folder = str(tmp_path)
    embedding.embed(sequences, folder, classifiers.embedded, runs=2)
    changed = sequences.where("participant_label <> 'P3'").withColumn("cdr3", F.when(F.col("row_id") == "r4", "AAAA").otherwise(F.col("cdr3"))).unionByName(spark.createDataFrame([("P77", "r1000", "CC")], sequences.schema))
    found = status(changed, folder)
    assert (found["P3"], found["P4"], found["P77"], found["P5"]) == ("extra", "rows", "missing", "ok")
    # stored numbers that differ from what was noted
    run = embedding.commits(spark, folder)[0]["run"]
    table = spark.read.parquet(f"{folder}/rows/{run}")
    who = table.first()["participant_label"]
    table.withColumn("embedding", F.when(F.col("participant_label") == who, F.transform("embedding", lambda x: x + F.lit(0.5).cast("float"))).otherwise(F.col("embedding"))).write.parquet(f"{folder}/other")
    shutil.rmtree(Path(folder) / "rows" / run)
    shutil.move(Path(folder) / "other", Path(folder) / "rows" / run)
    found = status(sequences, folder)
    assert found.pop(who) == "statistics" and set(found.values()) == {"ok"}


def test_a_sequence_is_hashed_once_whatever_the_size(spark):
    def seconds(size):
        rows = spark.range(2000).select(F.expr("translate(md5(string(id)), '0123456789', 'ACDEFGHIKL')").alias("cdr3"))
        began = time.time()
        classifiers.embedded(rows, size=size).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(8)
    assert seconds(1024) < 10 * seconds(8) + 2


def test_shares_are_those_of_a_plain_count(spark):
    rows = spark.createDataFrame([("CASSF",), ("C",), ("",), (None,)], "cdr3 string")
    got = [r[0] for r in classifiers.embedded(rows).select("embedding").collect()]
    grams = ["C", "A", "S", "S", "F", "CA", "AS", "SS", "SF"]
    bins = [spark.range(1).select(F.pmod(F.xxhash64(F.lit(g)), F.lit(32))).first()[0] for g in grams]
    assert got[0] == [pytest.approx(bins.count(i) / 9, abs=1e-7) for i in range(32)]
    assert sum(got[1]) == 1 and sum(got[2]) == 1 and got[3] == [None] * 32
