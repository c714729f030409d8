"""A resumable job that embeds the sequences of participants, with any embedder, and the check of what it has written.

The result is a folder: ``rows/run-<id>`` are Parquet tables of a run's participants, and
``done/<id>.json`` is written when such a table is whole; so a run that is stopped leaves a table that
counts for nothing, and the next run embeds what no commit has. A commit keeps what each participant's
rows are like - their number, a sum over their keys and sums over their vectors - in a table beside it,
so every triple of sequences, vectors and statistics can be checked at any time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparktoire.operators import storage

Embedder = Callable[[DataFrame], DataFrame]


def statistics(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """``participant_label, n_rows, keys, total, squares, n_bad``: what a participant's stored rows are like.

    ``keys`` doesn't depend on the order of rows; ``total`` and ``squares`` are rounded sums of all numbers.
    """
    v = F.col("embedding")
    number = lambda f: F.aggregate(F.coalesce(v, F.array().cast("array<float>")), F.lit(0.0), f)
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    keys = F.sum(F.pmod(F.xxhash64(key, "cdr3"), F.lit(1 << 31)))
    return rows.groupBy("participant_label").agg(F.count(F.lit(1)).alias("n_rows"), keys.alias("keys"), F.round(F.sum(number(lambda s, x: s + x)), 3).alias("total"), F.round(F.sum(number(lambda s, x: s + x * x)), 3).alias("squares"), F.count_if(bad).alias("n_bad"))


def commits(spark: SparkSession, folder: str) -> list[dict]:
    """The runs that are whole."""
    return [storage.read_json(spark, f"{folder}/done/{n}") for n in storage.names(spark, f"{folder}/done") if n.endswith(".json")]


def _tables(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    paths = [f"{folder}/{kind}/{c['run']}" for c in commits(spark, folder)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


STATISTICS = "participant_label string, n_rows long, keys long, total double, squares double, n_bad long"


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """``participant_label, row_id, cdr3, embedding`` of all whole runs."""
    return _tables(spark, folder, "rows", "participant_label string, row_id string, cdr3 string, embedding array<float>")


def pending(sequences: DataFrame, folder: str) -> DataFrame:
    """Participants of the sequences that no whole run has."""
    done = _tables(sequences.sparkSession, folder, "statistics", STATISTICS).select("participant_label").distinct()
    return sequences.select("participant_label").distinct().join(done, "participant_label", "left_anti")


def embed(sequences: DataFrame, folder: str, embedder: Embedder, runs: int = 1, stop_after: int | None = None) -> int:
    """Embed the pending participants in ``runs`` parts, each committed by itself; returns how many parts were made.

    ``sequences``: ``participant_label, row_id, cdr3``; ``embedder`` adds the column ``embedding``, an array of
    one size everywhere. ``stop_after`` ends the job after so many parts, as a lost driver would.
    """
    spark, made = sequences.sparkSession, 0
    part = F.pmod(F.xxhash64("participant_label"), F.lit(runs))
    for i in range(runs):
        if made == stop_after:
            break
        who = storage.written(pending(sequences, folder).where(part == i))
        if who.isEmpty():
            continue
        run = uuid.uuid4().hex
        mine = sequences.select("participant_label", F.col("row_id").cast("string").alias("row_id"), "cdr3").join(who, "participant_label", "left_semi")
        rows = embedder(mine).select("participant_label", "row_id", "cdr3", F.col("embedding").cast("array<float>").alias("embedding"))
        rows.write.parquet(f"{folder}/rows/{run}")
        statistics(spark.read.schema(rows.schema).parquet(f"{folder}/rows/{run}")).write.parquet(f"{folder}/statistics/{run}")
        found = spark.read.schema(STATISTICS).parquet(f"{folder}/statistics/{run}").agg(F.sum("n_rows").alias("rows"), F.sum("n_bad").alias("bad"), F.count(F.lit(1)).alias("people")).first()
        if found["bad"]:
            raise ValueError(f"{found['bad']} rows of run {run} have no vector of finite numbers")
        storage.write_text(spark, f"{folder}/done/{run}.json", json.dumps({"run": run, "rows": found["rows"], "participants": found["people"]}))
        made += 1
    return made


def verified(sequences: DataFrame, folder: str) -> DataFrame:
    """``participant_label, status`` of every participant that is expected or stored.

    ``ok``; ``missing``: not stored; ``extra``: not expected; ``twice``: in two runs; ``rows``: other sequences than
    expected; ``vectors``: a vector that isn't finite or of the common size; ``statistics``: rows that differ from
    what was noted when they were written.
    """
    spark = sequences.sparkSession
    rows = storage.written(stored(spark, folder))
    size = rows.agg(F.mode(F.size("embedding"))).first()[0]
    noted = _tables(spark, folder, "statistics", STATISTICS).groupBy("participant_label").agg(F.count(F.lit(1)).alias("times"), *(F.sum(c).alias(f"noted_{c}") for c in ("n_rows", "keys", "total", "squares")))
    now = statistics(rows).join(rows.groupBy("participant_label").agg(F.count_if(F.size("embedding") != F.lit(size)).alias("odd")), "participant_label")
    expected = sequences.groupBy("participant_label").agg(F.count(F.lit(1)).alias("want_rows"), F.sum(F.pmod(F.xxhash64(F.col("row_id").cast("string"), "cdr3"), F.lit(1 << 31))).alias("want_keys"))
    x = expected.join(now, "participant_label", "full").join(noted, "participant_label", "full")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.01 + 1e-6 * F.abs(F.col(b))
    status = (
        F.when(F.col("want_rows").isNull(), "extra")
        .when(F.col("noted_n_rows").isNull() & F.col("n_rows").isNull(), "missing")
        .when(F.col("times") > 1, "twice")
        .when(F.coalesce((F.col("n_bad") > 0) | (F.col("odd") > 0), F.lit(False)), "vectors")
        .when(F.coalesce((F.col("n_rows") != F.col("want_rows")) | (F.col("keys") != F.col("want_keys")), F.lit(True)), "rows")
        .when(~F.coalesce((F.col("n_rows") == F.col("noted_n_rows")) & near("total", "noted_total") & near("squares", "noted_squares"), F.lit(False)), "statistics")
        .otherwise("ok")
    )
    return x.select("participant_label", status.alias("status"))
