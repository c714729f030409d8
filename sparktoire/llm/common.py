"""What the corpus operators share: tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparktoire.operators import storage

#: Files of a bucketed table, Spark's own limit; beyond it a file holds several buckets, each still one group.
MOST_BUCKETS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialized(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: its lineage ends there."""
    return storage.written(df, "tables", "zstd")


def bucketed(df: DataFrame, n: int, column: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder, bucketed by ``column``: grouping by it needs no shuffle.

    ``df`` should already be dealt by ``column``, so that each bucket is one file.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{storage.shared_folder(df.sparkSession)}/tables/{name}"
    with storage.without_leftovers(df.sparkSession):
        df.write.option("compression", "zstd").option("path", path).bucketBy(min(n, MOST_BUCKETS), column).sortBy(column).saveAsTable(name)
    return df.sparkSession.table(name)


def dropped(df: DataFrame) -> None:
    """Delete a table that ``materialized`` or ``bucketed`` wrote, once nothing reads it again."""
    spark = df.sparkSession
    for parent in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        storage.delete(spark, parent)
        name = parent.rsplit("/", 1)[1]
        if name.startswith("bucketed_"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; it only sizes buckets."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0)).alias("n")).first()["n"])
