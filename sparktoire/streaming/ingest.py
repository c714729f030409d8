"""New sequence files as a stream: each is cleaned once, and what was done is in the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparktoire.operators import cleaning


def clean_new_files(spark: SparkSession, path: str, schema: T.StructType, target: str, checkpoint: str) -> None:
    """Clean all files that have come since the last call and append them, partitioned by participant."""

    def write(batch: DataFrame, number: int) -> None:
        cleaning.clean(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "participant_label").parquet(target)

    stream = spark.readStream.schema(schema).parquet(path)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type per tumbling window; works on streams and on tables."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
