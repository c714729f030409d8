"""Written intermediate tables, which end a lineage and outlive executors, and small files beside them.

All goes through the file system of the path, so a folder may be on any store that Spark reads.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share, or the context's checkpoint folder.

    Where both are unset, a folder of this machine serves a local session; a cluster gets an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not kept.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: the executors have no folder in common")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    return kept.get()


#: Writes that run now, by session, and what the setting was before the first of them; several threads may write.
_LOCK = Lock()
_WRITES: dict[int, tuple[int, str]] = {}


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go when it has ended: nothing reads them again, as its table is the only result.

    The setting is the session's: the first of several writes at once sets it, the last one puts it back.
    """
    key = id(spark)
    with _LOCK:
        n, before = _WRITES.get(key) or (0, spark.conf.get(_CLEANUP, "false"))
        _WRITES[key] = n + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITES.pop(key)
            if n > 1:
                _WRITES[key] = n - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, folder: str = "steps", compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{folder}/{uuid.uuid4().hex}"
    with without_leftovers(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that ``written`` wrote, once nothing reads it again."""
    for parent in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        delete(df.sparkSession, parent)


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _path(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, values: dict) -> None:
    write_text(spark, path, json.dumps(values, sort_keys=True))


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file unless it is there; whether it was written. Of several writers of one path one succeeds."""
    fs, target = _path(spark, path)
    try:
        out = fs.create(target, False)
    except Py4JJavaError as e:
        if fs.exists(target):
            return False
        raise e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return bool(fs.exists(target))


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _path(spark, path)
    fs.delete(target, True)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder; 0 if it isn't there."""
    fs, target = _path(spark, path)
    return int(fs.getContentSummary(target).getLength()) if fs.exists(target) else 0
