"""Tables between stages of one run, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that each open intermediates() has to delete, the innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own if all runs on one machine; elsewhere executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), f"tessera-{os.getuid()}")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """Where a table may be written; an open intermediates() will delete it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file in any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that are saved inside it: for a caller that has written what it made from them."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: what reads it several times does not compute it again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a saved table that nothing reads any more."""
    spark = df.sparkSession
    base = shared_dir(spark).rpartition(":")[2]
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if base in folder:
            delete(spark, folder)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any file system that Spark writes, in place of one there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file from any file system that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]
