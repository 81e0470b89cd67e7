"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where none is set and all executors are threads of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="talweg-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """What cut() writes inside is deleted at the end, but for the tables that are put into the list."""
    kept: list[DataFrame] = []
    _open.append([])
    try:
        yield kept
    finally:
        stay = {getattr(df, "_talweg_path", None) for df in kept}
        for df in _open.pop():
            if df._talweg_path in stay:
                if _open:
                    _open[-1].append(df)
            else:
                drop_cut(df)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder is scratch space
        pass


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: loops keep short plans, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/talweg/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._talweg_path = path
    if _open:
        _open[-1].append(out)
    return out


def drop_cut(df: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing reads it any more."""
    if path := getattr(df, "_talweg_path", None):
        _remove(df.sparkSession, path)
