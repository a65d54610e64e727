"""Cutting lineage on shared storage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints, taken from the session.

    A local session without one gets its own temporary folder; on a cluster
    the folder has to be named, because executors must all see it.
    """
    named = spark.conf.get(_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_KEY} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local[app]


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written inside needs its shuffles no more once it lies there; Spark deletes their files at the end of each query.

    Otherwise they stay until the driver happens to collect its garbage, and all stages of a run share the disk.
    """
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on shared storage and forget how it was made."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    with shuffles_dropped(df.sparkSession):
        # A query is made here, as the setting counts when a query is made.
        return df.select("*").checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def write(df: DataFrame, path: str) -> None:
    """Writes ``df`` as Parquet, packed tighter than a checkpoint, and frees its shuffles."""
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, for large tables: columns are packed, where checkpoints are plain rows. :func:`drop` deletes it."""
    path = scratch_path(df.sparkSession, "kept")
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame, but: DataFrame | None = None) -> None:
    """Deletes the tables that :func:`kept` has written and ``df`` reads, once nothing else reads them, but not those of ``but``."""
    read = lambda table: {os.path.dirname(f) for f in table.inputFiles()}
    for folder in read(df) - (read(but) if but is not None else set()):
        if os.path.basename(folder).startswith("kept-"):
            delete(df.sparkSession, folder)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder of this run."""
    if not path.removeprefix("file:").lstrip("/").startswith(shared_dir(spark).removeprefix("file:").lstrip("/")):
        raise ValueError(f"{path} is no scratch folder")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
