"""Tables that a job writes for itself, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """The JVM's Path and its FileSystem."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, which only a local master can share."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    told = held.get() if held.isDefined() else spark.conf.get("spark.checkpoint.dir", "")
    if told:
        return told
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="heronry-scratch-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Within, a query's shuffle files are deleted when the query ends, not when the session does."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """df as a Parquet table that is read again: computed once, its lineage cut. `discard` deletes it."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return _marked(df.sparkSession.read.schema(df.schema).parquet(path), path)


def _marked(df: DataFrame, path: str) -> DataFrame:
    df._scratch = (*getattr(df, "_scratch", ()), path)
    return df


def carrying(df: DataFrame, *sources: DataFrame) -> DataFrame:
    """df, which reads the scratch tables of sources: discarding it discards these."""
    for source in sources:
        for path in getattr(source, "_scratch", ()):
            _marked(df, path)
    return df


def discard(*tables: DataFrame | None) -> None:
    """Deletes the scratch tables behind these; nothing may read them any more."""
    for df in tables:
        for path in getattr(df, "_scratch", ()):
            at, fs = hadoop_path(df.sparkSession, path)
            fs.delete(at, True)
