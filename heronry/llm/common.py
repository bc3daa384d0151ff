"""Helpers shared by the training-data operators: tables, lineage cuts, word patterns."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
#: Makes Spark delete a query's shuffle files when the query ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; in local mode, our own where it is unset."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    told = spark.conf.get("spark.checkpoint.dir", "")
    if not told and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="heronry-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def _freed(spark: SparkSession):
    """Shuffles of a write that ends in here go when it ends."""
    was = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, was)


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage is cut, and it outlives lost
    executors. The shuffles of the write go when it ends; the table goes by `discard`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def bucketed(df: DataFrame, key: str, label: str = "table") -> DataFrame:
    """df as `written`, in as many buckets by key as a shuffle has partitions: where it is joined or grouped by
    key, it is not shuffled again. df should be dealt by key already, or each task writes to many buckets."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path, n = f"{shared_dir(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _freed(spark):
        df.write.bucketBy(n, key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._written_to, out._named = path, name
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that `written` or `bucketed` returned and that nothing reads any more."""
    for df in tables:
        if df is not None:
            spark = df.sparkSession
            if name := getattr(df, "_named", None):
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(name: str, columns: list[str]) -> str:
    """name, with underscores behind it until no column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def in_workers() -> None:
    """Call at the start of Python work on executors: the libraries' own threads stay off, and large blocks of
    memory go back to the system when they are freed (where the C library can be told so)."""
    for name in ("TOKENIZERS_PARALLELISM", "OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        os.environ.setdefault(name, "false" if name.startswith("TOK") else "1")
    mmap_threshold, trim_threshold = -3, -1
    if hasattr(libc := ctypes.CDLL(None), "mallopt"):
        libc.mallopt(mmap_threshold, 1 << 20)
        libc.mallopt(trim_threshold, 1 << 20)


def rest() -> None:
    """Call at the end of Python work on executors, or of a fit on the driver: what is free goes back to the system, as
    idle workers and the driver stay."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidied(work: Callable) -> Callable:
    """work, a generator function over batches, between in_workers and rest."""

    def run(batches):
        in_workers()
        yield from work(batches)
        rest()

    return run
