"""Session helpers shared by the operators: tables, shared-folder storage, settings."""
from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def process_cache() -> dict:
    """What a Python worker keeps between tasks. Functions reach it by value, so their modules' own variables are new in each task."""
    return sys.__dict__.setdefault("_softbough_kept", {})


def give_back() -> None:
    """This process's free memory goes back to the system; the allocators of Arrow and C would keep most of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(run, size: int = 16 << 20):
    """run, a function of a task's Arrow batches, which gives free memory back at the task's end and after each `size` bytes of input.

    Workers outlive their tasks: else each one holds the most that any stage so far took, beside what the executor takes for the next.
    """

    def spaced(batches):
        given = 0
        for batch in batches:
            if given >= size:
                give_back()
                given = 0
            given += batch.nbytes
            yield batch

    def leanly(batches):
        try:
            yield from run(spaced(batches))
        finally:
            give_back()

    return leanly


@contextmanager
def bounded_batches(spark: SparkSession, size: int = 16 << 20):
    """Arrow batches of about so many bytes at most for what runs inside, whatever the rows' width."""
    was = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(size))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if was is None else spark.conf.set(_BATCH, was)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of our own only where that is unset."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    where = spark.sparkContext.getCheckpointDir()
    if where:
        return where.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors and the driver share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="softbough-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def store(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/softbough-{what}-{uuid.uuid4().hex}"
    with bounded_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes a table that store() wrote and that no later plan reads."""
    path = getattr(df, "stored_at", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Has the driver drop the shuffle files that no plan refers to any more; else they stay until its memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpoints(spark: SparkSession) -> None:
    """Sees to it that checkpoint() has a folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
