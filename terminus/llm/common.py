"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terminus.session import checkpoint_dir

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write once as Parquet below ``spark.checkpoint.dir``.

    A lost executor re-reads the files, and the planner sees their true size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Owner of written tables that are needed until an operator's result is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{checkpoint_dir(self.spark)}/{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def release(self, *tables: DataFrame) -> None:
        """Delete the files behind these tables of ``keep``, or all of them."""
        gone = {p for t in tables for p in self.paths if any(p in f for f in t.inputFiles()[:1])} if tables else set(self.paths)
        for path in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.paths.remove(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, element by element (wraps modulo 2**64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def free_memory() -> None:
    """Hand unused memory back to the system: a worker process lives on for other
    tasks and stages, which should find it small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run):
    """A task function that frees its worker's memory when the task ends."""
    def task(batches):
        yield from run(batches)
        free_memory()
    return task


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def rows_per_batch(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what is written inside: a batch of
    whole texts stands in memory on both sides of the worker's pipe. The caller's
    setting is restored."""
    return _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def packed(spark: SparkSession):
    """What is written inside is compressed harder. The caller's setting is restored."""
    return _set(spark, "spark.sql.parquet.compression.codec", "zstd")


class Memo(dict):
    """Cache of a pure function, emptied when it holds ``bound`` keys.

    Emptying costs time only; it never changes a value.
    """

    def __init__(self, fn, bound: int):
        super().__init__()
        self.fn, self.bound = fn, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.fn(key)
        return value
