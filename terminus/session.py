"""Spark session construction, the shared checkpoint folder, and what is written there."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC session zone (timestamps are
# timestamp_ntz at rest, streaming event time is cast with this zone) and AQE
# with skew-join splitting and partition coalescing.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint() files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Streaming state (per booking-day, per trip) grows with the data: keep it
    # in RocksDB rather than on the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A month's trips or a day's payments prune bookings by a Bloom filter even if
    # the table they come from is large (its own scan is pruned by the same dates).
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1TB",
    "spark.executorEnv.PYTHONWARNINGS": "ignore::FutureWarning",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "terminus", extra: dict | None = None) -> SparkSession:
    """Session for scripts and tests; on a cluster pass ``master=None``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("TERMINUS_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    On a cluster the folder comes from ``spark.checkpoint.dir`` and is never
    invented here. Only a local session (tests, benches) without that setting
    gets a fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="terminus-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_OPEN = threading.local()


def written(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder and read
    back (by ``spark``, if given): its lineage is cut, a lost executor re-reads the
    files, and a reader takes the columns it needs. The files stay until the folder
    is removed, or until the ``written_for`` around the call ends."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/written/{uuid.uuid4().hex}"
    if getattr(_OPEN, "paths", None):
        _OPEN.paths[-1].append(path)
    df.write.parquet(path)
    return (spark or df.sparkSession).read.schema(df.schema).parquet(path)


@contextmanager
def written_for(spark: SparkSession) -> Iterator[None]:
    """What is ``written`` inside is deleted at the end: for steps that come again
    and again, such as micro-batches, and whose result is stored elsewhere."""
    _OPEN.paths = [*getattr(_OPEN, "paths", []), []]
    try:
        yield
    finally:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in _OPEN.paths.pop():
            at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at(path), True)
