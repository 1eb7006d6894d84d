"""Stream plumbing: feeds of files, running a query to the end of its input, and
an idempotent per-epoch sink.

All folders live under ``spark.checkpoint.dir``, which a cluster must share; only
a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terminus.session import checkpoint_dir, written


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def event_time(ntz: Column) -> Column:
    """``timestamp_ntz`` -> ``TIMESTAMP`` read as UTC, whatever the session
    zone, so day / hour windows line up with the stored wall-clock values."""
    return F.timestamp_seconds(F.unix_timestamp(ntz))


def write_feed(df: DataFrame, folder: str) -> str:
    """Write ``df`` as the files of a feed, in parallel and in no order: the
    streams must not depend on the order in which files arrive."""
    df.write.parquet(folder)
    return folder


def materialized(df: DataFrame) -> DataFrame:
    """Static side of a stream-static join, computed once and cut from its
    lineage (every micro-batch reuses it, and reads the columns it needs)."""
    return written(df)


def feed_size(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Files of a feed, and their bytes."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = [f.getLen() for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
             if f.getPath().getName().startswith("part-")]
    return len(files), sum(files)


def read_stream(spark: SparkSession, folder: str, schema: StructType,
                files_per_batch: int | None = None) -> DataFrame:
    """Stream of a Parquet folder; ``files_per_batch`` None: all new files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, asked of its own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def epoch_sink(path: str):
    """foreachBatch writer: each micro-batch goes to ``path/_epoch=<id>``,
    overwritten if the epoch is replayed after a failure (exactly-once)."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_epoch={epoch_id}")
    return write


STATE_PARTITIONS_CONF = "terminus.stream.statePartitions"
#: Bytes of a feed's files whose events one state partition keeps.
STATE_BYTES = 16_000_000


def state_partitions(spark: SparkSession, feed_bytes: int = 0) -> int:
    """Shuffle / state-store partitions of a new stream: the setting above if
    given, else twice the cluster's default parallelism (not the 200 default,
    which would run 200 state tasks per micro-batch on a small cluster), and as
    many as the events of a known feed fill, so that a task's state stays small."""
    v = spark.conf.get(STATE_PARTITIONS_CONF, None)
    return int(v) if v else max(8, 2 * spark.sparkContext.defaultParallelism, math.ceil(feed_bytes / STATE_BYTES))


def start(writer, spark: SparkSession, feed_bytes: int = 0):
    """Start a stream with ``state_partitions`` partitions. A stream copies the
    session's settings when it starts (and keeps the partition count in its
    checkpoint), so the caller's setting is restored right after."""
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions(spark, feed_bytes)))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, old)


def run_to_end(writer, checkpoint: str, spark: SparkSession | None = None, feed_bytes: int = 0) -> None:
    """Process everything available now, then stop (restartable from ``checkpoint``)."""
    spark = spark or SparkSession.getActiveSession()
    q = start(writer.option("checkpointLocation", checkpoint).trigger(availableNow=True), spark, feed_bytes)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def latest_per_key(spark: SparkSession, path: str, keys: list[str], schema: StructType) -> DataFrame:
    """Fold an epoch sink of update-mode output: the last epoch's row per key."""
    if not exists(spark, path):  # no micro-batch produced output
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(path)
    vals = [c for c in schema.fieldNames() if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col("_epoch")).alias("_v"))
    return last.select(*keys, *[F.col("_v." + c).alias(c) for c in vals])
