"""A table of rows by key that micro-batches update in place, by bucket.

A batch rewrites only the buckets of the keys that it carries. Each rewrite is a
new version, ``data/epoch=<e>/_bucket=<b>``; the batch counts from the moment its
marker ``_commits/<e>`` exists. A batch that is replayed after its commit changes
nothing; one that failed before it is written anew. A bucket's current version is
the one of its latest committed epoch, so a snapshot reads one folder per bucket
and never folds over epochs.

Stored and new rows of a key are merged: new columns replace old ones, or the row of the
greatest ``version`` counts, or the columns of ``fold`` are added up (by any aggregate
that needs no order). ``EventLog`` tells events from their copies for the latter.

The bucket is a hash of the key (``buckets`` of them), or the value of
``bucket_by``, for example the day of an event: then a batch rewrites the days it
touches, and a very late row costs one old day. All folders are reached through
the path's own file system.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from terminus.session import written, written_for

SEED = -1  # epoch of rows that were there before the stream


class KeyedTable:
    """``schema`` of the rows, ``keys`` that name one; ``history=True`` keeps all
    versions, so that ``snapshot(epoch)`` can go back, else only two. With ``version``
    (a bigint column beside the schema's) of all rows of a key the one with the greatest
    counts, and a deleted key keeps its version: an older row that comes later does not
    bring it back. ``fold``: how the columns of stored and new rows are added up."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 16,
                 bucket_by: Column | None = None, history: bool = False, version: str | None = None,
                 fold: dict[str, Callable[[str], Column]] | None = None):
        self.spark, self.path, self.schema, self.keys, self.history = spark, path, schema, keys, history
        self.version, self.fold, self.hashed = version, fold, bucket_by is None
        self.stored = schema if version is None else StructType([*schema.fields, StructField(version, LongType()), StructField("_gone", BooleanType())])
        hashed = F.pmod(F.xxhash64(*keys), F.lit(buckets)) if bucket_by is None else F.coalesce(bucket_by.cast("string"), F.lit("none"))
        self.bucket = hashed.cast("string")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------------ folders
    def _names(self, folder: str, pattern: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        if not self._fs.exists(at):
            return []
        found = (re.fullmatch(pattern, f.getPath().getName()) for f in self._fs.listStatus(at))
        return [m.group(1) for m in found if m]

    def committed(self) -> list[int]:
        return sorted(int(n) for n in self._names("_commits", r"(-?\d+)"))

    def versions(self, epoch: int | None = None) -> dict[str, int]:
        """Bucket folder -> epoch of its current version (as of ``epoch``)."""
        out: dict[str, int] = {}
        for e in self.committed():
            if epoch is None or e <= epoch:
                out |= dict.fromkeys(self._names(f"data/epoch={e}", r"(_bucket=.*)"), e)
        return out

    def _read(self, versions: dict[str, int]) -> DataFrame:
        paths = [f"{self.path}/data/epoch={e}/{b}" for b, e in sorted(versions.items())]
        filled = [p for p in paths if any(f.getPath().getName().startswith("part-") for f in self._fs.listStatus(self._at(p)))]
        return self.spark.read.schema(self.stored).parquet(*filled) if filled else self.spark.createDataFrame([], self.stored)

    def _shown(self, rows: DataFrame) -> DataFrame:
        return rows if self.version is None else rows.filter("not _gone").drop("_gone", self.version)

    def snapshot(self, epoch: int | None = None) -> DataFrame:
        return self._shown(self._read(self.versions(epoch)))

    def buckets(self, names: list[str]) -> DataFrame:
        """The current rows of these bucket folders."""
        now = self.versions()
        return self._shown(self._read({b: now[b] for b in names if b in now}))

    def near(self, batch: DataFrame, epoch: int | None = None) -> DataFrame:
        """The rows (as of ``epoch``) of the buckets into which ``batch`` falls. The
        buckets' names, at most one each, come to the driver."""
        now = self.versions(epoch)
        return self._shown(self._read({b: now[b] for b in self._touched(batch) if b in now}))

    def _touched(self, batch: DataFrame) -> list[str]:
        return sorted(batch.agg(F.collect_set(F.concat(F.lit("_bucket="), self.bucket))).first()[0])

    # ------------------------------------------------------------------- writes
    def upsert(self, batch: DataFrame, epoch: int, order: str | None = None, of: DataFrame | None = None) -> list[str]:
        """Apply ``batch`` (the keys and some of the columns): its columns replace
        those of the rows with the same keys, others stay; new keys are added. With
        ``order``, of all rows for a key, stored ones included, the one with the
        greatest value counts. Rows whose ``_gone`` is true delete their key. Equal
        rows of a batch count once; of different rows for one key (and order) the
        greatest counts. ``of``: written rows with the keys of ``batch``, if these are at
        hand and ``batch`` follows from them cheaply: then it is not written first.
        Returns the bucket folders that the batch has rewritten, also if it is replayed
        after its commit (which writes nothing)."""
        if epoch in self.committed():
            return sorted(self._names(f"data/epoch={epoch}", r"(_bucket=.*)"))
        staged = f"{self.path}/_staged/epoch={epoch}"
        batch = batch if "_gone" in batch.columns or self.fold else batch.withColumn("_gone", F.lit(False))
        if of is not None:
            touched = self._touched(of)
        else:
            # Written once: the micro-batch is not computed again, and its folders name the touched buckets.
            batch.withColumn("_bucket", self.bucket).write.mode("overwrite").partitionBy("_bucket").parquet(staged)
            touched = self._names(f"_staged/epoch={epoch}", r"(_bucket=.*)")
        target = f"{self.path}/data/epoch={epoch}"
        if touched:
            new = batch if of is not None else self.spark.read.schema(batch.schema).parquet(*[f"{staged}/{b}" for b in touched])
            before = self.versions()
            old = self._read({b: before[b] for b in touched if b in before})
            merged = self._merged(old, new, order).withColumn("_bucket", self.bucket)
            if not self.hashed:  # Few large folders, each written by as many tasks as its rows fill.
                merged = merged.hint("rebalance", "_bucket")
            merged.write.mode("overwrite").partitionBy("_bucket").parquet(target)
            for b in touched:  # a bucket whose last row went is an empty version
                self._fs.mkdirs(self._at(f"{target}/{b}"))
        self._fs.create(self._at(f"{self.path}/_commits/{epoch}"), True).close()
        self._fs.delete(self._at(staged), True)
        if not self.history:
            self._sweep(touched)
        return touched

    def _merged(self, old: DataFrame, new: DataFrame, order: str | None) -> DataFrame:
        if self.fold:
            both = old.unionByName(new.select([f.name for f in self.schema if f.name in new.columns]), allowMissingColumns=True)
            return self._grouped(both).agg(*[how(c).alias(c) for c, how in self.fold.items()]).select(
                *[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        order = order or self.version
        given = [f.name for f in self.schema if f.name not in self.keys and f.name in new.columns]
        others = [f.name for f in self.schema if f.name not in self.keys and f.name not in new.columns]
        rank = [F.col(order)] if order else []
        values = F.struct(F.col("_gone"), *[F.col(c) for c in given])
        sides = (old.select(*self.keys, F.struct((F.lit(False) if self.version is None else F.col("_gone")).alias("_gone"), *given).alias("v"), F.struct(*rank, F.lit(0).alias("_new")).alias("r"),
                            *([F.struct(*others).alias("o")] if others else []))
                 .unionByName(new.select(*self.keys, values.alias("v"), F.struct(*rank, F.lit(1).alias("_new")).alias("r")),
                              allowMissingColumns=True))
        one = self._grouped(sides).agg(F.max(F.struct("r", "v")).alias("_w"), *([F.max("o").alias("_o")] if others else []))
        cols = {c: F.col(f"_w.v.{c}") for c in given} | {c: F.col(f"_o.{c}") for c in others} | {k: F.col(k) for k in self.keys}
        rows = [cols[f.name].cast(f.dataType).alias(f.name) for f in self.schema]
        if self.version is None:
            return one.filter("not _w.v._gone").select(*rows)
        return one.select(*rows, F.col(f"_w.r.{self.version}").cast("bigint").alias(self.version), F.col("_w.v._gone").alias("_gone"))

    def _grouped(self, rows: DataFrame):
        """``rows`` by key. Buckets of a hash are even, so their rows are dealt by bucket,
        which is how they are written: one shuffle."""
        if not self.hashed:
            return rows.groupBy(*self.keys)
        return rows.withColumn("_bucket", self.bucket).repartition("_bucket").groupBy("_bucket", *self.keys)

    def _sweep(self, touched: list[str]) -> None:
        """Drop versions that are older than the last but one (a reader may still
        hold that one)."""
        for b in touched:
            mine = [e for e in self.committed() if self._fs.exists(self._at(f"{self.path}/data/epoch={e}/{b}"))]
            for e in mine[:-2]:
                self._fs.delete(self._at(f"{self.path}/data/epoch={e}/{b}"), True)

    def seed(self, rows: DataFrame, of: DataFrame | None = None) -> None:
        """The rows from which the stream starts (once)."""
        self.upsert(rows.select(*[f.name for f in self.schema]), SEED, of=of)

    def writer(self, order: str | None = None, rows: Callable[[DataFrame], DataFrame] | None = None, one_step: bool = False):
        """``foreachBatch`` function; ``rows`` turns a micro-batch into the rows
        (and deletions) to apply. It may use the batch several times: the batch is
        written first, so that the stream's state is read and stored once. With
        ``one_step`` its rows, cheap to compute and with the batch's keys, are not."""
        def write(batch: DataFrame, epoch: int) -> None:
            if epoch in self.committed():
                return
            with written_for(self.spark):
                if rows is None:
                    self.upsert(batch, epoch, order)
                else:
                    kept = written(batch, self.spark)
                    self.upsert(rows(kept), epoch, order, of=kept if one_step else None)
        return write


class EventLog:
    """The events of a stream, a folder per micro-batch, by which copies are told
    without stream state, however late they come. Batches come one after the other
    (one that failed is written anew), so all folders before a batch's are whole."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def add(self, batch: DataFrame, epoch: int) -> tuple[DataFrame, DataFrame]:
        """The batch as written, and those of its events that no earlier batch had
        (maybe several times within it)."""
        batch.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
        now = self.spark.read.schema(batch.schema).parquet(f"{self.path}/epoch={epoch}")
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [f.getPath().getName() for f in at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
        earlier = [f"{self.path}/{n}" for n in names if n.startswith("epoch=") and int(n[6:]) < epoch]
        if not earlier:
            return now, now
        seen = self.spark.read.schema(batch.select(self.key).schema).parquet(*earlier)
        # Plain equality, by which the events are then also told from their copies within
        # the batch without another shuffle; a null key is one key.
        fresh = now if seen.filter(F.col(self.key).isNull()).first() is None else now.filter(F.col(self.key).isNotNull())
        return now, fresh.join(seen.select(F.col(self.key).alias("_seen")), F.col(self.key) == F.col("_seen"), "left_anti")
