"""Sinks: append-only logs, keyed upserts and JSON reports.

Output folders come from the caller; the registered demos write under the
shared checkpoint folder. Nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terminus.operators.lifecycle import upsert  # noqa: F401 - re-exported sink

LOG_COLUMNS = ["user_id", "action_type", "description", "created_at"]


def append_log(rows: DataFrame, path: str, batch_id: str, date_col: str = "created_at") -> None:
    """Append log rows to a table partitioned by batch and month (``log_month``);
    readers prune whole months from date-range filters. A job that is retried
    under its ``batch_id`` replaces what it wrote before.

    Rows are range-partitioned on (month, time) first: each task writes a few
    consecutive months, and a month holding most rows is cut across tasks
    instead of landing in one.
    """
    out = rows.withColumn("log_month", F.trunc(F.col(date_col), "month"))
    (out.repartitionByRange("log_month", date_col)
     .write.mode("overwrite").partitionBy("log_month").parquet(f"{path}/batch_id={batch_id}"))


class AppendLog:
    """A log that batches and streams append to, exactly once per batch id, and
    that is compacted by month.

    A batch is a segment, ``data/segment=<id>/log_month=<month>``; it counts from the
    moment its marker ``_commits/<id>`` exists, so one that failed is not read and is
    written anew, and one that is replayed after its commit changes nothing. A
    compaction is a segment too: it holds the rows of the small month folders that
    its marker names, and from that marker on those are not read any more. The list
    of folders, not of rows, passes through the driver.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, date_col: str = "created_at"):
        self.spark, self.path, self.schema, self.date_col = spark, path, schema, date_col
        self._jvm = spark.sparkContext._jvm
        self._at = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def committed(self) -> list[str]:
        return [n for n in self._names("_commits") if not n.startswith(".")]

    def _commit(self, segment: str, replaced: list[str]) -> None:
        part = self._at(f"{self.path}/_commits/.{segment}")
        out = self._fs.create(part, True)
        out.write("\n".join(replaced).encode())
        out.close()
        self._fs.rename(part, self._at(f"{self.path}/_commits/{segment}"))

    def folders(self) -> list[str]:
        """``segment=<id>/log_month=<month>`` of all rows that count."""
        made, replaced = [], set()
        for segment in self.committed():
            made += [f"segment={segment}/{m}" for m in self._names(f"data/segment={segment}") if m.startswith("log_month=")]
            source = self._fs.open(self._at(f"{self.path}/_commits/{segment}"))
            replaced |= set(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8").split("\n"))
            source.close()
        return [f for f in made if f not in replaced]

    def _read(self, folders: list[str]) -> DataFrame:
        schema = StructType([*self.schema.fields]).add("log_month", "date")
        if not folders:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
                .parquet(*[f"{self.path}/data/{f}" for f in folders]).select(*schema.fieldNames()))

    def read(self) -> DataFrame:
        """The log; a filter on ``log_month`` prunes whole months."""
        return self._read(self.folders())

    def _write(self, rows: DataFrame, segment: str) -> None:
        (rows.write.mode("overwrite").partitionBy("log_month").parquet(f"{self.path}/data/segment={segment}"))

    def append(self, rows: DataFrame, batch_id: str) -> None:
        """Add ``rows``; a month that holds most of them is cut across tasks."""
        if batch_id in self.committed():
            return
        out = rows.select(*self.schema.fieldNames()).withColumn("log_month", F.trunc(F.col(self.date_col), "month"))
        self._write(out.repartitionByRange("log_month", self.date_col), batch_id)
        self._commit(batch_id, [])

    def compact(self, name: str, most: int = 8) -> int:
        """Merge the folders of each month that has more than ``most``; months that
        have fewer are neither read nor written. Returns the number of folders
        replaced. Their files stay for readers that still hold them; ``sweep``
        deletes them."""
        if name in self.committed():
            return 0
        by_month: dict[str, list[str]] = {}
        for f in self.folders():
            by_month.setdefault(f.split("/")[1], []).append(f)
        small = [f for fs in by_month.values() if len(fs) > most for f in fs]
        if small:
            self._write(self._read(small).hint("rebalance", "log_month"), name)
            self._commit(name, small)
        return len(small)

    def sweep(self) -> None:
        """Delete the folders that compactions have replaced."""
        live = set(self.folders())
        for segment in self.committed():
            for m in self._names(f"data/segment={segment}"):
                if m.startswith("log_month=") and f"segment={segment}/{m}" not in live:
                    self._fs.delete(self._at(f"{self.path}/data/segment={segment}/{m}"), True)


def append_log_stream(rows: DataFrame, log: AppendLog, name: str, compact_every: int = 10, most: int = 8):
    """Streaming form of ``append_log``: each micro-batch is a segment of ``log``
    under the stream's ``name``, and every ``compact_every`` batches the months with
    more than ``most`` folders are merged. A restart replays its last batch under
    the same segment name."""
    def write(batch: DataFrame, epoch: int) -> None:
        log.append(batch, f"{name}-{epoch}")
        if (epoch + 1) % compact_every == 0:
            log.compact(f"{name}-compact-{epoch}", most)
    return rows.writeStream.outputMode("append").foreachBatch(write)


def upsert_stream(rows: DataFrame, table, order: str | None = None):
    """Streaming form of ``upsert``: each micro-batch goes into a ``KeyedTable``,
    which rewrites the buckets of its keys only and counts a batch once."""
    return rows.writeStream.outputMode("update").foreachBatch(table.writer(order))


def json_report(df: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """The handlers' ``{success, count, data}`` envelope, one JSON document per
    row (or per row group already nested by the caller) instead of one body
    holding the whole result. ``count`` is the number of elements in the document's own array: of one
    page, where the caller pages."""
    from pyspark.sql.types import ArrayType
    data = F.struct(*[F.col(c) for c in df.columns])
    last = df.columns[-1]
    count = F.size(F.col(last)) if isinstance(df.schema[last].dataType, ArrayType) else F.lit(1)
    body = F.to_json(F.struct(F.lit(True).alias("success"), count.alias("count"), data.alias("data")))
    keys = [F.col(c) for c in (key_cols or [])]
    return df.select(*keys, body.alias("json"))


def write_json_report(df: DataFrame, path: str) -> None:
    """One JSON document per line."""
    df.select("json").write.mode("overwrite").text(path)
