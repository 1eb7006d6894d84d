"""Domain-table source: ``load(spark, sf_dir) -> Tables``.

A folder either holds the domain tables at rest (``bookings.parquet`` etc.,
written by ``materialize``) or only the driver's TPC-H-like tables, in which
case the FIXTURES mapping derives them. At-rest tables are read with an
explicit schema so scans prune columns and push filters into Parquet.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from terminus.sources import fixtures
from terminus.sources.schemas import SCHEMAS

DOMAIN_TABLES = ("routes", "vehicles", "users", "driver_details", "bookings", "payment_log",
                 "trips", "system_log", "notifications", "user_notifications")

# Sort order inside each written file, so Parquet min/max statistics prune
# the date-range and key filters the reports use.
AT_REST_SORT = {
    "bookings": ["trip_id", "booking_id"],
    "payment_log": ["payment_datetime"],
    "trips": ["route_id", "trip_id"],
    "system_log": ["created_at"],
}


class Tables:
    """The 10 domain tables. Each entry is a DataFrame or a zero-argument
    factory that builds it on first access, so a query only derives the
    tables it reads (the trips derivation runs a job of its own)."""

    def __init__(self, **tables):
        missing = set(DOMAIN_TABLES) - set(tables)
        if missing:
            raise TypeError(f"missing tables: {sorted(missing)}")
        self._items = dict(tables)

    def __getattr__(self, name: str) -> DataFrame:
        items = self.__dict__.get("_items")
        if items is None or name not in items:
            raise AttributeError(name)
        v = items[name]
        if not isinstance(v, DataFrame):
            v = items[name] = v()
        return v

    def as_dict(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in DOMAIN_TABLES}

    def replace(self, **tables) -> "Tables":
        return Tables(**{**self._items, **tables})

    def register(self, prefix: str = "") -> None:
        """Expose the tables to ``spark.sql`` as temp views."""
        for n, df in self.as_dict().items():
            df.createOrReplaceTempView(prefix + n)


def _is_at_rest(sf_dir: str) -> bool:
    return os.path.exists(os.path.join(sf_dir, "bookings.parquet")) or \
        os.path.exists(os.path.join(sf_dir, "bookings"))


def _path(sf_dir: str, name: str) -> str:
    p = os.path.join(sf_dir, name + ".parquet")
    return p if os.path.exists(p) else os.path.join(sf_dir, name)


# Bucketed layout: the tables joined on trip_id most often share one bucketing,
# so bookings JOIN trips reads co-located buckets without a shuffle.
BUCKET_KEYS = {"bookings": "trip_id", "trips": "trip_id"}
CATALOG_PREFIX = "catalog:"


def load(spark: SparkSession, sf_dir: str, share: bool = False) -> Tables:
    """``sf_dir`` is a folder (domain tables at rest, or the driver tables) or
    ``catalog:<database>`` for tables written by ``materialize_bucketed``."""
    if sf_dir.startswith(CATALOG_PREFIX):
        db = sf_dir[len(CATALOG_PREFIX):]
        return Tables(**{n: spark.table(f"{db}.{n}") for n in DOMAIN_TABLES})
    if _is_at_rest(sf_dir) and not sf_dir.startswith(("s3", "gs", "hdfs", "abfs")):
        dfs = {n: spark.read.schema(SCHEMAS[n]).parquet(_path(sf_dir, n)) for n in DOMAIN_TABLES}
    elif sf_dir.startswith(("s3", "gs", "hdfs", "abfs")):
        dfs = {n: spark.read.schema(SCHEMAS[n]).parquet(f"{sf_dir}/{n}") for n in DOMAIN_TABLES}
    else:
        dfs = fixtures.derive_all(spark, sf_dir, share=share)
    return Tables(**dfs)


def materialize(spark: SparkSession, sf_dir: str, out_dir: str, files_per_table: int | None = None) -> Tables:
    """Write the domain tables of ``sf_dir`` to ``out_dir`` and return them read back.

    Sorted tables are range-partitioned on their sort key; without
    ``files_per_table`` the file count follows the data (shuffle partitions,
    coalesced by AQE toward the advisory partition size).
    """
    t = load(spark, sf_dir, share=True)
    for n, df in t.as_dict().items():
        out = df.select(*[f.name for f in SCHEMAS[n].fields])
        sort = AT_REST_SORT.get(n)
        if sort:
            ranged = (out.repartitionByRange(files_per_table, *sort) if files_per_table
                      else out.repartitionByRange(*sort))
            out = ranged.sortWithinPartitions(*sort)
        out.write.mode("overwrite").parquet(os.path.join(out_dir, n))
    return load(spark, out_dir)


def materialize_bucketed(spark: SparkSession, sf_dir: str, database: str, buckets: int) -> Tables:
    """Write the domain tables as catalog tables; bookings and trips bucketed
    and sorted by trip_id into ``buckets`` buckets. Returns them read back."""
    t = load(spark, sf_dir, share=True)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for n, df in t.as_dict().items():
        out = df.select(*[f.name for f in SCHEMAS[n].fields]).write.mode("overwrite").format("parquet")
        key = BUCKET_KEYS.get(n)
        if key:
            out = out.bucketBy(buckets, key).sortBy(key)
        out.saveAsTable(f"{database}.{n}")
    return load(spark, CATALOG_PREFIX + database)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
              partitions: int, properties: dict | None = None) -> DataFrame:
    """Read one domain table from the operational database in parallel: the
    key range [lower, upper] is split into ``partitions`` range queries (one
    task each). Untested here: no database may be started in this
    environment. Column types are then cast to ``SCHEMAS[table]``."""
    df = spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                         numPartitions=partitions, properties=properties or {})
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])
