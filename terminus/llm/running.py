"""Exclusive prefix sums over a total order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terminus.llm.common import written


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, for each ``name: value``, the sum of ``value`` over all earlier rows.

    Rows are range-partitioned by ``order`` and written once, so that their
    partitions stay what they are; each partition is summed by itself and the
    totals of earlier partitions (one row per partition) are added. Rows that
    tie on ``order`` must be interchangeable. An empty table stays empty.
    """
    cols = df.columns
    for name, value in sums.items():
        df = df.withColumn(f"_v_{name}", value.cast("bigint"))
    parts = written(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    before = (Window.partitionBy("_pid").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_pid").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    # One row per partition: bounded by the partition count.
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}")
                                      for n in sums])
    return (parts.join(F.broadcast(offsets), "_pid")
            .select(*cols, *[(F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)) + F.col(f"_o_{n}")).alias(n)
                             for n in sums]))
