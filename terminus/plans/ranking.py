"""Ranking within keys that stays balanced when one key holds most rows.

``row_number() OVER (PARTITION BY k ORDER BY o)`` puts every row of a key in
one task. There are only a few routes, so queue positions would run in a
handful of tasks. ``sequence_within`` gives the same numbers with the work
split across all partitions:

1. range-partition by (k, o): a hot key is cut into consecutive slices that
   land in consecutive partitions;
2. number the rows inside each (partition, key) slice with a window keyed by
   (partition id, k), which is balanced because the slices are;
3. add the number of rows that the same key has in earlier partitions.
   Only the first key of a partition can continue from an earlier partition,
   so that offset table has at most one row per partition. Its size is fixed
   by the partition count, not by the data, so it is safe to broadcast.

Steps 2 and 3 read the range-partitioned rows twice. Range bounds come from a
sample, and shuffle fetch order is not fixed, so two evaluations could cut
partitions differently. The partitioned rows are therefore written once as
Parquet (shared ``spark.checkpoint.dir``): both steps see the same partition ids,
the slices are counted from their key columns alone, and a lost executor re-reads
the files instead of re-cutting the ranges. Step 2 deals the rows by ranges of the
partition id: a hash would put several slices into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terminus.session import written


def _key_cond(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def cumulative_within(df: DataFrame, keys: list[str], order: list[Column], out: str,
                      value: Column | None = None, num_partitions: int | None = None) -> DataFrame:
    """Running count (``value=None``: 1, 2, ...) or running sum of ``value``
    per ``keys`` in ``order``, computed without a per-key task.

    ``order`` must be a total order inside a key: end it with a unique column.
    With no ``keys`` the numbering is global.
    """
    sort_keys = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    v = F.lit(1).cast("bigint") if value is None else value
    # Without an explicit count, AQE may merge adjacent ranges of small data
    # (ranges stay contiguous); large data keeps up to shuffle.partitions.
    part = ((lambda d: d.repartitionByRange(num_partitions, *sort_keys)) if num_partitions
            else (lambda d: d.repartitionByRange(*sort_keys)))
    ranged = written(part(df.withColumn("_v", v)).withColumn("_pid", F.spark_partition_id()))
    w_local = (Window.partitionBy("_pid", *keys).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.repartitionByRange("_pid").withColumn("_local", F.sum("_v").over(w_local))
    slices = ranged.groupBy("_pid", *keys).agg(F.sum("_v").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (slices.withColumn("_off", F.sum("_n").over(before))
               .filter(F.col("_off").isNotNull())
               .select(F.col("_pid").alias("_opid"), *[F.col(k).alias("_o_" + k) for k in keys],
                       "_off"))
    cond = (local["_pid"] == offsets["_opid"])
    for k in keys:
        cond = cond & local[k].eqNullSafe(offsets["_o_" + k])
    # One offset row per partition at most: a broadcast of fixed size.
    joined = local.join(F.broadcast(offsets), cond, "left")
    res = joined.withColumn(out, F.col("_local") + F.coalesce(F.col("_off"), F.lit(0)))
    return res.drop("_v", "_pid", "_local", "_opid", "_off", *["_o_" + k for k in keys])


def sequence_within(df: DataFrame, keys: list[str], order: list[Column], out: str = "rn",
                    num_partitions: int | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order)``, skew-safe."""
    return cumulative_within(df, keys, order, out, None, num_partitions)


def top_k_within(df: DataFrame, keys: list[str], order: list[Column], k: int,
                 out: str | None = "rank") -> DataFrame:
    """First ``k`` rows per key.

    ``row_number() <= literal`` is planned as a partial ``WindowGroupLimit``
    before the shuffle, so each map task sends at most ``k`` rows per key and a
    hot key cannot flood one reducer.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    col = out or "_rank"
    res = df.withColumn(col, F.row_number().over(w)).filter(F.col(col) <= F.lit(k))
    return res if out else res.drop(col)
