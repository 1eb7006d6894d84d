"""Sinks: month-partitioned append log, JSON envelope, keyed upsert."""

import datetime as dt
import json

from pyspark.sql import functions as F

from terminus.sources import sinks
from terminus.streaming import feed


def test_append_log_partitions_by_month(spark):
    rows = spark.createDataFrame([(1, "a", "x", dt.datetime(2025, 1, 31, 23)), (None, "b", "y", dt.datetime(2025, 2, 1)),
                                  (2, "a", "z", dt.datetime(2025, 2, 3))],
                                 "user_id long, action_type string, description string, created_at timestamp_ntz")
    path = feed.scratch(spark, "log")
    sinks.append_log(rows, path, "a")
    sinks.append_log(rows.limit(1), path, "b")     # another batch is added
    sinks.append_log(rows, path, "a")              # a retry replaces its own batch
    back = spark.read.parquet(path)
    assert back.count() == 4
    months = {str(r.log_month): r.n for r in back.groupBy("log_month").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert months == {"2025-01-01": 2, "2025-02-01": 2}
    plan = back.filter(F.col("log_month") == dt.date(2025, 2, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_month" in plan


LOG = "user_id long, action_type string, description string, created_at timestamp_ntz"


def _log_rows(spark, batch):
    return spark.createDataFrame([(batch, "a", f"row {batch}-{m}", dt.datetime(2025, m, 1 + batch)) for m in (1, 2)]
                                 + ([(None, "b", "march", dt.datetime(2025, 3, 1))] if batch == 0 else []), LOG)


def test_append_log_counts_a_batch_once_and_compacts_by_month(spark):
    log = sinks.AppendLog(spark, feed.scratch(spark, "appended"), _log_rows(spark, 0).schema)
    assert log.read().count() == 0
    for batch in range(4):
        log.append(_log_rows(spark, batch), f"s-{batch}")
    log.append(_log_rows(spark, 1), "s-1")                            # replayed after its commit
    log._write(_log_rows(spark, 9).withColumn("log_month", F.lit(dt.date(2025, 1, 1))), "s-9")   # lost before its commit
    want = sorted(r.description for b in range(4) for r in _log_rows(spark, b).collect())
    got = lambda: sorted(r.description for r in log.read().collect())
    assert got() == want
    march = [f for f in log.folders() if "2025-03" in f]
    assert log.compact("c-1", most=3) == 8 and log.compact("c-1", most=0) == 0
    assert got() == want
    assert len(log.folders()) == 3 and march[0] in log.folders()      # the month with one folder was left alone
    log.append(_log_rows(spark, 2), "s-2")                            # a replay after the compaction
    log.sweep()
    assert got() == want
    log.append(_log_rows(spark, 9), "s-9")                            # the lost batch comes again
    assert log.read().count() == len(want) + 2
    plan = log.read().filter(F.col("log_month") == dt.date(2025, 2, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_month" in plan


def test_append_log_stream_survives_restarts(spark):
    folder, ckpt = feed.scratch(spark, "log-feed"), feed.scratch(spark, "log-ckpt")
    schema = _log_rows(spark, 0).schema
    log = sinks.AppendLog(spark, feed.scratch(spark, "log-out"), schema)
    for batch in range(3):                                            # new files, then a restart from the checkpoint
        _log_rows(spark, batch).coalesce(1).write.mode("append").parquet(folder)
        stream = sinks.append_log_stream(feed.read_stream(spark, folder, schema, 1), log, "s", compact_every=2, most=1)
        feed.run_to_end(stream, ckpt, spark)
    assert sorted(r.description for r in log.read().collect()) == sorted(
        r.description for b in range(3) for r in _log_rows(spark, b).collect())
    assert "s-compact-1" in log.committed()


def test_json_report_envelope(spark):
    df = spark.createDataFrame([(1, [10, 11, 12]), (2, [])], "route_id long, trips array<long>")
    docs = {r.route_id: json.loads(r.json) for r in sinks.json_report(df, ["route_id"]).collect()}
    assert docs[1] == {"success": True, "count": 3, "data": {"route_id": 1, "trips": [10, 11, 12]}}
    assert docs[2]["count"] == 0
