"""Steps whose cost must not grow faster than their input: what is shuffled, read and written how often."""

import os

import pytest
from pyspark.sql import functions as F

from terminus.operators import lookups
from terminus.session import checkpoint_dir, written, written_for
from terminus.sources import fixtures
from terminus.streaming import feed, jobs, keyed


def test_name_search_takes_grams_of_distinct_names(spark, tables, monkeypatch):
    kept = []
    monkeypatch.setattr(lookups, "written", lambda df: kept.append(written(df)) or kept[-1])
    one = tables.bookings.filter("payment_status = 'paid'").limit(1)
    many = one.crossJoin(spark.range(50)).withColumn("booking_id", F.col("id")).drop("id").unionByName(
        one.withColumn("passenger_lastname", F.lit(None).cast("string")))
    lookups.bookings_by_name(tables.replace(bookings=many), spark.createDataFrame([("Customer",)], "term string")).count()
    assert kept[0].count() == 1


def test_lines_of_an_order_are_joined_once(spark):
    t = {n: fixtures.read_driver(spark, "/root/testdata/sf0.001", n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    raw = fixtures.bookings_raw(t["lineitem"], t["orders"], t["customer"], fixtures.routes(t["nation"], t["region"]))
    plan = raw._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = next(line for line in plan if "Join Inner" in line)
    assert "l_orderkey" in top  # customers and routes are joined to the orders below


def test_written_files_go_at_the_end_of_their_step(spark):
    folder = checkpoint_dir(spark).removeprefix("file:") + "/written"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    with written_for(spark):
        assert written(spark.range(5)).count() == 5
        assert set(os.listdir(folder)) - before
    assert set(os.listdir(folder)) == before
    assert written(spark.range(5)).count() == 5 and set(os.listdir(folder)) - before


def test_a_replay_comes_in_few_batches_whatever_its_files(spark, tables):
    src, size = jobs._source(tables, spark.range(400).repartition(40), "replay")
    epochs = []
    feed.run_to_end(src.writeStream.foreachBatch(lambda batch, epoch: epochs.append(batch.count()) and None), feed.scratch(spark, "replay-ckpt"), spark)
    assert sum(epochs) == 400 and len(epochs) <= jobs.REPLAY_BATCHES and size > 0


@pytest.mark.parametrize("size", [0, 1_000_000_000])
def test_state_partitions_follow_the_feed(spark, size):
    assert feed.state_partitions(spark, size) == max(8, 2 * spark.sparkContext.defaultParallelism, -(-size // feed.STATE_BYTES))


def test_rows_of_a_batch_are_computed_once(spark):
    table = keyed.KeyedTable(spark, feed.scratch(spark, "once"), spark.range(1).schema, ["id"])
    ran = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(x):
        ran.add(1)
        return x

    batch = spark.range(10).select(counted.asNondeterministic()("id").alias("id"))
    table.writer(rows=lambda b: b.join(b.select("id"), "id").unionByName(b))(batch, 0)
    assert ran.value == 10 and table.snapshot().count() == 10
