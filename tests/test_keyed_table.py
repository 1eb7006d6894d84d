"""Tables that micro-batches update by bucket, and the monitors that use them."""

import datetime as dt

from pyspark.sql import functions as F

from terminus.operators import joins
from terminus.plans import views
from terminus.sources import requests as rq
from terminus.sources import sinks
from terminus.streaming import feed
from terminus.streaming import jobs as sj
from terminus.streaming.keyed import SEED, EventLog, KeyedTable

ROW = "k long, a int, b string"


def table(spark, name, **kw):
    return KeyedTable(spark, feed.scratch(spark, name), spark.createDataFrame([], ROW).schema, ["k"], **kw)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_partial_columns_deletes_and_order(spark):
    t = table(spark, "kt1")
    t.seed(spark.createDataFrame([(1, 1, "x"), (2, 2, "y"), (3, 3, None)], ROW))
    t.upsert(spark.createDataFrame([(1, 10), (4, 40), (4, 40)], "k long, a int"), 0)
    assert rows(t.snapshot()) == [(1, 10, "x"), (2, 2, "y"), (3, 3, None), (4, 40, None)]
    t.upsert(spark.createDataFrame([(2, None, None, True), (3, 7, "z", False), (9, None, None, True)], ROW + ", _gone boolean"), 1)
    assert rows(t.snapshot()) == [(1, 10, "x"), (3, 7, "z"), (4, 40, None)]
    o = table(spark, "kt1o")
    for e, batch in enumerate([[(1, 5, "new")], [(1, 4, "late"), (2, 1, "q")], [(2, 1, "r"), (2, 0, "s")]]):
        o.upsert(spark.createDataFrame(batch, ROW), e, order="a")
    assert rows(o.snapshot()) == [(1, 5, "new"), (2, 1, "r")]
    assert table(spark, "kt1e").snapshot().count() == 0


def test_only_touched_buckets_are_rewritten_and_read(spark):
    t = table(spark, "kt2", buckets=8, history=True)
    t.seed(spark.range(200).select(F.col("id").alias("k"), F.lit(0).alias("a"), F.lit("x").alias("b")))
    before = t.versions()
    assert set(before.values()) == {SEED} and len(before) == 8
    touched = t.upsert(spark.createDataFrame([(5, 1, "y")], ROW), 0)
    after = t.versions()
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == set(touched)
    files = t.snapshot().inputFiles()
    assert sum("/epoch=0/" in f for f in files) == sum(touched[0] + "/" in f for f in files) >= 1
    assert sum(r[1] for r in rows(t.snapshot())) == 1 and t.snapshot().count() == 200
    assert sum(r[1] for r in rows(t.snapshot(SEED))) == 0  # the version before is still there


def test_replayed_and_unfinished_epochs(spark):
    t = table(spark, "kt3", buckets=4)
    t.upsert(spark.createDataFrame([(1, 1, "x")], ROW), 0)
    first = t.versions()
    assert t.upsert(spark.createDataFrame([(1, 9, "again")], ROW), 0) == list(first) and t.versions() == first
    assert rows(t.snapshot()) == [(1, 1, "x")]
    # files of an epoch that has not committed do not count, and its replay replaces them
    stray = f"{t.path}/data/epoch=1/_bucket=0"
    spark.createDataFrame([(7, 7, "stray")], ROW).write.parquet(stray)
    assert rows(t.snapshot()) == [(1, 1, "x")]
    t.upsert(spark.createDataFrame([(2, 2, "y")], ROW), 1)
    assert rows(t.snapshot()) == [(1, 1, "x"), (2, 2, "y")]
    for e in range(2, 6):
        t.upsert(spark.createDataFrame([(1, e, "z")], ROW), e)
    assert len(t._names("data/epoch=2", r"(_bucket=.*)")) == 0  # swept
    t.upsert(spark.createDataFrame([(1, None, None, True)], ROW + ", _gone boolean"), 6)
    assert rows(t.snapshot()) == [(2, 2, "y")]


def test_streaming_upsert_resumes(spark):
    t = table(spark, "kt4")
    folder, ckpt = feed.scratch(spark, "kt4-feed"), feed.scratch(spark, "kt4-ckpt")
    schema = spark.createDataFrame([], ROW).schema
    for batch in ([(1, 1, "a"), (2, 1, "a")], [(2, 2, "b")], []):
        spark.createDataFrame(batch, ROW).coalesce(1).write.mode("append").parquet(folder)
        feed.run_to_end(sinks.upsert_stream(feed.read_stream(spark, folder, schema), t, "a"), ckpt, spark)
    assert rows(t.snapshot()) == [(1, 1, "a"), (2, 2, "b")]


def test_live_queue_after_every_micro_batch(spark, tables):
    """Trips change in five parts; after each the table is the queue of that moment."""
    live = sj._small(tables)
    first = tables.trips.withColumn("trip_status", F.lit("waiting")).withColumn("_v", F.lit(1)).checkpoint()
    last = tables.trips.withColumn("_v", F.lit(2)).checkpoint()
    parts = [first] + [last.filter(F.pmod("trip_id", F.lit(4)) == i) for i in range(4)]
    folder, ckpt = feed.scratch(spark, "x04t-feed"), feed.scratch(spark, "x04t-ckpt")
    table_, write = sj.live_queue_table(live, feed.scratch(spark, "x04t"), history=True)
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(folder)
        src = feed.read_stream(spark, folder, part.schema)
        feed.run_to_end(sj.trip_state(src).writeStream.outputMode("update").foreachBatch(write), ckpt, spark)
        now = last.filter(F.pmod("trip_id", F.lit(4)) < i).unionByName(first.filter(F.pmod("trip_id", F.lit(4)) >= i)).drop("_v")
        want = views.queue_status(live.replace(trips=now))
        assert rows(table_.snapshot().select(want.columns)) == rows(want)


def test_seat_monitor_after_every_micro_batch(spark, tables):
    t0 = dt.datetime(2025, 1, 1)
    trips = tables.trips.orderBy("trip_id").limit(40).withColumn("trip_status", F.lit("boarding")).checkpoint()
    live = sj._small(tables.replace(trips=trips))
    ids = [r.trip_id for r in trips.orderBy("trip_id").select("trip_id").collect()]
    change = "event_id long, booking_id long, trip_id long, old_status string, new_status string, seat_count int, ts timestamp_ntz"
    update = "trip_id long, trip_status string, queue_position int, _v long"
    batches = [([(1, 1, ids[0], None, "paid", 2, t0), (2, 2, ids[1], None, "paid", 3, t0)], []),
               ([(1, 1, ids[0], None, "paid", 2, t0), (3, 1, ids[0], "paid", "cancelled", 2, t0)], [(ids[1], "departed", None, 1)]),
               ([(4, 4, ids[1], None, "paid", 1, t0)], [(ids[1], "full", 1, 2), (ids[2], "full", 5, 1)]),
               ([], [(ids[1], "departed", None, 1)])]  # an old snapshot again
    folder, ckpt = feed.scratch(spark, "x05t-feed"), feed.scratch(spark, "x05t-ckpt")
    table_, write = sj.seat_monitor_table(live, feed.scratch(spark, "x05t"))
    assert table_.snapshot().count() == 40
    seats, status, seen = {}, {}, set()
    for changes, updates in batches:
        events = sj.monitor_events(spark.createDataFrame(changes, change), spark.createDataFrame(updates, update))
        events.write.mode("append").parquet(folder)
        src = feed.read_stream(spark, folder, events.schema)
        feed.run_to_end(sj.monitor_state(src).writeStream.outputMode("update").foreachBatch(write), ckpt, spark)
        for e in changes:
            if e[0] not in seen:
                seen.add(e[0])
                seats[e[2]] = seats.get(e[2], 0) + (e[5] if e[3] is None else -e[5])
        for trip, st, pos, v in updates:
            if v > status.get(trip, (0,))[0]:
                status[trip] = (v, st, pos)
        want = {r.trip_id: (seats.get(r.trip_id, 0), r.capacity - seats.get(r.trip_id, 0), status.get(r.trip_id, (0, "boarding"))[1])
                for r in joins.seat_availability(live).collect() if status.get(r.trip_id, (0, "boarding"))[1] in ("boarding", "full")}
        assert {r.trip_id: (r.seats_booked, r.seats_available, r.trip_status) for r in table_.snapshot().collect()} == want
    assert rq.booking_changes(tables).columns == [c.split()[0] for c in change.split(", ")]


PAYMENT = "payment_id long, booking_id long, amount decimal(10,2), payment_datetime timestamp_ntz"


def _stream_parts(spark, parts, schema, write, name):
    folder, ckpt = feed.scratch(spark, name + "-feed"), feed.scratch(spark, name + "-ckpt")
    for rows_ in parts:
        df = rows_ if not isinstance(rows_, list) else spark.createDataFrame(rows_, schema)
        df.coalesce(1).write.mode("append").parquet(folder)
        feed.run_to_end(feed.read_stream(spark, folder, df.schema).writeStream.foreachBatch(write), ckpt, spark)


def test_daily_revenue_with_copies_and_very_late_rows(spark, tables):
    """No state is kept, nothing is lost: the table equals the batch report after
    copies in any batch and payments that come years late."""
    pay = tables.payment_log.select("payment_id", "booking_id", "amount", "payment_datetime").checkpoint()
    lo, hi = pay.agg(F.min("payment_datetime"), F.max("payment_datetime")).first()
    mid = lo + (hi - lo) / 2
    late = pay.filter(F.pmod("payment_id", F.lit(50)) == 0)
    on_time = pay.join(late, "payment_id", "left_anti").select(pay.columns)
    parts = [on_time.filter(F.col("payment_datetime") > mid), on_time.filter(F.col("payment_datetime") <= mid).union(on_time.limit(30)),
             late.union(late), pay.limit(50)]
    payments, report, write = sj.daily_revenue_tables(tables, feed.scratch(spark, "x01t"))
    _stream_parts(spark, parts, None, write, "x01t")
    want = sj.daily_revenue_rows(tables, pay)
    assert rows(report.snapshot().select(want.columns)) == rows(want)
    assert payments.snapshot().count() == pay.count()


def test_a_late_payment_rewrites_its_month_only(spark, tables):
    pay = tables.payment_log.select("payment_id", "booking_id", "amount", "payment_datetime").limit(300).checkpoint()
    payments, report, write = sj.daily_revenue_tables(tables, feed.scratch(spark, "x01m"))
    write(pay, 0)
    before = report.versions()
    one = pay.orderBy("payment_datetime").limit(1)
    write(one.withColumn("payment_id", F.lit(-5).cast("bigint")), 1)
    after = report.versions()
    changed = {b for b in after if after[b] != before.get(b)}
    assert len(changed) == 1 and len(after) > 1
    write(one.withColumn("payment_id", F.lit(-5).cast("bigint")), 2)  # the same payment again
    want = sj.daily_revenue_rows(tables, pay.union(one.withColumn("payment_id", F.lit(-5).cast("bigint"))))
    assert rows(report.snapshot().select(want.columns)) == rows(want)


def test_a_batch_that_failed_between_its_two_tables_is_finished(spark, tables):
    pay = tables.payment_log.select("payment_id", "booking_id", "amount", "payment_datetime").limit(50).checkpoint()
    payments, report, write = sj.daily_revenue_tables(tables, feed.scratch(spark, "x01f"))
    payments.upsert(pay, 0)  # committed, and then the job was lost
    assert report.snapshot().count() == 0
    write(pay, 0)
    assert rows(report.snapshot()) == rows(sj.daily_revenue_rows(tables, pay).select(report.snapshot().columns))


def test_action_counts_with_copies_and_late_rows(spark):
    t0 = dt.datetime(2025, 3, 1, 10, 30)
    log = "log_id long, action_type string, created_at timestamp_ntz"
    day = dt.timedelta(days=1)
    parts = [[(1, "a", t0), (2, "a", t0), (3, "b", t0)], [(1, "a", t0), (4, "a", t0 - 400 * day)], [(4, "a", t0 - 400 * day), (5, "b", t0 + day)]]
    logs, counts, write = sj.action_count_tables(spark, spark.createDataFrame([], log).schema, feed.scratch(spark, "x08t"))
    _stream_parts(spark, parts, log, write, "x08t")
    hour = dt.timedelta(minutes=30)
    assert rows(counts.snapshot().select("hour_start", "action_type", "actions")) == [
        (t0 - 400 * day - hour, "a", 1), (t0 - hour, "a", 2), (t0 - hour, "b", 1), (t0 + day - hour, "b", 1)]


def test_versions_outlast_deletions_and_come_in_any_order(spark):
    t = table(spark, "kt5", version="v", history=True)
    change = ROW + ", v long, _gone boolean"
    for e, batch in enumerate([[(1, 5, "x", 5, False), (2, 1, "y", 1, False)], [(1, None, None, 7, True), (2, 0, "old", 0, False)],
                               [(1, 6, "late", 6, False), (3, 1, "z", 1, False)], [(1, 8, "back", 8, False)]]):
        t.upsert(spark.createDataFrame(batch, change), e)
    assert [rows(t.snapshot(e)) for e in range(4)] == [
        [(1, 5, "x"), (2, 1, "y")], [(2, 1, "y")], [(2, 1, "y"), (3, 1, "z")], [(1, 8, "back"), (2, 1, "y"), (3, 1, "z")]]
    assert t.snapshot().columns == ["k", "a", "b"]


def test_a_folded_table_counts_a_batch_once(spark):
    t = table(spark, "kt6", fold={"a": F.sum, "b": F.max})
    t.seed(spark.createDataFrame([(1, 1, "x")], ROW))
    for e, batch in ((0, [(1, 2, None), (2, 5, "q")]), (0, [(1, 2, None), (2, 5, "q")]), (1, [(2, -1, "p"), (None, 3, None)])):
        t.upsert(spark.createDataFrame(batch, ROW), e)
    assert {tuple(r) for r in t.snapshot().collect()} == {(1, 3, "x"), (2, 4, "q"), (None, 3, None)}


def test_event_log_tells_copies_in_any_batch(spark):
    log = EventLog(spark, feed.scratch(spark, "log"), "k")
    batches = [[(1, 1, "a"), (1, 1, "a"), (None, 0, "n")], [(1, 1, "a"), (2, 2, "b")], [(None, 0, "n"), (2, 2, "b"), (3, 3, "c")]]
    for again in (0, 1):  # a batch that failed later on is written anew
        got = [sorted({r.k or 0 for r in log.add(spark.createDataFrame(b, ROW), e)[1].collect()}) for e, b in enumerate(batches) for _ in range(again + 1)]
        assert got[::again + 1] == [[0, 1], [2], [3]]


def test_monitors_of_late_copies_keep_no_stream_state(spark, tables):
    """Ledger, queue and seat monitor of replays with copies in later batches and old
    snapshots after new ones; no state store is written."""
    import os
    t0 = dt.datetime(2025, 1, 1)
    trips = tables.trips.orderBy("trip_id").limit(20).withColumn("trip_status", F.lit("boarding")).checkpoint()
    live = sj._small(tables.replace(trips=trips))
    ids = [r.trip_id for r in trips.orderBy("trip_id").select("trip_id").collect()]
    change = "event_id long, booking_id long, trip_id long, old_status string, new_status string, seat_count int, ts timestamp_ntz"
    one, two = (1, 1, ids[0], None, "paid", 2, t0), (2, 2, ids[1], None, "paid", 3, t0)
    batches = [[one, two, one], [one, (3, 1, ids[0], "paid", "cancelled", 2, t0)], [two, (4, 4, -7, None, "paid", 1, t0)]]
    ledger, write = sj.seat_ledger_table(spark, feed.scratch(spark, "x02n"))
    _stream_parts(spark, batches, change, write, "x02n")
    assert rows(ledger.snapshot()) == [(-7, 1), (ids[0], 0), (ids[1], 3)]

    update = "trip_id long, trip_status string, queue_position int, _v long"
    steps = [[(ids[1], "departed", None, 2)], [(ids[1], "boarding", 1, 1), (ids[2], "full", 5, 1)], [(ids[2], "full", 5, 1)]]
    _, write, shown = sj.seat_monitor_tables(live, feed.scratch(spark, "x05n"))
    assert shown().count() == 20
    folder, ckpt = feed.scratch(spark, "x05n-feed"), feed.scratch(spark, "x05n-ckpt")
    for c, u in zip(batches, steps):
        sj.monitor_events(spark.createDataFrame(c, change), spark.createDataFrame(u, update)).write.mode("append").parquet(folder)
        schema = spark.read.parquet(folder).schema
        feed.run_to_end(feed.read_stream(spark, folder, schema).writeStream.foreachBatch(write), ckpt, spark)
    got = {r.trip_id: (r.seats_booked, r.seats_available, r.trip_status) for r in shown().collect()}
    cap = {r.trip_id: r.capacity for r in trips.collect()}
    assert got == {i: (0, cap[i], "full" if i == ids[2] else "boarding") for i in ids if i != ids[1]}
    assert not os.path.exists(ckpt.removeprefix("file:") + "/state")

    queue, write = sj.live_queue_table(live, feed.scratch(spark, "x04n"))
    snaps = trips.withColumn("_v", F.lit(1))
    late = snaps.filter(F.col("trip_id") == ids[0])
    for e, part in enumerate((late.withColumn("trip_status", F.lit("departed")).withColumn("_v", F.lit(3)), snaps, late.withColumn("_v", F.lit(2)))):
        write(part, e)
    assert {r.trip_id for r in queue.snapshot().collect()} == set(ids[1:])
