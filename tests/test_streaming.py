"""Streams resume from their checkpoint without double counting."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from terminus.operators import lifecycle as lc
from terminus.sources import requests as rq
from terminus.streaming import feed
from terminus.streaming import jobs as sj


def test_seat_ledger_restart_equals_batch(spark, tables):
    changes = rq.booking_changes(tables).checkpoint()
    lo, hi = changes.agg(F.min("ts"), F.max("ts")).first()
    mid = lo + (hi - lo) / 2
    folder = feed.scratch(spark, "restart-feed")
    out = feed.scratch(spark, "restart-out")
    ckpt = feed.scratch(spark, "restart-ckpt")
    changes.filter(F.col("ts") <= mid).write.parquet(folder)

    def run():
        src = feed.read_stream(spark, folder, changes.schema, files_per_batch=2)
        w = sj.seat_ledger_state(src).writeStream.outputMode("update").foreachBatch(feed.epoch_sink(out))
        feed.run_to_end(w, ckpt, spark)

    run()
    run()   # a restart with no new input must not change anything
    changes.filter(F.col("ts") > mid).write.mode("append").parquet(folder)
    run()
    got = {r.trip_id: r.seats_booked for r in
           feed.latest_per_key(spark, out, ["trip_id"], sj.seat_ledger_state(
               feed.read_stream(spark, folder, changes.schema)).schema).collect()}
    want = {r.trip_id: r.seats_booked for r in lc.seat_ledger(tables.trips, changes).collect()
            if r.trip_id in got or r.seats_booked != 0}
    assert got == want


def test_admission_state_survives_restart(spark, tables):
    reqs = rq.booking_requests(tables).checkpoint()
    snap = rq.empty_trips(tables).select("trip_id", "trip_status", "seats_available", "estimated_departure_time").checkpoint()
    lo, hi = reqs.agg(F.min("requested_at"), F.max("requested_at")).first()
    mid = lo + (hi - lo) / 2
    folder = feed.scratch(spark, "adm-feed")
    out = feed.scratch(spark, "adm-out")
    ckpt = feed.scratch(spark, "adm-ckpt")
    reqs.filter(F.col("requested_at") <= mid).write.parquet(folder)

    def run():
        src = feed.read_stream(spark, folder, reqs.schema)
        feed.run_to_end(src.writeStream.foreachBatch(sj.admission_tables(snap, out, every="yyyy")[2]), ckpt, spark)

    run()
    reqs.filter(F.col("requested_at") > mid).write.mode("append").parquet(folder)
    run()
    got = {r.request_id: r.decision for r in sj.admission_tables(snap, out, every="yyyy")[0].snapshot().collect()}
    want = {r.request_id: r.decision for r in lc.admit_bookings(
        rq.empty_trips(tables), reqs, tables.bookings, tables.payment_log, tables_now()).decisions.collect()}
    assert got == want


def tables_now():
    from terminus.params import DEFAULT_PARAMS
    return DEFAULT_PARAMS.now


def test_ledger_stream_ignores_duplicates_and_order(spark, tables):
    """Each change delivered twice, files in reverse time order within the
    watermark: the ledger still equals the batch fold."""
    changes = rq.booking_changes(tables).filter(F.col("ts") < "1993-01-01").checkpoint()
    if changes.count() == 0:
        changes = rq.booking_changes(tables).limit(200).checkpoint()
    folder = feed.scratch(spark, "dup-feed")
    out = feed.scratch(spark, "dup-out")
    rows = changes.orderBy(F.col("ts").desc())
    rows.write.parquet(folder)
    rows.write.mode("append").parquet(folder)
    src = feed.read_stream(spark, folder, changes.schema, files_per_batch=100)
    w = sj.seat_ledger_state(src).writeStream.outputMode("update").foreachBatch(feed.epoch_sink(out))
    feed.run_to_end(w, feed.scratch(spark, "dup-ckpt"), spark)
    got = {r.trip_id: r.seats_booked for r in feed.latest_per_key(
        spark, out, ["trip_id"], sj.seat_ledger_state(feed.read_stream(spark, folder, changes.schema)).schema).collect()}
    want = {r.trip_id: r.seats_booked for r in lc.seat_ledger(tables.trips, changes).collect() if r.trip_id in got}
    assert got == want and len(got) > 0


def stream_of(spark, parts, schema, name):
    """One file after another, in this order."""
    folder = feed.scratch(spark, name)
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return feed.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)


def finish(spark, frame, keys, name):
    out = feed.scratch(spark, name + "-out")
    feed.run_to_end(frame.writeStream.outputMode("update").foreachBatch(feed.epoch_sink(out)), feed.scratch(spark, name), spark)
    return feed.latest_per_key(spark, out, keys, frame.schema).collect()


DAY = dt.timedelta(days=1)
T0 = dt.datetime(2025, 1, 10)
CHANGES = ("event_id long, booking_id long, trip_id long, old_status string, new_status string, seat_count int, "
           "ts timestamp_ntz")


def test_ledger_keeps_late_rows_and_drops_copies(spark):
    late = (2, 2, 7, None, "paid", 3, T0 - 5 * DAY)
    src = stream_of(spark, [[(1, 1, 7, None, "paid", 2, T0)], [late], [late]], CHANGES, "late-x02")
    (row,) = finish(spark, sj.seat_ledger_state(src), ["trip_id"], "late-x02c")
    assert row.seats_booked == 5


def test_ledger_with_a_delay_is_the_callers_choice(spark):
    src = stream_of(spark, [[(1, 1, 7, None, "paid", 2, T0)], [(3, 3, 7, None, "paid", 1, T0)],
                            [(2, 2, 7, None, "paid", 3, T0 - 5 * DAY)]], CHANGES, "delay-x02")
    (row,) = finish(spark, sj.seat_ledger_state(src, "1 day"), ["trip_id"], "delay-x02c")
    assert row.seats_booked == 3


def test_status_is_the_latest_whatever_the_order(spark):
    ev = lambda i, new, old, d, trip=1: (i, trip, 5, 8, 1, old, new, T0 + d * DAY)
    src = stream_of(spark, [[ev(4, "departed", "boarding", 3, 2)], [ev(2, "arrived", "departed", 1)],
                            [ev(1, "departed", "boarding", 0)], [ev(2, "arrived", "departed", 1), ev(9, "full", "full", 9)]],
                    sj.TRANSITION_SCHEMA, "x03-order")
    src = src.withColumn("distance_km", F.lit(10).cast("decimal(6,2)"))
    (row,) = finish(spark, sj.status_state(src, "driver_id"), ["driver_id"], "x03-orderc")
    assert (row.arrivals, float(row.km), row["last"]) == (1, 10.0, "departed")


def test_admission_gives_every_request_one_row(spark):
    req = "request_id long, trip_id long, seat_count int, requested_at timestamp_ntz"
    src = stream_of(spark, [[(1, 7, 2, T0), (2, 7, 2, T0 + DAY)], [(3, 7, 1, T0 - DAY)], [(4, 7, 1, T0 + 2 * DAY), (1, 7, 2, T0)],
                            [(5, 9, 1, T0)]], req, "late-x07")
    trips = spark.createDataFrame([(7, "boarding", 5)], "trip_id long, trip_status string, seats_available int")
    decided, _, write = sj.admission_tables(trips, feed.scratch(spark, "late-x07-out"))
    feed.run_to_end(src.writeStream.foreachBatch(write), feed.scratch(spark, "late-x07c"), spark)
    got = sorted((r.request_id, r.reason) for r in decided.snapshot().collect())
    assert got == [(1, None), (2, None), (3, "late"), (4, None), (5, "unknown_trip")]


REQUEST = "request_id long, trip_id long, seat_count int, requested_at timestamp_ntz"


def test_admission_frees_the_seats_of_departed_trips(spark):
    """Trip 7 departs on the first day and is kept for one; trip 8 has no departure."""
    trips = spark.createDataFrame([(7, "boarding", 5, T0), (8, "full", 9, None), (9, "boarding", 4, T0 + 9 * DAY)],
                                  "trip_id long, trip_status string, seats_available int, estimated_departure_time timestamp_ntz")
    decided, seats, write = sj.admission_tables(trips, feed.scratch(spark, "free-x07"), keep=DAY)
    batches = [[(1, 7, 2, T0), (2, 8, 1, T0), (3, 7, 1, T0 + 2 * DAY)],  # 3: departed, which frees nothing
               [(4, 9, 4, T0 + 3 * DAY)],                               # trip 7 is freed
               [(5, 7, 1, T0 + DAY / 2), (6, 7, 1, T0 + 4 * DAY), (7, 9, 1, T0 + 4 * DAY), (4, 9, 4, T0 + 3 * DAY)],
               [(8, 8, 1, T0 + 20 * DAY)]]                              # trip 9 is freed
    held = []
    for epoch, rows in enumerate(batches):
        write(spark.createDataFrame(rows, REQUEST), epoch)
        held.append({r.trip_id: r.seats_left for r in seats.snapshot().collect()})
    assert held == [{7: 3, 8: 8}, {8: 8, 9: 0}, {8: 8, 9: 0}, {8: 7}]
    assert {r.request_id: r.reason for r in decided.snapshot().collect()} == {
        1: None, 2: None, 3: "departed", 4: None, 5: "late", 6: "departed", 7: "not_enough_seats", 8: None}


def test_admission_of_a_hot_trip_replayed(spark, monkeypatch):
    """One trip with most requests, copies and null counts; every batch fails once
    between its two tables and is replayed. The decisions are those of a plain loop."""
    import random
    rng, want, seats = random.Random(5), {}, {7: 23, 8: 4}
    trips = spark.createDataFrame([(7, "boarding", 23), (8, "boarding", 4)], "trip_id long, trip_status string, seats_available int")
    decided, held, write = sj.admission_tables(trips, feed.scratch(spark, "hot-x07"))
    upsert, sent = held.upsert, []
    for epoch in range(3):
        rows = [(1000 * epoch + i, 8 if i % 50 == 0 else 7, rng.choice([0, 1, 2, 3, 9, None]),
                 T0 + epoch * DAY + dt.timedelta(minutes=rng.randrange(200))) for i in range(400 if epoch else 4)]
        late = [(9999, 7, 1, T0 - DAY)] if epoch == 2 else []
        for i, trip, n, _ in sorted(rows, key=lambda r: (r[3], r[0])):
            want[i] = "invalid_seat_count" if not n else None if n <= seats[trip] else "not_enough_seats"
            seats[trip] -= n if want[i] is None else 0
        want |= {r[0]: "late" for r in late}
        batch = spark.createDataFrame(rows + late + rows[:9] + sent[:9], REQUEST)
        sent += rows

        def lost(*a):
            raise RuntimeError("lost")
        monkeypatch.setattr(held, "upsert", lost)
        with pytest.raises(RuntimeError):
            write(batch, epoch)
        monkeypatch.setattr(held, "upsert", upsert)
        write(batch, epoch)
        write(batch, epoch)
    assert {r.request_id: r.reason for r in decided.snapshot().collect()} == want
    assert {r.trip_id: r.seats_left for r in held.snapshot().collect()} == seats


def test_live_queue_uses_the_latest_snapshot(spark):
    src = stream_of(spark, [[(7, "boarding", 2)], [(7, "waiting", 1)], [(7, "full", 3), (8, "waiting", 1)]],
                    "trip_id long, trip_status string, _v int", "x04-late")
    got = finish(spark, sj.trip_state(src), ["trip_id"], "x04-latec")
    assert sorted((r.trip_id, r.trip_status) for r in got) == [(7, "full"), (8, "waiting")]


def test_unreadable_sink_is_an_error(spark, tmp_path):
    (tmp_path / "out" / "_epoch=0").mkdir(parents=True)
    (tmp_path / "out" / "_epoch=0" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        feed.latest_per_key(spark, f"file://{tmp_path}/out", ["k"], spark.range(0).schema)
    assert feed.latest_per_key(spark, f"file://{tmp_path}/none", ["id"], spark.range(0).schema).count() == 0


def test_registered_admission_runs_over_several_batches(spark, tables, monkeypatch):
    paths = []
    monkeypatch.setattr(sj, "scratch", lambda s, name: paths.append(feed.scratch(s, name)) or paths[-1])
    got = {r.request_id: r.decision for r in sj.run_stream_admission(tables).collect()}
    (ckpt,) = [p for p in paths if "x07-ckpt" in p]
    commits = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ckpt + "/commits")
    names = {f.getPath().getName() for f in commits.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(commits)}
    assert {"0", "1", "2", "3"} <= names
    reqs = rq.booking_requests(tables)
    want = {r.request_id: r.decision for r in lc.admit_bookings(
        rq.empty_trips(tables), reqs, tables.bookings, tables.payment_log, tables_now()).decisions.collect()}
    assert got == want
    parts = sj.in_time_order(reqs, "requested_at", 4)
    edges = [p.agg(F.min("requested_at"), F.max("requested_at")).first() for p in parts]
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:])) and sum(p.count() for p in parts) == reqs.count()
