"""Trigger rules T1-T9, queue advancement modes and the smaller lifecycle jobs."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from terminus.operators import lifecycle as lc

TRIPS = ("trip_id long, route_id long, assigned_vehicle_id long, driver_id long, queue_position int, "
         "is_accepting_bookings boolean, estimated_departure_time timestamp_ntz, "
         "actual_departure_datetime timestamp_ntz, actual_arrival_datetime timestamp_ntz, "
         "estimated_trip_duration_minutes int, capacity int, seats_booked int, seats_available int, "
         "trip_status string, fare_price decimal(8,2)")
T0 = dt.datetime(2025, 1, 1, 8)


def trip(tid, route, pos, status, acc=False, drv=1, veh=1):
    return (tid, route, veh, drv, pos, acc, T0, None, None, 60, 14, 0, 14, status, Decimal(100))


def test_seat_ledger_rules(spark):
    ch = spark.createDataFrame([
        (1, 100, 7, None, "paid", 3, T0),                       # T1 +3
        (2, 101, 7, None, "pending", 2, T0),                    # no effect
        (3, 101, 7, "pending", "paid", 2, T0 + dt.timedelta(1)),  # T3 +2
        (4, 100, 7, "paid", "cancelled", 3, T0 + dt.timedelta(2)),  # T2 -3
        (5, 102, 7, None, "paid", 4, T0 + dt.timedelta(3)),     # +4
        (6, 102, 7, "paid", "refunded", 4, T0 + dt.timedelta(4)),  # refund keeps seats
    ], "event_id long, booking_id long, trip_id long, old_status string, new_status string, "
       "seat_count int, ts timestamp_ntz")
    run = {r.event_id: r.seats_booked_after for r in lc.seat_ledger_running(ch).collect()}
    assert run == {1: 3, 2: 3, 3: 5, 4: 2, 5: 6, 6: 6}
    trips = spark.createDataFrame([trip(7, 1, 1, "boarding")], TRIPS)
    (row,) = lc.seat_ledger(trips, ch).collect()
    assert row.seats_booked == 6 and row.seats_available == 8


def test_advance_queue_intended_is_dense(spark):
    rows = [trip(1, 1, 1, "boarding", True), trip(2, 1, 2, "waiting"), trip(3, 1, 3, "full"),
            trip(4, 1, 4, "waiting"), trip(5, 2, 1, "boarding", True), trip(6, 2, 2, "waiting")]
    trips = spark.createDataFrame(rows, TRIPS)
    dep = spark.createDataFrame([(1, T0)], "trip_id long, ts timestamp_ntz")
    res = lc.advance_queue(trips, dep, "intended")
    after = {r.trip_id: r for r in lc.live_queue_after(res).collect()}
    assert [after[i].queue_position for i in (2, 3, 4)] == [1, 2, 3]
    assert after[2].trip_status == "boarding" and after[2].is_accepting_bookings
    assert not after[4].is_accepting_bookings
    assert after[5].queue_position == 1 and after[6].queue_position == 2   # other route untouched
    (d,) = res.snapshot.filter("trip_id = 1").collect()
    assert d.trip_status == "departed" and not d.is_accepting_bookings
    (log,) = res.log.collect()
    assert log.description == "Queue advanced for route 1 after trip 1 departed"


def test_advance_queue_literal_quirk(spark):
    """K6/K7: the trip that lands on position 2 boards; full trips do not move."""
    rows = [trip(1, 1, 1, "boarding", True), trip(2, 1, 2, "waiting"), trip(3, 1, 3, "waiting"),
            trip(4, 1, 4, "full")]
    trips = spark.createDataFrame(rows, TRIPS)
    dep = spark.createDataFrame([(1, T0)], "trip_id long, ts timestamp_ntz")
    after = {r.trip_id: r for r in lc.live_queue_after(lc.advance_queue(trips, dep, "literal")).collect()}
    assert after[2].queue_position == 1 and not after[2].is_accepting_bookings
    assert after[3].queue_position == 2 and after[3].trip_status == "boarding" and after[3].is_accepting_bookings
    assert after[4].queue_position == 4


def test_advance_queue_literal_rejects_two_departures(spark):
    rows = [trip(1, 1, 1, "boarding", True), trip(2, 1, 2, "waiting"), trip(3, 1, 3, "waiting")]
    trips = spark.createDataFrame(rows, TRIPS)
    dep = spark.createDataFrame([(1, T0), (2, T0)], "trip_id long, ts timestamp_ntz")
    with pytest.raises(Exception):
        lc.live_queue_after(lc.advance_queue(trips, dep, "literal")).collect()


def test_arrivals_and_rollups(spark):
    rows = [trip(1, 1, 0, "departed", drv=5, veh=8), trip(2, 1, 0, "arrived", drv=5), trip(3, 1, 0, "departed",
                                                                                        drv=None)]
    trips = spark.createDataFrame(rows, TRIPS)
    arr = spark.createDataFrame([(1, 5, T0), (1, 6, T0), (2, 5, T0), (3, 5, T0), (9, 5, T0)],
                                "trip_id long, driver_id long, ts timestamp_ntz")
    got = {(r.trip_id, r.driver_id): r.reason for r in lc.arrive_trips(trips, arr).decisions.collect()}
    assert got == {(1, 5): None, (1, 6): "not_your_trip", (2, 5): "not_departed", (3, 5): "not_your_trip",
                   (9, 5): "unknown_trip"}
    ev = spark.createDataFrame([
        (11, 1, 5, 8, 1, "boarding", "departed", T0),
        (12, 1, 5, 8, 1, "departed", "arrived", T0 + dt.timedelta(hours=2)),
        (21, 2, 5, 9, 2, "boarding", "departed", T0 + dt.timedelta(hours=3)),
    ], "event_id long, trip_id long, driver_id long, vehicle_id long, route_id long, old_status string, "
       "new_status string, ts timestamp_ntz")
    dd = spark.createDataFrame([(5, "LIC", 10, Decimal(100), 0, "available")],
                               "driver_id long, license_number string, trips_completed int, "
                               "total_distance_driven decimal(10,2), delayed_trips int, driver_status string")
    routes = spark.createDataFrame([(1, Decimal("12.5")), (2, None)], "route_id long, distance_km decimal(6,2)")
    (d,) = lc.driver_rollup(dd, ev, routes).collect()
    assert d.trips_completed == 11 and float(d.total_distance_driven) == 112.5 and d.driver_status == "on_trip"
    veh = spark.createDataFrame([(8, "P8", "available"), (9, "P9", "maintenance")],
                                "vehicle_id long, plate_number string, vehicle_status string")
    vs = {r.vehicle_id: r.vehicle_status for r in lc.vehicle_rollup(veh, ev).collect()}
    assert vs == {8: "available", 9: "in_service"}
    logs = [r.description for r in lc.departure_log(ev).orderBy("event_id").collect()]
    assert logs == ["Trip #1 departed at 2025-01-01 08:00:00", "Trip #2 departed at 2025-01-01 11:00:00"]


def test_cancel_bookings(spark):
    b = spark.createDataFrame([(1, 7, 2, "paid", T0), (2, 7, 1, "cancelled", T0), (3, 7, 4, "refunded", T0)],
                              "booking_id long, trip_id long, seat_count int, payment_status string, "
                              "updated_at timestamp_ntz")
    req = spark.createDataFrame([(10, 1, T0), (11, 1, T0 + dt.timedelta(1)), (12, 2, T0), (13, 3, T0),
                                 (14, 99, T0)], "request_id long, booking_id long, ts timestamp_ntz")
    res = lc.cancel_bookings(b, req)
    got = {r.request_id: r.reason for r in res.decisions.collect()}
    assert got == {10: None, 11: "already_cancelled", 12: "already_cancelled", 13: None, 14: "unknown_booking"}
    texts = sorted(r.description for r in res.log.collect())
    assert texts[0] == "Booking #1 cancelled. 2 seat(s) returned to trip #7"
    ch = {r.booking_id: r.old_status for r in res.extra["changes"].collect()}
    assert ch == {1: "paid", 3: "refunded"}


def test_enqueue_positions(spark):
    trips = spark.createDataFrame([trip(1, 1, 1, "boarding", True), trip(2, 1, 2, "waiting"),
                                   trip(3, 2, 1, "departed")], TRIPS)
    routes = spark.createDataFrame([(1, Decimal(100), 45), (2, Decimal(80), 30)],
                                   "route_id long, fare_price decimal(8,2), estimated_duration_minutes int")
    veh = spark.createDataFrame([(1, 30)], "vehicle_id long, capacity int")
    users = spark.createDataFrame([(5,)], "user_id long")
    req = spark.createDataFrame([(20, 1, 1, 5, T0), (21, 2, 1, None, T0), (22, 2, 1, 5, T0), (23, 2, 7, 5, T0),
                                 (24, 9, 1, 5, T0), (25, 1, 1, 6, T0)],
                                "request_id long, route_id long, vehicle_id long, driver_id long, "
                                "estimated_departure timestamp_ntz")
    res = lc.enqueue_trips(trips, routes, veh, users, req, T0)
    d = {r.request_id: r for r in res.decisions.collect()}
    assert d[20].queue_position == 3 and d[20].trip_status == "waiting"
    assert d[21].queue_position == 1 and d[21].trip_status == "boarding" and d[21].is_accepting_bookings
    assert d[22].queue_position == 2
    assert d[23].reason == "unknown_vehicle" and d[24].reason == "unknown_route"
    assert d[25].reason == "unknown_driver"
    assert sorted(r.trip_id for r in res.snapshot.collect()) == [4, 5, 6]


def test_reassign_and_register(spark):
    trips = spark.createDataFrame([trip(1, 1, 1, "waiting")], TRIPS).withColumn("seats_booked", F.lit(20))
    veh = spark.createDataFrame([(2, 14)], "vehicle_id long, capacity int")
    req = spark.createDataFrame([(1, 2), (1, 3), (5, 2)], "trip_id long, vehicle_id long")
    d = {(r.trip_id, r.vehicle_id): r for r in lc.reassign_vehicles(trips, veh, req).decisions.collect()}
    assert d[(1, 2)].seats_available == -6       # K10: capacity below booked seats is kept
    assert d[(1, 3)].reason == "unknown_vehicle" and d[(5, 2)].reason == "unknown_trip"
    users = spark.createDataFrame([(1, "a@x.org")], "user_id long, email string")
    reqs = spark.createDataFrame([(1, "A", "B", "A@x.org ", None, None), (2, "C", "D", "c@x.org", None, None),
                                  (3, "E", "F", "c@x.org", None, None)],
                                 "request_id long, firstname string, lastname string, email string, "
                                 "phone_number string, role string")
    res = lc.register_users(users, reqs, T0)
    got = {r.request_id: (r.reason, r.user_id) for r in res.decisions.collect()}
    assert got == {1: ("email_exists", None), 2: (None, 2), 3: ("duplicate_in_batch", None)}
    (u,) = res.snapshot.collect()
    assert u.role == "passenger" and u.status == "active"


def test_upsert_sink(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k long, s string, v int")
    changes = spark.createDataFrame([(2, None), (3, "c")], "k long, s string")
    got = {r.k: (r.s, r.v) for r in lc.upsert(target, changes, "k").collect()}
    assert got == {1: ("a", 10), 2: (None, 20), 3: ("c", None)}
    twice = spark.createDataFrame([(2, "z"), (2, "c"), (4, None), (4, None)], "k long, s string")
    got = sorted((r.k, r.s) for r in lc.upsert(target, twice, "k").collect())
    assert got == [(1, "a"), (2, "c"), (4, None)]


def booked(t, n):
    return (*t[:11], n, t[10] - n, *t[13:])


@pytest.mark.parametrize("mode", ["intended", "literal"])
def test_advance_queue_applies_rule_t5(spark, mode):
    """A trip that the UPDATE makes (or leaves) boarding without a seat left is full."""
    rows = [trip(1, 1, 1, "boarding", True), booked(trip(2, 1, 2, "waiting"), 14), booked(trip(3, 1, 3, "waiting"), 14),
            booked(trip(4, 1, 4, "boarding"), 14), booked(trip(5, 2, 1, "boarding"), 14)]
    trips = spark.createDataFrame(rows, TRIPS)
    dep = spark.createDataFrame([(1, T0)], "trip_id long, ts timestamp_ntz")
    after = {r.trip_id: r.trip_status for r in lc.live_queue_after(lc.advance_queue(trips, dep, mode)).collect()}
    opened = 2 if mode == "intended" else 3
    assert after == {2: "waiting", 3: "waiting", opened: "full", 4: "full", 5: "boarding"}  # 5: not touched


@pytest.mark.parametrize("mode", ["intended", "literal"])
def test_repeated_departure_counts_once(spark, mode):
    trips = spark.createDataFrame([trip(1, 1, 1, "boarding"), trip(2, 1, 2, "waiting")], TRIPS)
    dep = spark.createDataFrame([(1, T0 + dt.timedelta(1)), (1, T0), (9, T0)], "trip_id long, ts timestamp_ntz")
    res = lc.advance_queue(trips, dep, mode)
    snap = {r.trip_id: r.actual_departure_datetime for r in res.snapshot.collect()}
    assert snap == {1: T0, 2: None}
    got = sorted((r.trip_id, r.reason or "") for r in res.decisions.collect())
    assert got == [(1, ""), (1, "duplicate_in_batch"), (9, "unknown_trip")]


def test_repeated_reports_and_reassignments_keep_one_row_per_trip(spark):
    trips = spark.createDataFrame([trip(1, 1, 1, "departed"), booked(trip(2, 1, 2, "boarding"), 12)], TRIPS)
    arr = spark.createDataFrame([(1, 1, T0), (1, 1, T0), (1, 8, T0 - dt.timedelta(1))], "trip_id long, driver_id long, ts timestamp_ntz")
    res = lc.arrive_trips(trips, arr)
    assert sorted(r.reason or "" for r in res.decisions.collect()) == ["", "not_departed", "not_your_trip"]
    assert sorted((r.trip_id, r.trip_status) for r in res.snapshot.collect()) == [(1, "arrived"), (2, "boarding")]
    veh = spark.createDataFrame([(2, 12), (3, 30)], "vehicle_id long, capacity int")
    res = lc.reassign_vehicles(trips, veh, spark.createDataFrame([(2, 3), (2, 2), (2, 1)], "trip_id long, vehicle_id long"))
    assert {(r.vehicle_id, r.reason) for r in res.decisions.collect()} == {
        (1, "unknown_vehicle"), (2, None), (3, "duplicate_in_batch")}
    assert [(r.capacity, r.trip_status) for r in res.snapshot.filter("trip_id = 2").collect()] == [(12, "full")]  # T5
    users = spark.createDataFrame([(4, "driver"), (5, "driver")], "user_id long, role string")
    details = spark.createDataFrame([(4,), (5,)], "driver_id long")
    res = lc.reassign_drivers(trips, users, details, spark.createDataFrame([(2, 5), (2, 4)], "trip_id long, driver_id long"))
    assert [r.driver_id for r in res.snapshot.filter("trip_id = 2").collect()] == [4]


def test_cancelling_moves_updated_at(spark):
    rows = [(1, 7, 2, "paid", T0), (2, 7, 1, "cancelled", T0)]
    bookings = spark.createDataFrame(rows, "booking_id long, trip_id long, seat_count int, payment_status string, updated_at timestamp_ntz")
    later = T0 + dt.timedelta(30)
    req = spark.createDataFrame([(1, 1, later), (2, 2, later)], "request_id long, booking_id long, ts timestamp_ntz")
    got = {r.booking_id: r.updated_at for r in lc.cancel_bookings(bookings, req).snapshot.collect()}
    assert got == {1: later, 2: T0}


def test_new_ids_pass_the_int_range(spark):
    users = spark.createDataFrame([(2**31 + 5, "a@x.org")], "user_id long, email string")
    reqs = spark.createDataFrame([(1, "A", "B", "n@x.org", None, None)], "request_id long, firstname string, lastname string, "
                                 "email string, phone_number string, role string")
    (row,) = lc.register_users(users, reqs, T0).decisions.collect()
    assert row.user_id == 2**31 + 6
    from terminus.plans.ranking import sequence_within
    assert dict(sequence_within(reqs, [], [F.col("request_id").asc()], out="n").dtypes)["n"] == "bigint"


def test_the_last_valid_reassignment_stays(spark):
    t0 = dt.datetime(2025, 1, 1)
    trips = spark.createDataFrame([(1, 10, 3, 9, "boarding", 7, 10), (2, 10, 0, 10, "waiting", 7, 10)],
                                  "trip_id long, assigned_vehicle_id long, seats_booked int, seats_available int, trip_status string, driver_id long, capacity int")
    vehicles = spark.createDataFrame([(4, 3), (5, 20), (6, 30)], "vehicle_id long, capacity int")
    req = spark.createDataFrame([(3, 1, 5, t0), (2, 1, 6, t0), (9, 1, 4, t0 - dt.timedelta(days=1)), (10, 1, 99, t0), (4, 2, 6, None), (5, 8, 6, t0)],
                                "request_id long, trip_id long, vehicle_id long, requested_at timestamp_ntz")
    res = lc.reassign_vehicles(trips, vehicles, req)
    assert {r.request_id: r.reason for r in res.decisions.collect()} == {
        3: None, 2: "superseded", 9: "superseded", 10: "unknown_vehicle", 4: None, 5: "unknown_trip"}
    assert {r.trip_id: (r.assigned_vehicle_id, r.capacity, r.seats_available) for r in res.snapshot.collect()} == {1: (5, 20, 17), 2: (6, 30, 30)}
