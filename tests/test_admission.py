"""W01 / W02 / X07 admission folds against a plain-Python greedy loop."""

import datetime as dt
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terminus.operators import lifecycle as lc

TRIPS = ("trip_id long, route_id long, trip_status string, is_accepting_bookings boolean, "
         "queue_position int, capacity int, seats_booked int, seats_available int, fare_price decimal(8,2)")
REQS = ("request_id long, trip_id long, route_id long, firstname string, lastname string, email string, "
        "phone string, address string, seat_count int, booking_type string, payment_method string, "
        "payment_reference string, requested_at timestamp_ntz")
T0 = dt.datetime(2025, 1, 1)


def _trips(spark, rows):
    return spark.createDataFrame([r[:-1] + (Decimal(r[-1]),) for r in rows], TRIPS)


def _reqs(spark, rows):
    full = [(rid, tid, rte, "A", "B", "a@b.co", "1", "x", n, "online", "cash", "R", T0 + dt.timedelta(minutes=m))
            for rid, tid, rte, n, m in rows]
    return spark.createDataFrame(full, REQS)


def _empty(spark, schema):
    return spark.createDataFrame([], schema)


def greedy(trips, reqs):
    """Reference semantics, one request at a time."""
    left = {t[0]: t[7] for t in trips}
    status = {t[0]: t[2] for t in trips}
    out = {}
    for rid, tid, _, n, m in sorted(reqs, key=lambda r: (r[4], r[0])):
        if tid not in left:
            out[rid] = "unknown_trip"
        elif status[tid] not in ("boarding", "full"):
            out[rid] = "not_accepting"
        elif n < 1:
            out[rid] = "invalid_seat_count"
        elif n > left[tid]:
            out[rid] = "not_enough_seats"
        else:
            left[tid] -= n
            out[rid] = None
    return out


def test_admit_bookings_rules(spark):
    trips = [(1, 1, "boarding", True, 1, 14, 10, 4, 100), (2, 1, "waiting", False, 2, 14, 0, 14, 100),
             (3, 1, "full", False, 3, 14, 12, 2, 100)]
    reqs = [(10, 1, 1, 3, 0), (11, 1, 1, 2, 1), (12, 1, 1, 1, 2), (13, 2, 1, 1, 3), (14, 9, 1, 1, 4),
            (15, 3, 1, 2, 5)]
    res = lc.admit_bookings(_trips(spark, trips), _reqs(spark, reqs),
                            _empty(spark, "booking_id long"), _empty(spark, "payment_id long"),
                            dt.datetime(2025, 6, 1))
    got = {r.request_id: r.reason for r in res.decisions.collect()}
    assert got == {10: None, 11: "not_enough_seats", 12: None, 13: "not_accepting", 14: "unknown_trip", 15: None}
    acc = {r.request_id: r for r in res.accepted.collect()}
    assert acc[10].booking_id == 1 and acc[12].booking_id == 2 and acc[15].booking_id == 3
    assert acc[10].ticket_reference == "BT-2025-0001"
    assert str(acc[10].total_amount) == "300.00"
    snap = {r.trip_id: r for r in res.snapshot.collect()}
    # T5: trip 1 reaches capacity and turns full; a full trip stays full.
    assert snap[1].seats_booked == 14 and snap[1].trip_status == "full"
    assert snap[3].seats_available == 0 and snap[3].trip_status == "full"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 11), st.integers(0, 40)), min_size=1, max_size=60))
def test_admit_bookings_matches_greedy(spark, reqs):
    trips = [(1, 1, "boarding", True, 1, 14, 0, 14, 50), (2, 1, "full", False, 2, 14, 11, 3, 50),
             (3, 2, "departed", False, 0, 14, 0, 14, 50)]
    rows = [(i, tid, 1, n, m) for i, (tid, n, m) in enumerate(reqs)]
    res = lc.admit_bookings(_trips(spark, trips), _reqs(spark, rows), _empty(spark, "booking_id long"),
                            _empty(spark, "payment_id long"), dt.datetime(2025, 6, 1))
    got = {r.request_id: r.reason for r in res.decisions.collect()}
    assert got == greedy(trips, rows)


def smart_greedy(trips, reqs):
    open_ = sorted([t for t in trips if t[2] == "boarding" and t[3]], key=lambda t: (t[4], t[0]))
    left = {t[0]: t[7] for t in open_}
    out = {}
    for rid, _, rte, n, m in sorted(reqs, key=lambda r: (r[4], r[0])):
        pick = next((t[0] for t in open_ if t[1] == rte and left[t[0]] >= n), None) if n >= 1 else None
        if pick is not None:
            left[pick] -= n
        out[rid] = pick
    return out


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(1, 10), st.integers(0, 30)), min_size=1, max_size=50))
def test_admit_smart_matches_greedy(spark, reqs):
    trips = [(1, 1, "boarding", True, 2, 14, 0, 14, 50), (2, 1, "boarding", True, 1, 14, 9, 5, 50),
             (3, 1, "boarding", False, 3, 14, 0, 14, 50), (4, 1, "boarding", True, 4, 30, 0, 30, 50),
             (5, 2, "waiting", False, 1, 14, 0, 14, 50)]
    rows = [(i, None, rte, n, m) for i, (rte, n, m) in enumerate(reqs)]
    res = lc.admit_smart_bookings(_trips(spark, trips), _reqs(spark, rows))
    got = {r.request_id: r.trip_id for r in res.decisions.collect()}
    assert got == smart_greedy(trips, rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(1, 9), st.integers(0, 30)), min_size=1, max_size=40),
       st.integers(1, 9), st.integers(1, 3))
def test_admit_smart_in_small_cells(spark, reqs, slice_rows, block_rows):
    """A route's requests in slices, its trips in blocks: the result is the loop's."""
    trips = [(i, 1 + i % 2, "boarding", True, (7 * i) % 10, 14, 0, 3 + (5 * i) % 12, 50) for i in range(1, 11)]
    rows = [(i, None, rte, n, m) for i, (rte, n, m) in enumerate(reqs)]
    res = lc.admit_smart_bookings(_trips(spark, trips), _reqs(spark, rows), slice_rows=slice_rows, block_rows=block_rows)
    got = {r.request_id: r.trip_id for r in res.decisions.collect()}
    assert got == smart_greedy(trips, rows)


def test_admit_smart_without_trips_or_requests(spark):
    trips, rows = [(1, 1, "waiting", True, 1, 14, 0, 14, 50)], [(1, None, 1, 2, 5), (2, None, 9, 0, 6)]
    got = lc.admit_smart_bookings(_trips(spark, trips), _reqs(spark, rows)).decisions.collect()
    assert sorted((r.request_id, r.reason) for r in got) == [(1, "no_trip"), (2, "invalid_seat_count")]
    assert lc.admit_smart_bookings(_trips(spark, trips), _reqs(spark, rows).filter("false")).decisions.count() == 0


def test_admission_fixture_count(spark):
    """SURVEY appendix: all sf0.01 bookings as requests on empty 14-seat
    boarding trips -> 35,454 accepted."""
    from terminus.sources import requests as rq
    from terminus.sources.tables import load
    t = load(spark, "/root/testdata/sf0.01")
    trips = (t.trips.withColumn("trip_status", F.lit("boarding")).withColumn("capacity", F.lit(14))
             .withColumn("seats_booked", F.lit(0)).withColumn("seats_available", F.lit(14)))
    res = lc.admit_bookings(trips, rq.booking_requests(t), t.bookings, t.payment_log, dt.datetime(1998, 6, 15))
    assert res.accepted.count() == 35454


TRIPS_DAY = ("trip_id long, route_id long, trip_status string, is_accepting_bookings boolean, "
             "queue_position int, capacity int, seats_booked int, seats_available int, "
             "fare_price decimal(8,2), estimated_departure_time timestamp_ntz")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(1, 10), st.integers(0, 2 * 24 * 60 - 1)),
                min_size=1, max_size=40))
def test_admit_smart_by_service_day(spark, reqs):
    day0 = dt.datetime(2025, 1, 1, 6)
    trips = [(1, 1, "boarding", True, 1, 14, 0, 14, Decimal(50), day0),
             (2, 1, "boarding", True, 2, 14, 4, 10, Decimal(50), day0 + dt.timedelta(days=1)),
             (3, 1, "boarding", True, 3, 30, 0, 30, Decimal(50), day0 + dt.timedelta(days=1)),
             (4, 2, "boarding", True, 1, 14, 0, 14, Decimal(50), day0)]
    rows = [(i, None, rte, n, m) for i, (rte, n, m) in enumerate(reqs)]
    res = lc.admit_smart_bookings(spark.createDataFrame(trips, TRIPS_DAY), _reqs(spark, rows), by_service_day=True)
    got = {r.request_id: r.trip_id for r in res.decisions.collect()}
    left = {t[0]: t[7] for t in trips}
    want = {}
    for rid, _, rte, n, m in sorted(rows, key=lambda r: (r[4], r[0])):
        day = (T0 + dt.timedelta(minutes=m)).date()
        opts = sorted([t for t in trips if t[1] == rte and t[9].date() == day], key=lambda t: (t[4], t[0]))
        pick = next((t[0] for t in opts if left[t[0]] >= n), None)
        if pick is not None:
            left[pick] -= n
        want[rid] = pick
    assert got == want
